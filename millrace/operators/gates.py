"""Gates: every rule makes one check row; all are reported before any fails."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats


class GateError(ValueError):
    """Carries all failed checks."""


@dataclass(frozen=True)
class Check:
    name: str
    passed: bool
    evidence: str = ""


def frame(spark: SparkSession, checks: Iterable[Check]) -> DataFrame:
    return spark.createDataFrame([(c.name, bool(c.passed), c.evidence) for c in checks], "name string, passed boolean, evidence string")


def enforce(checks: Iterable[Check], write=None) -> list[Check]:
    """Writes all checks first, then raises with every failed one."""
    checks = list(checks)
    if write:
        write(checks)
    failed = [c for c in checks if not c.passed]
    if failed or not checks:
        raise GateError("; ".join(f"{c.name}: {c.evidence}" for c in failed) or "nothing was checked")
    return checks


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal as multisets."""
    return not a.exceptAll(b).head(1) and not b.exceptAll(a).head(1)


def subset(a: DataFrame, b: DataFrame, key: str) -> bool:
    return not a.join(b, key, "left_anti").head(1)


def same_keys(a: DataFrame, b: DataFrame, key: str) -> bool:
    return subset(a, b, key) and subset(b, a, key)


def union_by(df: DataFrame, by: list[str], sets: str) -> DataFrame:
    """Per group the union of the sets in a column, sorted. Each element is dropped where it is read again."""
    one = df.select(*by, F.explode(sets).alias("_x")).distinct()
    return one.groupBy(*by).agg(F.sort_array(F.collect_list("_x")).alias(sets))


def audit(named: dict[str, tuple[bool | None, str]]) -> list[Check]:
    """Named findings; a missing input (None) is a failure."""
    return [Check(n, bool(ok), e if ok is not None else "missing input") for n, (ok, e) in named.items()]


def convergence(curve: DataFrame, base: float, fraction: int = 5) -> list[Check]:
    """curve: step, value. Finite, from step 0, three points at least, the last fifth below the first
    fifth on average and the final value below the base."""
    n = F.col("_n")
    k = F.greatest(F.lit(1), F.floor(n / fraction))
    ends = stats.at_positions(curve, "step", {"first_end": k - 1, "last_begin": n - k})
    value, ok = F.col("value").cast("double"), F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    seen = stats.beside(curve, ends, []).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_and(ok), F.lit(False)).alias("finite"), F.min("step").alias("start"), F.max_by(value, "step").alias("final"),
        F.avg(F.when(F.col("step") <= F.col("first_end"), value)).alias("first"), F.avg(F.when(F.col("step") >= F.col("last_begin"), value)).alias("last"),
    ).first()
    finite = seen["finite"]
    return [
        Check("finite", finite, f"{seen['n']} values"),
        Check("starts_at_zero", seen["start"] == 0 and seen["n"] >= 3, f"{seen['n']} points"),
        Check("falls", finite and seen["last"] < seen["first"], f"{seen['first']} -> {seen['last']}"),
        Check("below_base", finite and seen["final"] < base, f"{seen['final']} against {base}"),
    ]


def peaks_ordered(inference: float, adapter: float, full: float) -> Check:
    return Check("peaks", full > adapter > inference, f"{full} > {adapter} > {inference}")


def monitoring(targets: DataFrame, series: DataFrame, wanted: list[str]) -> list[Check]:
    """All targets up, and every wanted series present."""
    down = targets.where(~F.col("up")).count()
    there = {r[0] for r in series.select("name").where(F.col("name").isin(wanted)).distinct().collect()}
    return [Check("targets_up", down == 0 and bool(targets.head(1)), f"{down} down"), Check("series", set(wanted) <= there, f"missing {sorted(set(wanted) - there)}")]

"""Strict answer scoring, slices, comparison, leakage and quality gates, run selection."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import stats
from ..functions.text import casefold_key
from .gates import Check, same_keys, same_rows

METRICS = ("n", "correct", "valid", "errors", "accuracy", "format_rate")


@F.pandas_udf(T.StringType())
def strict_answer(raw: pd.Series, choices: pd.Series) -> pd.Series:
    """The answer, if the whole text is one JSON object with the only key `answer`, a string among
    the choices. Python's parser rejects trailing text, which SQL JSON functions let pass."""

    def one(text, allowed):
        try:
            value = json.loads(text) if isinstance(text, str) else None
        except (ValueError, RecursionError):
            return None
        if not isinstance(value, dict) or list(value) != ["answer"]:
            return None
        a = value["answer"]
        return a if isinstance(a, str) and allowed is not None and a in list(allowed) else None

    return pd.Series([one(r, c) for r, c in zip(raw, choices)], dtype=object)


def score_items(golden: DataFrame, outputs: DataFrame) -> DataFrame:
    """golden: id, expected, choices, slices; outputs: id, raw, error. Both must have the same unique ids."""
    for df in (golden, outputs):
        if df.groupBy("id").count().where("count > 1").head(1):
            raise ValueError("duplicate ids")
    if not golden.head(1):
        raise ValueError("no items")
    if not same_keys(golden.select("id"), outputs.select("id"), "id"):
        raise ValueError("items and outputs have different ids")
    both = golden.join(outputs.select("id", "raw", "error"), "id")
    parsed = F.when(F.col("error").isNull(), strict_answer(F.col("raw"), F.col("choices")))
    return both.withColumn("parsed", parsed).withColumn("valid", F.col("parsed").isNotNull()).withColumn("correct", F.coalesce(F.col("parsed") == F.col("expected"), F.lit(False)))


def metrics() -> list[Column]:
    n = F.count(F.lit(1))
    rate = lambda c: F.when(n == 0, float("nan")).otherwise(F.count_if(F.col(c)) / n)
    return [n.alias("n"), F.count_if("correct").alias("correct"), F.count_if("valid").alias("valid"), F.count_if(F.col("error").isNotNull()).alias("errors"), rate("correct").alias("accuracy"), rate("valid").alias("format_rate")]


def overall(items: DataFrame) -> DataFrame:
    return items.agg(*metrics())


def by_slice(items: DataFrame) -> DataFrame:
    return items.withColumn("slice", F.explode(F.array_distinct("slices"))).groupBy("slice").agg(*metrics())


def changes(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """(id, change): improved is wrong to right, regressed right to wrong."""
    a, b = baseline.select("id", F.col("correct").alias("was")), candidate.select("id", F.col("correct").alias("now"))
    return a.join(b, "id").where(F.col("was") != F.col("now")).select("id", F.when(F.col("now"), "improved").otherwise("regressed").alias("change"))


def leaks(golden: DataFrame, training: DataFrame) -> DataFrame:
    """Golden ids whose input or group is in training: two semi joins, since one join on either would
    compare everything with everything."""
    g = golden.select("id", "group_id", F.sha2(casefold_key(F.col("input")).cast("binary"), 256).alias("k"))
    t = training.select("group_id", F.sha2(casefold_key(F.col("input")).cast("binary"), 256).alias("k"))
    return g.join(t.select("k"), "k", "left_semi").select("id").unionByName(g.join(t.select("group_id"), "group_id", "left_semi").select("id")).distinct()


def row_faults(df: DataFrame) -> DataFrame:
    """(id, rule) for every broken rule of golden rows."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    bad_list = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    rules = {
        "input": blank("input"), "group_id": blank("group_id"), "source": blank("source"),
        "slices": bad_list("slices") | F.exists("slices", lambda s: s.isNull() | (s == "")),
        "choices": bad_list("choices") | F.exists("choices", lambda s: s.isNull()),
        "expected": ~F.coalesce(F.array_contains("choices", F.col("expected")), F.lit(False)),
    }
    tests = F.array(*[F.when(F.coalesce(test, F.lit(True)), F.lit(name)) for name, test in rules.items()])
    return df.select("id", F.explode(F.array_compact(tests)).alias("rule"))


def leakage_gate(golden: DataFrame, training: DataFrame, behavioral: DataFrame, least: int = 50) -> list[Check]:
    n = golden.count()
    keys = golden.select(casefold_key(F.col("input")).alias("k"))
    slices = golden.select(F.explode("slices").alias("s")).distinct().count()
    kinds = {r[0] for r in behavioral.select("type").where(F.col("type").isin("format", "paraphrase", "refusal")).distinct().collect()}
    faults = row_faults(golden).count() + row_faults(behavioral).count()
    shared = golden.join(behavioral, "id", "left_semi").count()
    leaked = leaks(golden, training).count()
    return [
        Check("size", n >= least, f"{n} of {least}"), Check("rows", faults == 0, f"{faults} faults"),
        Check("unique_inputs", keys.distinct().count() == n, "inputs repeat"), Check("no_overlap", leaked == 0, f"{leaked} leaks"),
        Check("slices", slices >= 3, f"{slices} of 3"), Check("behavioral", behavioral.count() >= 3 and len(kinds) == 3, f"{sorted(kinds)}"),
        Check("separate_ids", shared == 0, f"{shared} shared"),
    ]


@dataclass(frozen=True)
class Report:
    """A scored run as tables: what it says of itself, its stored metrics (place: overall or slice:name),
    its items. Everything is recounted where it lies; the driver sees broken rules and named slices."""

    about: dict
    stored: DataFrame
    items: DataFrame


ITEM = "id string, raw string, parsed string, valid boolean, correct boolean, error string, slices array<string>"
STORED = "place string, " + ", ".join(f"{m} double" for m in METRICS)


def _places(items: DataFrame) -> DataFrame:
    """Each item once for the whole and once for each of its slices."""
    named = F.transform(F.array_distinct("slices"), lambda s: F.concat(F.lit("slice:"), s))
    return items.withColumn("place", F.explode(F.concat(F.array(F.lit("overall")), F.coalesce(named, F.array().cast("array<string>")))))


def scored(items: DataFrame, **about) -> Report:
    """The report of scored items."""
    stored = _places(items).groupBy("place").agg(*[c.cast("double").alias(n) for n, c in zip(METRICS, metrics())])
    return Report({"status": "complete", **about}, stored, items.select([f.split()[0] for f in ITEM.split(", ")]))


def report_of(items: DataFrame, **about) -> dict:
    """The same as one document, for a golden set of the size of a document."""
    report = scored(items, **about)
    blocks = {r["place"]: {m: r[m] if m in METRICS[4:] else int(r[m]) for m in METRICS} for r in report.stored.collect()}
    per_item = [r.asDict(recursive=True) for r in report.items.orderBy("id").collect()]
    return {**report.about, "overall": blocks["overall"], "slices": {p[6:]: b for p, b in blocks.items() if p != "overall"}, "per_item": per_item}


def _block(place: str, m) -> tuple:
    """Stored metrics as doubles; what is no number is null."""
    real = lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None
    return (place, *[real(m.get(k)) if isinstance(m, dict) else None for k in METRICS])


def read_report(spark: SparkSession, document: dict) -> Report:
    """A document as tables. A part that is missing leaves its table empty, which the rules tell."""
    blocks = [_block("overall", document.get("overall")), *[_block(f"slice:{k}", v) for k, v in (document.get("slices") or {}).items()]]
    items = [tuple(i.get(f.split()[0]) for f in ITEM.split(", ")) for i in document.get("per_item") or []]
    about = {k: v for k, v in document.items() if k not in ("overall", "slices", "per_item")}
    return Report(about, spark.createDataFrame(blocks, STORED), spark.createDataFrame(items, ITEM))


def broken_rules(report: Report) -> DataFrame:
    """(place, rule) for everything in which a report contradicts its items or itself."""
    told = [_block("behavioral", (report.about.get("behavioral") or {}).get("overall"))]
    own = _places(report.items).groupBy("place").agg(*[c.cast("double").alias(f"_{n}") for n, c in zip(METRICS[:4], metrics())])
    stored = report.stored.withColumn("stored", F.lit(True))
    both = stored.join(own.withColumn("counted", F.lit(True)), "place", "full_outer")
    spark = report.stored.sparkSession
    behavioral = spark.createDataFrame(told, STORED).withColumn("stored", F.lit(True))
    both = both.unionByName(behavioral.withColumns({"counted": F.lit(True), **{f"_{m}": F.col(m) for m in METRICS[:4]}}))
    c = {m: F.col(m) for m in METRICS}
    finite = reduce(lambda x, y: x & y, [c[m].isNotNull() & ~F.isnan(c[m]) & (F.abs(c[m]) < float("inf")) for m in METRICS])
    possible = (c["n"] > 0) & (c["correct"] >= 0) & (c["correct"] <= c["valid"]) & (c["valid"] <= c["n"]) & c["errors"].between(F.lit(0), c["n"] - c["valid"])
    right = stats.close(c["accuracy"], c["correct"] / c["n"]) & stats.close(c["format_rate"], c["valid"] / c["n"])
    rules = {
        "not among the items": F.col("stored") & F.col("counted").isNull(), "not stored": F.col("stored").isNull(), "metrics are not finite numbers": F.col("stored") & ~finite,
        "impossible counts": finite & ~possible, "rates are not the counts'": finite & possible & ~right,
        "counts differ from the items": reduce(lambda x, y: x | y, [c[m] != F.col(f"_{m}") for m in METRICS[:4]]),
    }
    tests = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))
    i = report.items
    contradicts = (F.col("correct") & ~F.col("valid")) | (F.col("valid") & F.col("error").isNotNull())
    again = i.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or id is null").select(F.lit("items").alias("place"), F.lit("duplicate ids").alias("rule"))
    wrong = i.where(F.coalesce(contradicts, F.lit(True))).select(F.lit("items").alias("place"), F.lit("an item contradicts itself").alias("rule"))
    return both.select("place", F.explode(tests).alias("rule")).unionByName(again).unionByName(wrong).distinct()


def _faults(report: Report, role: str) -> list[str]:
    if report.about.get("status") != "complete" or not report.about.get("model"):
        return [f"{role}: incomplete"]
    return [f"{role}.{r['place']}: {r['rule']}" for r in broken_rules(report).orderBy("place", "rule").limit(20).collect()]


def quality_gate(base: Report | dict, new: Report | dict, critical: list[str], least: int = 50) -> list[Check]:
    """Compatible, consistent, complete, and nowhere worse than the baseline."""
    base, new = (read_report(SparkSession.active(), r) if isinstance(r, dict) else r for r in (base, new))
    out = [Check(k, bool(base.about.get(k)) and base.about.get(k) == new.about.get(k), "hashes differ") for k in ("protocol_sha256", "golden_sha256", "baseline_spec_sha256")]
    faults = _faults(base, "baseline") + _faults(new, "candidate")
    out.append(Check("reports", not faults, "; ".join(faults)))
    if faults:
        return out
    a, b = (r.stored.select("place", *[F.col(m).alias(f"{side}_{m}") for m in METRICS]) for side, r in (("a", base), ("b", new)))
    both = a.join(b, "place", "full_outer")
    wanted = ["overall", *[f"slice:{c}" for c in critical]]
    rows = {r["place"]: r for r in both.where(F.col("place").isin(wanted)).collect()}
    n, apart = both.agg(F.count(F.lit(1)) - 1, F.count_if(~F.col("a_n").eqNullSafe(F.col("b_n")))).first()
    all_, worse = rows["overall"], "{} < {}".format
    out += [
        Check("size", all_["a_n"] >= least, f"{all_['a_n']:.0f}"), Check("ids", same_keys(base.items.select("id"), new.items.select("id"), "id"), "ids differ"),
        Check("slices", n >= 3 and not apart, "slices differ or are fewer than three"), Check("errors", all_["b_errors"] == 0, f"{all_['b_errors']:.0f}"),
        *[Check(m, all_[f"b_{m}"] >= all_[f"a_{m}"], worse(all_[f"b_{m}"], all_[f"a_{m}"])) for m in METRICS[4:]], Check("critical", bool(critical), "no critical slices"),
    ]
    for place in wanted[1:]:
        r = rows.get(place)
        held = r is not None and None not in (r["a_accuracy"], r["b_accuracy"]) and r["b_accuracy"] >= r["a_accuracy"]
        out.append(Check(place, held, "missing or worse"))
    h = new.about["behavioral"]["overall"]
    return [*out, Check("behavioral", h["n"] >= 3 and not h["errors"] and h["correct"] == h["n"], f"{h['correct']} of {h['n']}")]


def rescored_equal(report: Report | dict, items: DataFrame) -> Check:
    """The stored report must be what its raw outputs give."""
    stored = read_report(items.sparkSession, report) if isinstance(report, dict) else report
    again = scored(items)
    return Check("rescored", same_rows(stored.stored, again.stored) and same_rows(stored.items, again.items), "stored report differs from its outputs")


def gate_rejects_corruption(base: Report | dict, new: Report | dict, critical: list[str]) -> Check:
    """Negative test: with one right answer spoilt in a copy's items the gate must fail."""
    new = read_report(SparkSession.active(), new) if isinstance(new, dict) else new
    first = new.items.where("correct").agg(F.min("id")).first()[0]
    if first is None:
        return Check("negative_test", False, "nothing to spoil")
    hit = F.col("id") == first
    items = new.items.withColumns({"parsed": F.when(~hit, F.col("parsed")), "valid": F.col("valid") & ~hit, "correct": F.col("correct") & ~hit})
    return Check("negative_test", not all(c.passed for c in quality_gate(base, replace(new, items=items), critical)), "a spoilt report passed")


def best_run(runs: DataFrame) -> DataFrame:
    """The finished run of least (final_val_loss, run_id)."""
    ok = runs.where((F.col("status") == "FINISHED") & F.col("final_val_loss").isNotNull() & ~F.isnan("final_val_loss"))
    return ok.agg(F.min_by(F.struct(*[F.col(c) for c in runs.columns]), F.struct("final_val_loss", "run_id")).alias("r")).select("r.*").where("run_id is not null")


def compare_runs(runs: DataFrame) -> DataFrame:
    """Runs by rising loss, ranked. The number of runs of a sweep is bounded by its configuration."""
    return runs.withColumn("rank", F.row_number().over(Window.orderBy("final_val_loss", "run_id")))


def selection_gate(parent_status: str, runs: DataFrame, wanted: set[str], provenance: dict[str, str]) -> list[Check]:
    names = [r[0] for r in runs.select("candidate").limit(len(wanted) + 1).collect()]
    stale = [k for k, v in provenance.items() if runs.where(~F.coalesce(F.col("tags")[k] == v, F.lit(False))).head(1)]
    open_runs = runs.where((F.col("status") != "FINISHED") | ~F.coalesce(F.abs("final_val_loss") < float("inf"), F.lit(False))).count()
    bases = runs.select(F.col("tags")["base_revision"]).distinct().count()
    return [
        Check("parent", parent_status == "FINISHED", parent_status), Check("candidates", len(names) == len(wanted) and set(names) == wanted, f"{sorted(map(str, names))}"),
        Check("provenance", not stale, f"stale {stale}"), Check("finished", open_runs == 0, f"{open_runs} open"), Check("one_base", bases == 1, f"{bases} bases"),
    ]


def loss_gate(status: str, final: float | None, base: float | None, most: float) -> Check:
    sound = all(isinstance(x, (int, float)) and math.isfinite(x) for x in (final, base, most)) and most >= 0 and base > 0
    return Check("loss_ratio", sound and status == "FINISHED" and final / base <= most, f"{status}, {final} / {base}, at most {most}")

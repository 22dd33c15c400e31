"""Release: manifest validation, artifact integrity, atomic publication with an idempotent journal."""

from __future__ import annotations

import json
import re
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import HEX64, canonical, canonical_json, digest, release_id
from ..functions.text import strip
from ..sources.files import Files
from .gates import GateError

HASHES = ("model_sha256", "protocol_sha256", "golden_sha256", "runtime_sha256")


def release_rules(manifest: str, report: str) -> dict[str, Column]:
    """Of two columns of JSON texts: each rule's name and whether it holds, never null. Values are judged by
    their JSON type too: a number is no truth value, a text no number."""
    m, r = F.try_parse_json(manifest), F.try_parse_json(report)
    kind = lambda x, path: F.coalesce(F.schema_of_variant(F.try_variant_get(x, path, "variant")), F.lit(""))
    raw = lambda text, path: F.get_json_object(F.col(text), path)

    def told(x: Column, text: str, path: str) -> Column:
        return (kind(x, path) == "STRING") & (F.length(strip(raw(text, path))) > 0)

    def share(path: str) -> Column:
        return kind(r, path).rlike("^(BIGINT|DECIMAL|DOUBLE)") & raw(report, path).try_cast("double").between(0, 1)

    runtime = F.sha2(canonical_json(F.coalesce(raw(manifest, "$.runtime"), F.lit("{}"))).cast("binary"), 256)
    rules = {"schema_version": (kind(m, "$.schema_version") == "BIGINT") & (raw(manifest, "$.schema_version") == "1")}
    rules |= {k: told(m, manifest, f"$.{k}") for k in ("model_id", "artifact_uri")}
    rules |= {k: (kind(m, f"$.{k}") == "STRING") & raw(manifest, f"$.{k}").rlike(HEX64) for k in HASHES}
    rules["runtime"] = kind(m, "$.runtime").startswith("OBJECT<") & (kind(m, "$.runtime") != "OBJECT<>") & (runtime == raw(manifest, "$.runtime_sha256"))
    rules["evaluation"] = (raw(report, "$.status") == "complete") & (kind(r, "$.passed") == "BOOLEAN") & (raw(report, "$.passed") == "true")
    rules["evaluation_run_id"] = told(r, report, "$.evaluation_run_id")
    rules |= {f"bound:{k}": (kind(m, f"$.{k}") == kind(r, f"$.{k}")) & (raw(manifest, f"$.{k}") == raw(report, f"$.{k}")) for k in ("model_id", *HASHES)}
    rules |= {f"metric:{k}": share(f"$.metrics.{k}") for k in ("accuracy", "format_rate")}
    return {name: F.coalesce(held, F.lit(False)) for name, held in rules.items()}


def broken_rules(df: DataFrame, manifest: str, report: str, keep: list[str]) -> DataFrame:
    """(kept columns, rule): a row for each rule that a release breaks."""
    each = F.array(*[F.struct(F.lit(name).alias("rule"), held.alias("held")) for name, held in release_rules(manifest, report).items()])
    return df.select(*keep, F.inline(each)).where(~F.col("held")).drop("held")


def validate(spark: SparkSession, manifest: dict, report: dict) -> list[str]:
    """The rules that one release breaks. What JSON cannot say, such as NaN, breaks all that need it."""
    pair = spark.createDataFrame([(json.dumps(manifest), json.dumps(report))], "m string, r string")
    return sorted(r["rule"] for r in broken_rules(pair, "m", "r", []).collect())


def safe_path(path: str) -> bool:
    p = PurePosixPath(path)
    return bool(path) and not p.is_absolute() and ".." not in p.parts


def is_safe(path: Column) -> Column:
    """The same rule for a column of paths."""
    return F.coalesce((F.length(path) > 0) & ~F.startswith(path, F.lit("/")) & ~F.array_contains(F.split(path, "/"), ".."), F.lit(False))


def integrity(spark: SparkSession, expected: dict[str, str], root: str) -> DataFrame:
    """(path, fault) of an inventory {relative path: SHA-256} against the files below root."""
    unsafe = [(p, "unsafe path") for p in expected if not safe_path(p)]
    want = spark.createDataFrame([(p, h) for p, h in expected.items() if safe_path(p)], "path string, sha string")
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    have = files.select(F.regexp_replace(F.col("_metadata.file_path"), F.lit("^.*?" + re.escape(base.removeprefix("file://")) + "/"), F.lit("")).alias("path"), F.sha2("content", 256).alias("found"))
    both = want.join(have, "path", "full_outer")
    fault = F.when(F.col("sha").isNull(), "not in the inventory").when(F.col("found").isNull(), "missing").when(F.col("sha") != F.col("found"), "changed")
    told = both.select("path", fault.alias("fault")).where("fault is not null")
    return told.unionByName(spark.createDataFrame(unsafe, "path string, fault string")) if unsafe else told


def inventory_faults(spark: SparkSession, manifest: dict, root: str) -> list[str]:
    """What is wrong with a manifest's artifacts: files against their digests, and the digest of the
    whole inventory against the manifest's model."""
    files = manifest.get("file_hashes")
    if not isinstance(files, dict) or not files:
        return ["no file inventory"]
    out = [f"{r['path']}: {r['fault']}" for r in integrity(spark, files, root).where("fault <> 'not in the inventory'").orderBy("path").limit(20).collect()]
    if digest(canonical(files)) != manifest.get("model_sha256"):
        out.append("the inventory is not the model's")
    return out


class Publisher:
    """Publication in one folder of any Hadoop file system: an intent, the pointer, one journal entry per
    release, in this order and each put in place by a rename; starting again after a crash at any point
    ends in the same state. A release is validated and its artifacts are checked before anything is written,
    and again on recovery. The newest publisher of a folder holds it: it claims the next number as its own,
    and an older one finds that before each step and stops."""

    def __init__(self, folder: str, spark: SparkSession, artifacts: str):
        self.spark, self.artifacts, self.files = spark, artifacts, Files(spark, folder)
        self.number = 0
        while not self.number:
            n = self.newest() + 1
            if self.files.claim(f"fence/{n:08d}", b""):
                self.number = n

    def newest(self) -> int:
        return max((int(x) for x in self.files.names("fence")), default=0)

    def held(self) -> None:
        if self.newest() != self.number:
            raise GateError(f"publisher {self.number} was followed by {self.newest()}")

    def published(self) -> list[str]:
        return [x.split("-", 1)[1] for x in sorted(self.files.names("journal"))]

    def current(self) -> dict | None:
        found = self.files.read("current.json")
        return json.loads(found) if found is not None else None

    def verify(self, manifest: dict, decision: dict) -> None:
        faults = validate(self.spark, manifest, decision) or inventory_faults(self.spark, manifest, self.artifacts)
        if faults:
            raise GateError("; ".join(faults))

    def recover(self, crash: str | None = None) -> None:
        """Ends what an intent began. crash: stop after that step, as a lost driver would."""
        intent = self.files.read("pending.json")
        if intent is None:
            return
        event = json.loads(intent)
        self.verify(event["manifest"], event["decision"])
        steps = {"pointer": lambda: self.files.put("current.json", intent), "journal": lambda: self.enter(event["release_id"], intent), "end": lambda: self.files.delete("pending.json")}
        for name, step in steps.items():
            self.held()
            step()
            if crash == name:
                raise RuntimeError(f"stopped after {name}")

    def enter(self, rid: str, event: bytes) -> None:
        entries = self.published()
        if rid not in entries:
            self.files.claim(f"journal/{len(entries):08d}-{rid}", event)

    def publish(self, manifest: dict, decision: dict, crash: str | None = None) -> str:
        """The release's id. The same release twice is one journal entry."""
        self.recover()
        self.verify(manifest, decision)
        rid = release_id(manifest, decision)
        if rid in self.published() and (self.current() or {}).get("release_id") == rid:
            return rid
        self.held()
        self.files.put("pending.json", canonical({"release_id": rid, "manifest": manifest, "decision": decision}).encode())
        if crash == "intent":
            raise RuntimeError("stopped after intent")
        self.recover(crash)
        return rid

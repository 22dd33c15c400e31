"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where all run on one
    machine. On a cluster without the setting there is none, which is an error."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        sc.setCheckpointDir(path)
    return path.rstrip("/")


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no recomputation
    beyond its own tasks and iterative plans stay short. Results are lazy and may read them: they
    stay until `clear`, which the caller runs when results have been written."""

    roots: list[str] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/millrace-{uuid.uuid4().hex}"
        self.n = 0
        Scratch.roots.append(self.root)

    def table(self, df: DataFrame, name: str = "t", large: bool = False, texts: bool = False) -> DataFrame:
        """The rows, written and read again. Spark removes the shuffle files behind a written table when
        the driver's collector finds its stages unreachable; after a large one it is asked to look, so
        that files of finished stages don't add up. Tables of texts are packed closer, for less disk."""
        self.n += 1
        path = f"{self.root}/{self.n}-{name}"
        (df.write.option("compression", "zstd") if texts else df.write).parquet(path)
        if large:
            self.spark._jvm.System.gc()
        out = self.spark.read.schema(df.schema).parquet(path)
        out._millrace_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        """Remove tables whose readers have all been written themselves."""
        for df in dfs:
            if path := getattr(df, "_millrace_path", None):
                _delete(self.spark, path)

    def drop_all(self) -> None:
        """Remove this scratch's tables, when what was made of them has been written elsewhere."""
        _delete(self.spark, self.root)
        Scratch.roots.remove(self.root)

    @classmethod
    def clear(cls, spark: SparkSession) -> None:
        """Remove all intermediate tables of this process."""
        while cls.roots:
            _delete(spark, cls.roots.pop())


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)

"""The corpus pipeline: language ID, exact dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's documents. All but the last return the columns of `documents`, whatever their
names: whole rows travel as one struct beside what a stage reads. Nulls may stand in any column, texts
are read whole, however long, and an empty table passes through every stage as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._common import Scratch
from millrace.llm.exact_dedup import exact_dedup
from millrace.llm.langid import identify
from millrace.llm.mixing import mix
from millrace.llm.ngram_join import ngram_join
from millrace.llm.packing import pack

#: Below this share of letters in one language a document is not in a language.
LEAST_SHARE = 0.5


def _rows(docs: DataFrame, *beside: str) -> DataFrame:
    """Whole rows as one struct beside the columns that a stage reads: no name can clash with its results."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *beside)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (null and empty texts too), or without a language that has half of their
    letters, go. Repeated rows share their fate; rows without an id or a language are judged by their text."""
    found = identify(_rows(docs, "doc_id", "text", "lang"), carry=["_row", "doc_id"])
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select("_row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal up to white space the row with the smallest id stays, one where rows repeat
    the id too; a row without an id stays only where no other has its text."""
    return exact_dedup(_rows(docs, "doc_id", "text")).where("kept").select("_row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) the smallest id stays. Rows without an id
    stay, since none is smaller; so do texts without words, which link with nothing. Texts that share an
    id are one group by it and stay or go together."""
    groups = ngram_join(docs)
    gone = groups.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to three times. Sources share all words by weight; a
    null source is one of its own; texts without words are not taken; rows that repeat an id count singly."""
    taken = mix(docs, carry=docs.columns).where("copies > 0")
    each = taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select(*[F.col("_in")[c].alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of what is left, a row a piece. A null or empty text is its closing id alone; repeated
    rows are packed as often as they occur, rows without an id too."""
    return pack(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixed", mixed), ("packed", packed)]

#: Language scores, n-gram components and packing are beyond SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

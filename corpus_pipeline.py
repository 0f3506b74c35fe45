"""The corpus pipeline: five stages over documents, each on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.

Defined cases, for each stage: a null or empty text fails the quality rules and goes; nulls in other columns, very long
texts and further columns of any name pass through; rows with one id are told apart by their texts, and rows equal in
both are one document to the second stage; ties are settled as the operators say; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclith.llm import jaccard, members, mixing, pii, quality_rules, tiling
from doclith.llm.shared import Drafts, keep
from doclith.llm.text import packed


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return quality_rules.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose sets of five-word shingles are alike to 0.8 or more, directly or by way of others, the one with
    the smallest id stays; documents with no words all stay."""
    return jaccard.deduplicate(docs, k=5, percent=80)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, each by a hash of its id and text: rows may share an id, or have none.
    Only rows that may be among them are moved."""
    numbers = {"a": F.xxhash64("doc_id", F.col("text").cast("string")), "b": F.xxhash64(F.col("text").cast("string"), "doc_id", F.lit(1))}
    rows = docs.select(packed(docs), *(c.alias(n) for n, c in numbers.items()))
    leaks = tiling.leaks(rows.select(F.struct("a", "b").alias("_of"), "own.text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="_of")
    return members.without(rows, keep(leaks.select("_of.a", "_of.b").distinct(), "pipeline-leaks")).select("own.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes the name of its kind in brackets."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, and how often: copies."""
    return mixing.mixed_rows(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", contamination),
    ("PII", personal_data),
    ("mixing sources", mixture),
]

#: The join's components and the bootstrap are loops: no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's result. A stage's table is removed when the next one's is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Drafts(spark)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            written = Drafts(spark)
            docs = written.keep(docs, f"pipeline-{name.replace(' ', '-')}")
            before.remove()
            before = written
    return docs

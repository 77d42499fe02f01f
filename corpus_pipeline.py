"""A corpus pipeline: quality, duplicate lines, near-duplicates, contamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written as Parquet
and read again as the next one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxtrace.llm.bpe import round_trip
from fluxtrace.llm.decontaminate import decontaminate
from fluxtrace.llm.line_dedup import without_duplicate_lines
from fluxtrace.llm.near_dedup import drop_near_duplicates
from fluxtrace.llm.quality_classifier import keep_good
from fluxtrace.llm.workspace import Workspace, scratch


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose repeated and nearly repeated lines; n_chars follows.  All documents stay."""
    return without_duplicate_lines(docs).withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, encoded and decoded again."""
    return round_trip(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: SQL can express neither the trained classifier nor the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        with scratch(spark):
            docs = work.save(stage(spark, docs, sf_dir), name)
        work.drop(*[before for before, _ in STAGES[max(i - 1, 0) : i]])
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: quality rules, near-duplicates, decontamination, secret scan, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as
Parquet to the shared folder and reads them again, so that a lost executor costs one stage. A stage's table goes
once the next one stands; the last one before packing stays, since run()'s rows are read from it.

Python gets texts in Arrow batches of about ``BATCH_BYTES``, unless the session says otherwise: each stage sets this for the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from floodspark.llm import decontam, neardup, packing, quality, secrets
from floodspark.llm.text import Scratch, table

#: Spark's own limit is 64 MB. A worker keeps several times a batch, and both of an executor's tasks and the JVM hold theirs at once.
BATCH_BYTES, BATCH_CONF = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    if BATCH_CONF not in spark.conf.getAll:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what a rule rejects."""
    small_batches(spark)
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least doc_id of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    small_batches(spark)
    return neardup.drop_near_duplicates(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that contain a benchmark item."""
    small_batches(spark)
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; n_chars follows."""
    small_batches(spark)
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_words, boundary, batch_id and pad of each remaining text."""
    small_batches(spark)
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_dedup),
    ("decontamination", decontamination),
    ("secret scan", secret_scan),
    ("packing", pack),
]

#: No SQL says which texts are near copies; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        to = f"stage-{name.replace(' ', '-')}"
        docs = scratch.written(stage(spark, docs, sf_dir), to)
        scratch.keep_only(to)
    return STAGES[-1][1](spark, docs, sf_dir)

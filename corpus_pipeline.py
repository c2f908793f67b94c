"""A corpus pipeline over `documents`: language ID, near-dedup, decontamination, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import decontaminate, language_id, minhash_dedup, mixing, sharding
from sheaf.sources.scratch import written


#: Most bytes of an Arrow batch: a batch is held several times over between the JVM and Python.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def _bounded(spark: SparkSession) -> SparkSession:
    """Bounds the session's batches, which Spark sets when a stage runs, after its function has returned."""
    spark.conf.set(BATCH, f"{BATCH_BYTES}b")
    return spark


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are rejected as far from every language go; the model learns from the labelled documents.

    Null texts and texts without a letter have no language and go too.
    """
    _bounded(spark)
    return language_id.accepted(docs, language_id.fit(docs, F.xxhash64(F.lit("language"), "doc_id", "text")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    _bounded(spark)
    return minhash_dedup.without_near_documents(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_contaminated(docs, _bounded(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their target weights; a document that the mix repeats has so many rows."""
    return mixing.mixed_rows(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row gets a shard and a slot in it."""
    return sharding.assign_shards(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Near-duplicate classes, fitted centroids and random draws have no SQL form; tests hold each stage to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each on what was written by the one before; batches are as before when it returns."""
    before = spark.conf.get(BATCH)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    spark.conf.set(BATCH, before)  # the last stage runs no Python
    return STAGES[-1][1](spark, docs, sf_dir)

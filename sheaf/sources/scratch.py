"""Written intermediate tables: they cut lineage and outlive any executor."""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and runs in one process, as in tests.
LOCAL_DIR = "/tmp/checkpoints"

#: A side of a join of up to so many bytes is broadcast.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster, from spark.checkpoint.dir; executors of their own don't see a local one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or LOCAL_DIR).rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` to the shared folder and returns what was written; removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sheaf-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may have ended before
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def is_small(df: DataFrame, row_bytes: Column) -> bool:
    """Whether the rows of `df`, which are counted, are few enough for a broadcast."""
    return (df.agg(F.sum(row_bytes)).first()[0] or 0) <= BROADCAST_BYTES

"""Jobs and their shards: summaries, leases, retries, claims, capacity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions import vocab


def bounded_label(value: Column, allowed: tuple[str, ...], absent: str = "other") -> Column:
    """The trimmed value if it is allowed, else `other`; a null counts as `absent`."""
    trimmed = F.coalesce(F.trim(value), F.lit(absent))
    return F.when(trimmed.isin(*allowed), trimmed).otherwise("other")


def clamped(value: Column) -> Column:
    """A count, with null and negative ones as 0."""
    return F.greatest(F.coalesce(value, F.lit(0)), F.lit(0))


def reconciled(total: Column, done: Column, failed: Column, skipped: Column) -> tuple[Column, Column, Column]:
    """Failed, skipped and completed files such that they fit the total, failures first; a zero total bounds nothing."""
    bad = F.when(total > 0, F.least(failed, total)).otherwise(failed)
    idle = F.when(total > 0, F.least(skipped, F.greatest(total - bad, F.lit(0)))).otherwise(skipped)
    good = F.when(total > 0, F.least(done, F.greatest(total - bad - idle, F.lit(0)))).otherwise(done)
    return bad, idle, good


def lifecycle(status: Column, failed: Column, retrying: Column, scanning: Column, shards: Column, running: Column) -> Column:
    """The stage of a job from its status and its shards, the first rule that holds."""
    return (
        F.when(status.isin(*vocab.TERMINAL_JOB_STATUSES), status)
        .when(status == "stopping", "draining")
        .when(failed > 0, "failed")
        .when(retrying > 0, "recovering")
        .when(scanning > 0, "scanning")
        .when((running > 0) | (shards > 0), "running")
        .otherwise(status)
    )


def lease_state(status: Column, remaining: Column) -> Column:
    """none, missing, expired, expiring (30 s or less), healthy or stale; remaining: whole seconds, truncated."""
    return (
        F.when(status == "stale", "stale")
        .when(~status.isin("running", "retrying", "stale"), "none")
        .when(remaining.isNull(), "missing")
        .when(remaining <= 0, "expired")
        .when(remaining <= 30, "expiring")
        .otherwise("healthy")
    )


def swept(status: Column, expired: Column, attempts: Column, most: Column, stopping: Column) -> Column:
    """Status after an expiry sweep: only running work whose lease is over changes."""
    over = (status == "running") & expired
    return F.when(over & stopping, "stopped").when(over & (attempts >= most), "failed").when(over, "stale").otherwise(status)


def rate_and_eta(done: Column, seconds: Column, left: Column) -> tuple[Column, Column]:
    """Rate to four places, half to even, and whole seconds to go by the rounded rate; null where undefined."""
    rate = F.when((seconds > 0) & (done > 0), F.bround(done / seconds, 4))
    return rate, F.when((rate > 0) & (left > 0), (left / rate).cast("long"))


def claims(work: DataFrame, servers: DataFrame) -> DataFrame:
    """Hands open work to free slots: the k-th piece of each server's queue to its k-th slot.

    work: server, priority, shard_index, id. servers: server, slots. Ranks are per server, so no global order is needed.
    """
    queue = Window.partitionBy("server").orderBy("priority", "shard_index", "id")
    ranked = work.withColumn("slot", F.row_number().over(queue))
    return ranked.join(servers, "server").where(F.col("slot") <= F.col("slots")).drop("slots")


def current_attempts(attempts: DataFrame) -> DataFrame:
    """Marks the attempt of each shard that counts: the highest number, then the highest id; all others are fenced off."""
    order = Window.partitionBy("shard").orderBy(F.desc("attempt_number"), F.desc("id"))
    return attempts.withColumn("accepted", F.row_number().over(order) == 1)


def shard_index(row_number: Column, target: int) -> Column:
    """1 for the first `target` rows and so on; the last shard may be partial."""
    if target <= 0:
        raise ValueError("a shard needs a positive number of files")
    return (F.floor((row_number - 1) / target) + 1).cast("long")

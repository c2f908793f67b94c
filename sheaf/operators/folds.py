"""State machines as ordered folds over arrays, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def breaker_states(outcomes: Column, failures: int = 5, rest: float = 30.0) -> Column:
    """The state before each call of a circuit breaker: closed, open or half_open.

    outcomes: array<struct<at double (seconds), ok boolean>> in order. Calls that meet an open circuit are not made and
    change nothing. Every further failure while the count is reached starts the rest anew; a success closes.
    """
    start = F.expr("struct(0 AS failed, cast(null AS double) AS opened, cast(array() AS array<string>) AS states)")

    def step(acc: Column, x: Column) -> Column:
        state = F.when(acc["opened"].isNull(), "closed").when(x["at"] - acc["opened"] >= rest, "half_open").otherwise("open")
        failed = F.when(state == "open", acc["failed"]).when(x["ok"], 0).otherwise(acc["failed"] + 1)
        opened = F.when(state == "open", acc["opened"]).when(~x["ok"] & (failed >= failures), x["at"]).when(x["ok"], F.lit(None)).otherwise(acc["opened"])
        return F.struct(failed.alias("failed"), opened.alias("opened"), F.array_append(acc["states"], state).alias("states"))

    return F.aggregate(outcomes, start, step, lambda acc: acc["states"])


def limit_trajectory(samples: Column, first: int, most: int) -> Column:
    """The concurrency limit after each sample: errors cut a quarter, saturation adds eight or a quarter.

    samples: array<struct<errors int, inflight int, waiting int>> in order.
    """
    start = F.struct(F.lit(first).alias("now"), F.expr("cast(array() AS array<int>)").alias("all"))

    def step(acc: Column, x: Column) -> Column:
        now = acc["now"]
        full = ((x["inflight"] >= F.greatest(F.lit(1), now - 1)) | (x["waiting"] > 0)) & (now < most)
        grown = F.least(F.lit(most), F.greatest(now + 8, F.ceil(now * 1.25).cast("int")))
        new = F.when(x["errors"] > 0, F.greatest(F.lit(1), F.floor(now * 0.75).cast("int"))).when(full, grown).otherwise(now)
        return F.struct(new.alias("now"), F.array_append(acc["all"], new).alias("all"))

    return F.aggregate(samples, start, step, lambda acc: acc["all"])


def hysteresis(levels: Column, low: int, high: int) -> Column:
    """Whether intake pauses after each level: from `high` on, until `low` is reached again."""
    start = F.expr("struct(false AS paused, cast(array() AS array<boolean>) AS all)")

    def step(acc: Column, x: Column) -> Column:
        paused = F.when(x >= high, True).when(x <= low, False).otherwise(acc["paused"])
        return F.struct(paused.alias("paused"), F.array_append(acc["all"], paused).alias("all"))

    return F.aggregate(levels, start, step, lambda acc: acc["all"])


def trimmed_spool(lines: Column, most: int, share: float = 0.8) -> Column:
    """The newest lines that fit `share` of `most` bytes, in order. A line that doesn't fit is passed over, older ones
    may still fit. Nothing goes while all lines fit `most`."""
    size = lambda x: F.octet_length(x) + 1
    total = F.aggregate(lines, F.lit(0), lambda acc, x: acc + size(x))
    start = F.expr("struct(0 AS used, cast(array() AS array<string>) AS kept)")

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + size(x) <= int(most * share)
        return F.when(fits, F.struct((acc["used"] + size(x)).alias("used"), F.array_append(acc["kept"], x).alias("kept"))).otherwise(acc)

    return F.when(total <= most, lines).otherwise(F.aggregate(F.reverse(lines), start, step, lambda acc: F.reverse(acc["kept"])))


def marker_levels(lines: Column) -> Column:
    """Heading levels of section headers: the level seen last, at least 2 and at most 3; titles set it to 1.

    lines: array<struct<category string, level int>>; a header with a level of its own sets it.
    """
    start = F.expr("struct(1 AS last, cast(array() AS array<int>) AS all)")

    def step(acc: Column, x: Column) -> Column:
        level = F.when(x["category"] == "Title", 1).when(
            x["category"] == "Section-header", F.least(F.lit(3), F.greatest(F.lit(2), F.coalesce(x["level"], acc["last"] + 1)))
        )
        return F.struct(F.coalesce(level, acc["last"]).alias("last"), F.array_append(acc["all"], level).alias("all"))

    return F.aggregate(lines, start, step, lambda acc: acc["all"])

"""Distributed prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.sources.scratch import partitions, written


def running_totals(df: DataFrame, order: list[str], values: dict[str, str], group: str | None = None) -> DataFrame:
    """Adds, for each `values` item (new column: summed column), the sum over all rows of the group that sort before.

    The rows are range-sorted by (group, order), so a hot group spreads over many partitions. Each partition sums its
    own rows; only one total per partition and group moves further. `group` must not be null; rows that tie on `order`
    come in any order. `df` should be narrow: it is written once, so that the partition bounds hold for both passes.
    """
    keys = [group] if group else []
    ranged = written(
        df.repartitionByRange(partitions(df.sparkSession), *keys, *order).withColumn("_part", F.spark_partition_id()),
        "ranged",
    )
    totals = ranged.groupBy(*keys, "_part").agg(*(F.sum(v).alias(f"_total_{k}") for k, v in values.items()))
    earlier = Window.partitionBy(*keys or [F.lit(0)]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_part", *(_sum_or_0(f"_total_{k}", earlier).alias(f"_off_{k}") for k in values))
    within = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumns({k: _sum_or_0(v, within) for k, v in values.items()})
    out = local.join(offsets, [*keys, "_part"])
    return out.withColumns({k: F.col(k) + F.col(f"_off_{k}") for k in values}).drop("_part", *(f"_off_{k}" for k in values))


def _sum_or_0(column: str, window: object) -> Column:
    return F.coalesce(F.sum(column).over(window), F.lit(0))

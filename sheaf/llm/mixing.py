"""Mixing sources to target weights by hash-random keys, distributed prefix sums and exact cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.operators.prefix import running_totals
from sheaf.sources.scratch import written

#: A word: no space and none of the control characters tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
ORDER = ["_key", "doc_id", "size"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """One row per source (columns source, source_rank, source_size, target).

    Sources in code-point order, null last, weigh `weights`, repeating, and split `share` times the total size by
    weight. No target passes `cap` times its source's size; what a full source can't take is split among the others.
    With sources sorted by cap / weight, the full ones are a prefix, so one level serves all the rest; ranks and
    sums are distributed, and any number of sources fits.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = sources.withColumns({"_null": F.col("source").isNull(), "_one": F.lit(1).cast("long")})
    ranked = running_totals(sources, ["_null", "source"], {"source_rank": "_one"}).drop("_null", "_one")
    which = F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), (F.col("source_rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_weight", which).withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    ranked = ranked.withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    ranked = running_totals(ranked, ["_ratio", "source_rank"], {"_caps": "_cap", "_weights": "_weight"})
    ranked = written(ranked, "mix-sources")
    all_of = ranked.agg((F.sum("source_size") * share).alias("_budget"), F.sum("_weight").alias("_all"))
    level = (F.col("_budget") - F.col("_caps")) / (F.col("_all") - F.col("_weights"))
    found = (
        ranked.withColumns({"_budget": all_of.select("_budget").scalar(), "_all": all_of.select("_all").scalar()})
        .withColumn("_level", level)
        .where(F.col("_ratio") >= F.col("_level"))
        .agg(F.min_by("_level", F.struct("_ratio", "source_rank")).alias("_level"))
    )
    target = F.least("_cap", F.coalesce(found.scalar() * F.col("_weight"), F.col("_cap")))
    return ranked.select("source", "source_rank", "source_size", target.alias("target"))


def _key(seed: int) -> Column:
    """The place of a document in its source: random, the same in every run, and spread where one id has many texts."""
    return F.xxhash64(F.lit(seed), "doc_id", "source", "text").alias("_key")


def _budgeted(targets: DataFrame) -> DataFrame:
    """Adds the whole passes over a source and the words of the last, partial one."""
    budget = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return targets.withColumn("epochs", passes).withColumn("_rest", budget - F.col("epochs") * F.col("source_size"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 3
) -> DataFrame:
    """How many words of each document the mix takes: one row per input row.

    Columns doc_id, source, size, source_size, target, epochs, taken. Sizes count words (null text: 0). A source's
    documents come in the order of hash-random keys; each whole pass takes all of them, and the last pass is cut where
    the source's rounded target is met, inside a document if need be, so taken words sum to it exactly. Keys depend on
    doc_id, source and text alone: reruns agree. Rows that tie on key, doc_id and size are alike here. Null doc_ids and
    sources are values of their own; other columns are ignored; an empty table gives no rows.
    """
    sizes = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _key(seed)), "mix-sizes")
    targets = written(_budgeted(source_targets(sizes, weights, share, cap)), "mix-targets")
    named = sizes.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    summed = running_totals(named, ORDER, {"_before": "size"}, "source_rank")
    partial = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), F.col("_rest") - F.col("_before")))
    return summed.select(
        "doc_id", "source", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size") + partial).alias("taken")
    )


def mixed_rows(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 3
) -> DataFrame:
    """The mixed documents: each row as often as the mix takes it, with the columns of `docs`, whatever their names.

    The cut of a source's last pass is a place in its key order, so wide rows meet only one small row per source and
    are never sorted. Documents stay whole: the one on which the budget ends is in if at least half of it fits. Null
    and empty texts have no words and come as often as the whole passes, and once more before the cut; equal rows fare
    alike. Null doc_ids and sources are values of their own; an empty table gives no rows.
    """
    sizes = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _key(seed)), "mix-sizes")
    targets = written(_budgeted(source_targets(sizes, weights, share, cap)), "mix-targets")
    named = sizes.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    summed = running_totals(named, ORDER, {"_before": "size"}, "source_rank")
    out = (F.col("_rest") <= 0) | (F.col("_before") + F.col("size") / 2 > F.col("_rest"))
    cuts = summed.where(out).groupBy("source_rank").agg(F.min(_place()).alias("cut"))
    plan = targets.join(cuts, "source_rank", "left").select(F.col("source").alias("of"), "epochs", "cut")
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _key(seed), F.struct("*").alias("row"))
    joined = rows.join(written(plan, "mix-plan"), F.col("source").eqNullSafe(F.col("of")))
    copies = F.col("epochs") + F.when(F.col("cut").isNull() | (_place() < F.col("cut")), 1).otherwise(0)
    repeated = joined.withColumn("copy", F.explode(F.sequence(F.lit(0), copies.cast("int"))))
    return repeated.where("copy > 0").select("row.*")


def _place() -> Column:
    return F.struct("_key", F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), "size")

"""Queries over boxes and titles; slices of embeddings stand in for boxes, their labels for pages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.functions import geometry as G
from sheaf.plans.registry import query, table

#: Boxes of one page that are compared with each other.
PAGE = "label IS NOT NULL"
#: Hashes of one block, about, and of a block compared with the others in one array step.
HASHES, STRIP = 2048, 256


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, i, bbox and score: every vector is a box of the page of its block of twenty ids."""
    v = lambda k: F.col("embedding")[k].cast("double")
    x, y = F.floor((v(0) + 1) * 50), F.floor((v(1) + 1) * 50)
    box = F.array(x, y, x + 20 + F.floor(F.abs(v(2)) * 40), y + 20 + F.floor(F.abs(v(3)) * 40)).cast("array<double>")
    return table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("page"), F.col("vec_id").alias("i"), box.alias("bbox"), v(4).alias("score"))


_BOXES = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
b AS (
  SELECT vec_id // 20 AS page, vec_id AS i, floor((e[1] + 1) * 50) AS x1, floor((e[2] + 1) * 50) AS y1,
         floor((e[1] + 1) * 50) + 20 + floor(abs(e[3]) * 40) AS x2, floor((e[2] + 1) * 50) + 20 + floor(abs(e[4]) * 40) AS y2, e[5] AS score FROM v
), p AS (
  SELECT a.page, a.i, c.i AS j, greatest(0, least(a.x2, c.x2) - greatest(a.x1, c.x1)) * greatest(0, least(a.y2, c.y2) - greatest(a.y1, c.y1)) AS inter,
         (a.x2 - a.x1) * (a.y2 - a.y1) AS sa, (c.x2 - c.x1) * (c.y2 - c.y1) AS sc
  FROM b a JOIN b c ON a.page = c.page AND a.i < c.i
)
"""


@query("bbox_pairs_iou", _BOXES + "SELECT page, i, j, round(inter / (sa + sc - inter), 6) AS iou, round(inter / least(sa, sc), 6) AS overlap, round(inter / sa, 6) AS cover FROM p WHERE inter > 0")
def bbox_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a page that touch; a page holds a bounded number of boxes."""
    a = _boxes(spark, sf_dir).select("page", "i", F.col("bbox").alias("a"))
    pairs = a.join(a.select("page", F.col("i").alias("j"), F.col("a").alias("b")), "page").where("i < j").where(G.intersection(F.col("a"), F.col("b")) > 0)
    r = lambda f: F.round(f(F.col("a"), F.col("b")), 6)
    return pairs.select("page", "i", "j", r(G.iou).alias("iou"), r(G.overlap).alias("overlap"), r(G.cover).alias("cover"))


@query("nms_keep", "WITH RECURSIVE" + _BOXES.strip().removeprefix("WITH") + """, o AS (SELECT page, i, x1, y1, x2, y2, row_number() OVER (PARTITION BY page ORDER BY score DESC, i) AS k FROM b),
s AS (
  SELECT DISTINCT page, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(i BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)[]) AS kept FROM o
  UNION ALL
  SELECT o.page, o.k, CASE WHEN len(list_filter(s.kept, lambda q: greatest(0, least(q.x2, o.x2) - greatest(q.x1, o.x1)) * greatest(0, least(q.y2, o.y2) - greatest(q.y1, o.y1)) > 0.5 * (
      (q.x2 - q.x1) * (q.y2 - q.y1) + (o.x2 - o.x1) * (o.y2 - o.y1) - greatest(0, least(q.x2, o.x2) - greatest(q.x1, o.x1)) * greatest(0, least(q.y2, o.y2) - greatest(q.y1, o.y1))))) > 0
    THEN s.kept ELSE list_append(s.kept, {'i': o.i, 'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2}) END
  FROM s JOIN o ON o.page = s.page AND o.k = s.k + 1
)
SELECT page, kept.i AS i FROM (SELECT page, unnest(kept) AS kept FROM (SELECT page, kept FROM s QUALIFY k = max(k) OVER (PARTITION BY page)))
""")
def nms_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = F.collect_list(F.struct("score", F.col("i").alias("index"), "bbox"))
    return _boxes(spark, sf_dir).groupBy("page").agg(boxes.alias("boxes")).select("page", F.explode(G.kept_boxes(F.col("boxes"), 0.5)).alias("i"))


@query("caption_nearest", _BOXES + """
, s AS (
  SELECT a.page, a.i, c.i AS j,
         abs(a.i - c.i) * 85 + CASE WHEN c.y1 > a.y2 THEN 0 ELSE 30 END
         + abs((a.y1 + a.y2) / 2 - (c.y1 + c.y2) / 2) * CASE WHEN least(a.x2, c.x2) - greatest(a.x1, c.x1) > 0 THEN 0.5 ELSE 1.5 END
         + sqrt(((a.x1 + a.x2 - c.x1 - c.x2) / 2) ** 2 + ((a.y1 + a.y2 - c.y1 - c.y2) / 2) ** 2) * 0.1 AS score
  FROM b a JOIN b c ON a.page = c.page WHERE a.i % 3 = 0 AND c.i % 3 = 1
)
SELECT page, i, arg_min(j, (score, j)) AS caption, round(min(score), 6) AS score FROM s GROUP BY 1, 2
""")
def caption_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest caption of each figure of a page."""
    boxes = _boxes(spark, sf_dir).select("page", "i", "bbox")
    figures, captions = boxes.where("i % 3 = 0"), boxes.where("i % 3 = 1").select("page", F.col("i").alias("j"), F.col("bbox").alias("b"))
    score = G.caption_score(F.col("bbox"), F.col("b"), F.col("i"), F.col("j"))
    scored = figures.join(captions, "page").select("page", "i", "j", score.alias("score"))
    return scored.groupBy("page", "i").agg(F.min_by("j", F.struct("score", "j")).alias("caption"), F.round(F.min("score"), 6).alias("score"))


@query("title_levels", """
WITH t AS (
  SELECT page, i, y2 - y1 AS h, CASE WHEN i % 4 = 0 THEN 'number' WHEN i % 4 = 1 THEN 'letter' ELSE 'plain' END AS symbol FROM b_rows
), r AS (SELECT *, dense_rank() OVER (PARTITION BY page ORDER BY h DESC) - 1 AS rank FROM t),
c AS (SELECT *, max(rank) OVER (PARTITION BY page) + 1 AS n, min(i) OVER (PARTITION BY page, symbol) AS first FROM r)
SELECT page, i, CAST(least(rank * 4 // n + 1, 4) AS INTEGER) AS level, CAST(dense_rank() OVER (PARTITION BY page ORDER BY first) AS INTEGER) AS sequence FROM c
""".replace("WITH t AS", _BOXES.strip() + ", b_rows AS (SELECT * FROM b), t AS", 1))
def title_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels from the rank of a title's height on its page, and numbers of symbol kinds by first appearance."""
    symbol = F.when(F.col("i") % 4 == 0, "number").when(F.col("i") % 4 == 1, "letter").otherwise("plain")
    titles = _boxes(spark, sf_dir).select("page", "i", (F.col("bbox")[3] - F.col("bbox")[1]).alias("h"), symbol.alias("symbol"))
    page = Window.partitionBy("page")
    ranked = titles.select("*", (F.dense_rank().over(page.orderBy(F.desc("h"))) - 1).alias("rank"), F.min("i").over(Window.partitionBy("page", "symbol")).alias("first"))
    level = F.least(F.floor(F.col("rank") * 4 / F.col("n")) + 1, F.lit(4)).cast("int")
    return ranked.withColumn("n", F.max("rank").over(page) + 1).select("page", "i", level.alias("level"), F.dense_rank().over(page.orderBy("first")).alias("sequence"))


@query("near_dup_groups", """
WITH v AS (SELECT vec_id, label, [x > 0 FOR x IN embedding] AS h FROM embeddings WHERE len(embedding) > 0 AND label IS NOT NULL)
SELECT a.vec_id AS a, b.vec_id AS b, CAST(len(list_filter(list_zip(a.h, b.h), lambda x: x[1] <> x[2])) AS INTEGER) AS distance
FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id WHERE len(list_filter(list_zip(a.h, b.h), lambda x: x[1] <> x[2])) <= 18
""")
def near_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image hashes of one group at most 18 bits apart; every vector and every component counts.

    Hashes of a label are compared in blocks inside tasks, which give out near pairs only. (Of 19 blocks of 3 or 4 bits,
    one of which near hashes share, each pair of a label would meet in about two: more work than all pairs once.)
    """
    sign = lambda acc, x: F.call_function("shiftleft", acc, F.lit(1)) + F.when(x > 0, 1).otherwise(0)
    word = lambda k: F.aggregate(F.slice("embedding", k * 64 + 1, F.lit(64)), F.lit(0).cast("long"), sign)
    bits = F.transform(F.sequence(F.lit(0), F.floor((F.size("embedding") - 1) / 64).cast("int")), word)
    hashes = table(spark, sf_dir, "embeddings").where(F.size("embedding") > 0).select(F.col("vec_id").cast("long").alias("vec_id"), "label", bits.alias("h"))
    blocks = hashes.groupBy("label").agg(F.ceil(F.count("h") / HASHES).alias("blocks"))
    placed = hashes.join(blocks, "label").withColumn("own", F.pmod(F.xxhash64("vec_id"), "blocks"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    placed = placed.select("label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "vec_id", "h")
    return placed.groupBy("label", "i", "j").applyInArrow(_near_hashes, "a long, b long, distance int")


def _near_hashes(group: pa.Table) -> pa.Table:
    ids, own, across = group.column("vec_id").to_numpy(), group.column("own").to_numpy(), group.column("i")[0] != group.column("j")[0]
    lists = group.column("h").to_pylist()
    h = np.zeros((len(lists), max(map(len, lists))), np.int64)
    for k, x in enumerate(lists):
        h[k, : len(x)] = x
    found = []
    for k in range(0, len(ids), STRIP):
        at = slice(k, k + STRIP)
        apart = sum(np.bitwise_count((h[at, None, w] ^ h[None, :, w]).view(np.uint64)).astype(np.int32) for w in range(h.shape[1]))
        near = (apart <= 18) & (ids[at, None] < ids[None, :])
        if across:  # pairs within a block are compared where that block meets itself
            near &= own[at, None] != own[None, :]
        x, y = np.nonzero(near)
        found.append((ids[x + k], ids[y], apart[x, y]))
    return pa.table([np.concatenate(c) for c in zip(*found, strict=True)], names=["a", "b", "distance"])


@query("smart_resize", """
WITH s AS (SELECT p_partkey, CAST(p_size * 37 + 1 AS DOUBLE) AS h, CAST(trunc(p_retailprice * 2) AS DOUBLE) AS w FROM part),
n AS (SELECT *, greatest(28, round_even(h / 28, 0) * 28) AS h0, greatest(28, round_even(w / 28, 0) * 28) AS w0 FROM s)
SELECT p_partkey,
  CAST(CASE WHEN h0 * w0 > 1003520 THEN greatest(28, floor(h / sqrt(h * w / 1003520) / 28) * 28) WHEN h0 * w0 < 3136 THEN ceil(h * sqrt(3136 / (h * w)) / 28) * 28 ELSE h0 END AS BIGINT) AS height,
  CAST(CASE WHEN h0 * w0 > 1003520 THEN greatest(28, floor(w / sqrt(h * w / 1003520) / 28) * 28) WHEN h0 * w0 < 3136 THEN ceil(w * sqrt(3136 / (h * w)) / 28) * 28 ELSE w0 END AS BIGINT) AS width
FROM n WHERE greatest(h, w) / least(h, w) <= 200
""")
def smart_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 37 + 1).cast("double").alias("h"), (F.col("p_retailprice") * 2).cast("long").cast("double").alias("w"))
    return sizes.select("p_partkey", G.resized(F.col("h"), F.col("w"), most=1003520).alias("r")).where("r IS NOT NULL").select("p_partkey", "r.height", "r.width")

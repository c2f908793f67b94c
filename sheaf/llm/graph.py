"""Connected components of link tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.sources.scratch import written

#: Links that one task may hold (16 bytes each); more links take the distributed way.
TASK_LINKS = 2_000_000


def components(links: DataFrame) -> DataFrame:
    """Columns node, component (smallest node reachable) for every node of `links` (long columns a, b; not null).

    A table of up to TASK_LINKS links is joined up by one executor task, which writes the labels; a larger one by
    rounds of joins. Both give the same labels.
    """
    if links.count() <= TASK_LINKS:
        return written(links.select("a", "b").repartition(1).mapInArrow(_joined_up, "node long, component long"), "labels")
    return _by_rounds(links)


def least_labels(a: np.ndarray, b: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """For each of the different `nodes` the place of the smallest one reachable by the links of places a, b."""
    order = np.argsort(nodes)
    rank = np.empty(len(nodes), dtype=np.int64)
    rank[order] = np.arange(len(nodes))
    a, b = rank[a], rank[b]
    label, before = np.arange(len(nodes)), None
    while before is None or (label != before).any():
        before = label.copy()
        np.minimum.at(label, a, before[b])
        np.minimum.at(label, b, before[a])
        while (label[label] != label).any():
            label = label[label]
    return order[label[rank]]


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if got:
        a, b = (np.concatenate(x) for x in zip(*got, strict=True))
        nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = least_labels(ends[: len(a)], ends[len(a) :], nodes)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(nodes[label], pa.int64())], names=["node", "component"])


def _by_rounds(links: DataFrame) -> DataFrame:
    """Each round takes the smallest label among neighbours and then the label of that label, so rounds grow with the
    logarithm of the longest path. Each round's labels are written."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = written(both.distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("_near"))
        step = labels.join(near, "node", "left").select("node", F.col("component").alias("_old"), F.least("component", "_near").alias("_new"))
        step = written(step, "step")
        if step.where("_old <> _new").isEmpty():
            return labels
        jump = step.select(F.col("node").alias("_new"), F.col("_new").alias("_next"))
        labels = written(step.join(jump, "_new").select("node", F.least("_new", "_next").alias("component")), "labels")

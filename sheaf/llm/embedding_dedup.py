"""Embedding near-duplicates by iterative quantisation: balanced binary codes, multi-index tables, exact rerank."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.graph import components, least_labels
from sheaf.sources.scratch import written

#: Most vectors of a length that its rotation is learnt from; every vector is indexed.
SAMPLE = 20_000
#: Vectors of a bucket, about, by which the bits of a key are chosen, and most tables before keys get narrower.
BUCKET, MOST_TABLES, MOST_BITS = 64, 128, 48
#: Share of partners at the threshold, simulated for sample vectors, that must share a table's key.
RECALL, PARTNERS = 0.98, 4000
#: Bits of a code at least: short vectors get several rotations.
CODE_BITS = 64
#: Vectors of one bucket compared in one task; a larger bucket is cut into blocks, all pairs of which are compared.
BLOCK, STRIP = 1024, 256


def learn_rotation(vectors: np.ndarray, key_bits: int, threshold: float, rounds: int = 40, seed: int = 11) -> dict:
    """The codes of one vector length, as plain arrays: mean, matrix (dimensions by bits), tables (lists of the bits of
    each key), radius (most bits in which vectors at the threshold differ).

    Principal axes, then the rotation that brings the projections nearest to the corners of a cube. Tables are added
    until RECALL of the partners simulated at the threshold share a key; should MOST_TABLES not do, keys get narrower.
    """
    mean = vectors.mean(axis=0)
    centred = vectors - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    projected, rng, turns = centred @ axes, np.random.default_rng(seed), []
    for _ in range(math.ceil(CODE_BITS / len(mean))):
        turn, _ = np.linalg.qr(rng.standard_normal((len(mean), len(mean))))
        for _ in range(rounds):
            left, _, right = np.linalg.svd(np.where(projected @ turn > 0, 1.0, -1.0).T @ projected)
            turn = (left @ right).T
        turns.append(axes @ turn)
    model = {"mean": mean, "matrix": np.concatenate(turns, axis=1)}
    near = vectors[rng.integers(0, len(vectors), PARTNERS)]
    aside = rng.standard_normal(near.shape)
    aside -= (aside * near).sum(axis=1, keepdims=True) * near
    aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-12)
    partner = threshold * near + math.sqrt(max(0.0, 1 - threshold**2)) * aside
    flips = _bits(near, model) != _bits(partner, model)
    n = flips.sum(axis=1)
    model["radius"] = min(flips.shape[1], math.ceil(max(n.mean() + 6 * n.std(), 1.25 * n.max())))
    bits = min(key_bits, MOST_BITS, flips.shape[1])
    while True:
        tables, met, order = [], np.zeros(PARTNERS, dtype=bool), np.zeros(0, np.int64)
        while met.mean() < RECALL and len(tables) < MOST_TABLES:
            while len(order) < bits:
                order = np.concatenate([order, rng.permutation(flips.shape[1])])
            own, order = order[:bits], order[bits:]
            tables.append(own.tolist())
            met |= ~flips[:, own].any(axis=1)
        if met.mean() >= RECALL:
            return model | {"tables": tables}
        bits -= 1


def _bits(vectors: np.ndarray, model: dict) -> np.ndarray:
    return (vectors - model["mean"]) @ model["matrix"] > 0


def table_keys(bits: np.ndarray, model: dict) -> np.ndarray:
    """The key of each code in each table: so many of its bits."""
    return np.stack([bits[:, own].astype(np.int64) @ (1 << np.arange(len(own), dtype=np.int64)) for own in model["tables"]], axis=1)


def _words(bits: np.ndarray) -> np.ndarray:
    """Codes as rows of 64-bit words."""
    packed = np.packbits(bits, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def near_vectors(table: DataFrame, threshold: float = 0.93) -> DataFrame:
    """One row per row of `table` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Rows link if their labels are equal and not null, their vectors equally long and the cosine of these, in doubles,
    is `threshold` or more. n_links counts the other rows linked directly; component_id is the smallest vec_id
    reachable. Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and neither
    do rows without a label; their component is their own vec_id. Equal vectors of a label are one node, told apart by
    128 bits of hash, and meet only as a count. Repeated rows are other rows. Labels may be of any type that can be
    grouped by; other columns are ignored; an empty table gives no rows.

    Every length of vectors has its own codes and tables. Vectors that agree on the key of any table are retrieved, and
    within the Hamming radius of the threshold reranked by their cosine, in blocks inside tasks: a task reports sums
    and a spanning forest of its links, never its pairs, and a pair counts in the first table on which it agrees. The
    number of lengths, not of vectors, sets what the driver holds.
    """
    plain = table.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    cleaned = F.when(F.col("label").isNotNull() & sound, F.transform("v", lambda x: x + 0.0))  # -0.0 is 0.0
    hashes = [F.xxhash64(F.lit(seed), "label", cleaned).alias(name) for seed, name in ((1, "h1"), (2, "h2"))]
    rows = written(plain.select("vec_id", "label", cleaned.alias("v"), *hashes), "vectors")
    grouped = rows.where("v IS NOT NULL").groupBy("h1", "h2").agg(F.any_value("label").alias("label"), F.any_value("v").alias("v"), F.count("v").alias("copies"))
    nodes = written(grouped.select("h1", "h2", "label", "copies", "v", F.size("v").alias("d")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    shared = table.sparkSession.sparkContext.broadcast(_models(nodes, threshold))
    single = table.schema["embedding"].dataType.simpleString() == "array<float>"
    label = nodes.schema["label"].dataType.simpleString()
    coder = nodes.select("node", "label", "copies", "d", "v").mapInArrow(_coder(shared, single), f"node long, label {label}, copies long, d int, v binary, code binary, keys array<long>")
    found = written(_compared(written(coder, "codes"), shared, threshold), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    of = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = nodes.select("h1", "h2", "node", "copies").join(links, "node", "left").join(of, "node", "left")
    n_links = (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    known = written(known.select("h1", "h2", n_links, F.coalesce("component", "node").alias("component")), "known")
    joined = rows.select("vec_id", "h1", "h2", F.col("v").isNotNull().alias("sound")).join(known, ["h1", "h2"], "left")
    joined = written(joined.withColumn("component", F.when(F.col("sound"), F.col("component"))), "joined")
    least = written(joined.where("sound").groupBy("component").agg(F.min("vec_id").alias("component_id")), "least")
    named = joined.join(least, "component", "left")
    own, n = F.coalesce("component_id", "vec_id"), F.when(F.col("sound"), F.col("n_links")).otherwise(0).cast("long")
    return named.select("vec_id", n.alias("n_links"), own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"))


def _models(nodes: DataFrame, threshold: float) -> dict:
    """The codes of every length of which there are several vectors; a sample of SAMPLE vectors each comes here."""
    sizes = nodes.groupBy("d", "label").agg(F.count("node").alias("n")).groupBy("d").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    sizes = {r["d"]: r for r in sizes.where("most > 1").collect()}
    if not sizes:
        return {}
    parts = nodes.sparkSession.createDataFrame([(d, min(1.0, SAMPLE / r["n"])) for d, r in sizes.items()], "d int, part double")
    place = F.xxhash64(F.lit("sample"), "h1").cast("double") + 2.0**63
    drawn = nodes.select("d", "h1", "h2", "v").join(F.broadcast(parts), "d").where(place <= F.col("part") * 2.0**64)
    drawn = drawn.select("d", "h1", "h2", "v").toArrow().sort_by([("d", "ascending"), ("h1", "ascending"), ("h2", "ascending")])
    of, models = drawn.column("d").to_numpy(), {}
    for d, r in sizes.items():
        vectors = np.array(drawn.column("v").filter(pa.array(of == d)).to_pylist(), dtype=np.float64).reshape(-1, d)
        vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True) if len(vectors) else np.eye(d)
        models[d] = learn_rotation(vectors, max(0, math.ceil(math.log2(r["most"] / BUCKET))), threshold)
    return models


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # squares of huge or tiny components stay finite
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _coder(shared: object, single: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, values = batch.column(3).to_numpy(), batch.column(4).flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(lengths) - lengths
            v, code, keys = ([None] * batch.num_rows for _ in range(3))
            for d in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == d)
                vectors = values[starts[at][:, None] + np.arange(d)]
                for i, x in zip(at, vectors.astype(np.float32) if single else vectors, strict=True):
                    v[i] = x.tobytes()
                if d in shared.value:
                    bits = _bits(_unit(vectors), shared.value[d])
                    for i, w, k in zip(at, _words(bits), table_keys(bits, shared.value[d]), strict=True):
                        code[i], keys[i] = w.tobytes(), k.tolist()
            made = [pa.array(v, pa.binary()), pa.array(code, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), *made], names=["node", "label", "copies", "d", "v", "code", "keys"])

    return run


def _compared(coded: DataFrame, shared: object, threshold: float) -> DataFrame:
    """Columns node, links (other rows it links to in a task's share of pairs), root (of its tree in that task)."""
    bucket = ["label", "d", "t", "key"]
    placed = coded.select("node", "label", "copies", "d", "v", "code", F.posexplode("keys").alias("t", "key"))
    counts = written(placed.groupBy(*bucket).agg(F.count("node").alias("n")).where("n > 1"), "buckets")
    kept = placed.join(counts, bucket)
    blocks = F.ceil(F.col("n") / BLOCK)
    kept = kept.withColumn("own", F.pmod(F.xxhash64(F.lit("block"), "node"), blocks))
    kept = kept.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    kept = kept.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    grouped = kept.select(*bucket, "i", "j", "own", "node", "copies", "v", "code").groupBy(*bucket, "i", "j")
    return grouped.applyInArrow(_comparer(shared, threshold), "node long, links long, root long")


def _comparer(shared: object, threshold: float) -> Callable:
    def run(group: pa.Table) -> pa.Table:
        d, t, i, j = (group.column(c)[0].as_py() for c in ("d", "t", "i", "j"))
        model = shared.value[d]
        node, copies, own = (group.column(c).to_numpy() for c in ("node", "copies", "own"))
        blobs = group.column("v").to_pylist()
        kind = np.float32 if len(blobs[0]) == 4 * d else np.float64
        vectors = _unit(np.frombuffer(b"".join(blobs), kind).reshape(-1, d).astype(np.float64))
        codes = np.frombuffer(b"".join(group.column("code").to_pylist()), np.uint64).reshape(len(node), -1)
        masks = _words(np.array([np.isin(np.arange(model["matrix"].shape[1]), bits) for bits in model["tables"][:t]])) if t else []
        left, right = (np.flatnonzero(own == k) for k in (i, j))  # pairs within a block are met where that block meets itself
        links, ends = np.zeros(len(node), np.int64), [(np.zeros(0, np.int64),) * 2]
        for start in range(0, len(left), STRIP):
            strip = left[start : start + STRIP]
            apart = sum(np.bitwise_count(codes[strip, None, w] ^ codes[None, right, w]).astype(np.int32) for w in range(codes.shape[1]))
            near = apart <= model["radius"]
            if i == j:
                near &= strip[:, None] < right[None, :]
            if near.mean() > 0.05:
                p, q = np.nonzero(near & (vectors[strip] @ vectors[right].T >= threshold))
                p, q = strip[p], right[q]
            else:
                p, q = np.nonzero(near)
                p, q = strip[p], right[q]
                close = np.einsum("ij,ij->i", vectors[p], vectors[q]) >= threshold
                p, q = p[close], q[close]
            for mask in masks:
                other = (((codes[p] ^ codes[q]) & mask) != 0).any(axis=1)
                p, q = p[other], q[other]
            links += np.bincount(p, copies[q], len(node)).astype(np.int64) + np.bincount(q, copies[p], len(node)).astype(np.int64)
            ends.append((p, q))
        p, q = (np.concatenate(x) for x in zip(*ends, strict=True))
        root = node[least_labels(p, q, node)]
        linked = np.flatnonzero(links)
        return pa.table([pa.array(x[linked], pa.int64()) for x in (node, links, root)], names=["node", "links", "root"])

    return run

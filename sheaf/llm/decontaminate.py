"""Benchmark decontamination: item-sized windows around shared shingles, all verified exactly; SimHash distances."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm import words as W
from sheaf.sources.scratch import written

SHINGLE = 5
BITS = 128
#: Sums of weights are taken as equal within this share.
ROUNDING = 1e-9
#: Benchmark text held by each worker in one pass; a larger benchmark takes several passes.
BLOCK_BYTES = 16 << 20

_SALTS = (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F))


def _signs(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each word and bit."""
    both = np.stack([W.mix(hashes ^ s) for s in _SALTS], axis=1)
    return np.unpackbits(both.view(np.uint8).reshape(len(hashes), 16), axis=1).astype(np.int32) * 2 - 1


def _item_shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The words of an item and its unlike shingles."""
    found, _ = W.hashed_words([text], W.ALNUM, lower=True)
    return found, np.unique(W.shingles(found, min(SHINGLE, len(found)))) if len(found) else found


def build_index(items: list[tuple[int, str | None]], held: dict[int, int] | None = None, total: int = 0) -> dict:
    """Items with their fingerprints and weighted shingles, and for each shingle width the items that hold a shingle.

    A shingle weighs the more, the fewer items hold it: of these items, or as `held` says, of `total` items with words.
    Items without words can't be found.
    """
    kept, counts = [], Counter()
    for item_id, text in items:
        found, own = _item_shingles(text)
        if len(found):
            counts.update(own.tolist())
            kept.append((item_id, found, own))
    held, total = (counts, len(kept)) if held is None else (held, total)
    weights = [np.array([math.log(1 + total / held[s]) for s in own.tolist()]) for _, _, own in kept]
    gates = {}
    for k in sorted({min(SHINGLE, len(found)) for _, found, _ in kept}):
        of = [i for i, (_, found, _) in enumerate(kept) if min(SHINGLE, len(found)) == k]
        shingles = np.concatenate([kept[i][2] for i in of])
        order = np.argsort(shingles, kind="stable")
        values, first = np.unique(shingles[order], return_index=True)
        gates[k] = {
            "values": values, "first": np.append(first, len(order)), "items": np.repeat(of, [len(kept[i][2]) for i in of])[order],
            "weights": np.concatenate([weights[i] for i in of])[order],
        }
    return {
        "ids": [i for i, _, _ in kept], "words": [len(found) for _, found, _ in kept], "shingles": [own for _, _, own in kept], "weights": weights,
        "totals": np.array([w.sum() for w in weights]), "bits": [np.packbits(_signs(found).sum(axis=0) > 0) for _, found, _ in kept], "gates": gates,
    }


def _member(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return sorted_values[at] == values


def find_items(found: np.ndarray, index: dict, threshold: float) -> dict[int, tuple[float, int, int, int]]:
    """For the words of one text: item id to (similarity, Hamming distance, first word, words) of its best window.

    Items of whose shingle weight the text holds less than the threshold are left; of the others every window is
    weighed, so none is lost. For an item longer than the text the window is the text.
    """
    best: dict[int, tuple[float, int, int, int]] = {}
    for k, gate in index["gates"].items():
        own = W.shingles(found, k)
        hits = np.flatnonzero(_member(gate["values"], own)) if len(own) else own
        if not len(hits):
            continue
        there = np.unique(np.searchsorted(gate["values"], own[hits]))
        sizes = gate["first"][there + 1] - gate["first"][there]
        entries = np.repeat(gate["first"][there] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        items, at = np.unique(gate["items"][entries], return_inverse=True)
        reached = np.bincount(at, weights=gate["weights"][entries])
        for i in items[reached >= (threshold - ROUNDING) * index["totals"][items]].tolist():
            window = _best_window(found, own, hits, k, i, index, threshold)
            if window and (-window[0], *window[1:3]) < _rank(best.get(index["ids"][i])):
                best[index["ids"][i]] = window
    return best


def _best_window(found: np.ndarray, own: np.ndarray, hits: np.ndarray, k: int, i: int, index: dict, threshold: float) -> tuple[float, int, int, int] | None:
    """The most similar window for item i; of equal ones that of the nearest fingerprint, then the first."""
    shingles, weights, total = index["shingles"][i], index["weights"][i], index["totals"][i]
    n = min(index["words"][i], len(found))
    at = hits[_member(shingles, own[hits])]
    which = np.searchsorted(shingles, own[at])
    order = np.argsort(which, kind="stable")
    at, which = at[order], which[order]
    before = np.where(np.append(False, which[1:] == which[:-1]), np.append(-1, at[:-1]), -1)  # where the shingle stood last
    low, high = np.maximum(at - n + k, before + 1), np.minimum(at, len(found) - n)  # first words of windows that it is new to
    low = np.maximum(low, 0)
    some = low <= high
    edges, place = np.unique(np.concatenate([low[some], high[some] + 1]), return_inverse=True)
    level = np.cumsum(np.bincount(place, weights=np.concatenate([weights[which[some]], -weights[which[some]]])))
    if level.max() < (threshold - ROUNDING) * total:
        return None
    best = None
    for m in np.flatnonzero(level >= level.max() - ROUNDING * total).tolist():
        a, b = int(edges[m]), int(edges[m + 1])
        similarity = float(weights[np.isin(shingles, own[a : a + n - k + 1])].sum() / total)
        sums = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(_signs(found[a : b + n - 1]), axis=0, dtype=np.int32)])
        apart = np.bitwise_count(np.packbits(sums[n:] - sums[:-n] > 0, axis=1) ^ index["bits"][i]).sum(axis=1)
        window = (similarity, int(apart.min()), a + int(apart.argmin()), n)
        if (-similarity, *window[1:3]) < _rank(best):
            best = window
    return best


def _rank(found: tuple[float, int, int, int] | None) -> tuple[float, int, int]:
    return (-found[0], found[1], found[2]) if found else (0.0, 0, 0)


def _passes(benchmark: DataFrame) -> Iterator[dict]:
    """One index per block of items, each block of bounded size; shingles weigh alike in all of them."""
    spark = benchmark.sparkSession
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, math.ceil(size / BLOCK_BYTES))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).alias("block")
    if n > 1:
        known = benchmark.where("item_id IS NOT NULL").select(block, "text")
        placed = written(known.mapInArrow(_placed_shingles, "block long, s long, is_first boolean"), "shingles")
        total = placed.where("is_first").count()
        held = written(placed.groupBy("s").agg(F.count("s").alias("n")), "held")
    for k in range(n):
        rows = benchmark.where(block == k).select("item_id", "text").collect()
        items = sorted(((r[0], r[1]) for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] or ""))
        if n > 1:
            own = held.join(placed.where(F.col("block") == k).select("s").distinct(), "s", "left_semi").select("s", "n").toArrow()
            index = build_index(items, dict(zip(own.column("s").to_numpy().view(np.uint64).tolist(), own.column("n").to_pylist(), strict=True)), total)
        else:
            index = build_index(items)
        yield spark.sparkContext.broadcast(index)


def _placed_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        of, found = [], []
        for block, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            _, own = _item_shingles(text)
            if len(own):
                of.append(block)
                found.append(own)
        sizes = [len(x) for x in found]
        first = np.zeros(sum(sizes), dtype=bool)
        first[np.cumsum([0, *sizes[:-1]])[: len(sizes)]] = True
        values = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(of, np.int64), sizes)), pa.array(values), pa.array(first)], names=["block", "s", "is_first"])


def _texts(batch: pa.RecordBatch) -> list[str | None]:
    return batch.column(batch.schema.names.index("text")).to_pylist()


def _search(texts: list[str | None], index: dict, threshold: float) -> Iterator[tuple[int, dict]]:
    for a, b in W.chunks(texts):
        found, starts = W.hashed_words(texts[a:b], W.ALNUM, lower=True)
        for i in range(b - a):
            if best := find_items(found[starts[i] : starts[i + 1]], index, threshold):
                yield a + i, best


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Every (document, item) where some window of the item's size, or the whole of a shorter text, holds `threshold` of
    the item's shingle weight.

    Columns doc_id, item_id, similarity, hamming, first_word, n_words (of the best window, counting words of letters
    and digits, case folded). One row per document row and item; repeated rows each report their own. Null texts and
    texts without words hold nothing; null item ids and items without words are never found; items under five words
    count as one shingle. Other columns are ignored.
    """
    out = None
    for shared in _passes(benchmark):
        part = docs.select("doc_id", "text").mapInArrow(
            _finder(shared, threshold), "doc_id long, item_id long, similarity double, hamming int, first_word int, n_words int"
        )
        out = part if out is None else out.unionByName(part)
    return out


def _finder(shared: object, threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for i, best in _search(_texts(batch), shared.value, threshold):
                rows += [(ids[i], item, *what) for item, what in sorted(best.items())]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                names=["doc_id", "item_id", "similarity", "hamming", "first_word", "n_words"],
            )

    return run


def without_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of `docs`, with all columns, whose text holds no benchmark item; see `contaminated`."""
    for shared in _passes(benchmark):
        docs = docs.mapInArrow(_keeper(shared, threshold), docs.schema)
    return docs


def _keeper(shared: object, threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            for i, _ in _search(_texts(batch), shared.value, threshold):
                keep[i] = False
            yield batch.filter(pa.array(keep))
        W.give_back()

    return run

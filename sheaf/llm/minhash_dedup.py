"""Near-duplicate documents by Order MinHash, verified by banded alignment."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm import words as W
from sheaf.llm.graph import components
from sheaf.sources.scratch import written

SHINGLE = 5
#: A sketch is the ORDER smallest shingles under one hash function, in text order; a key joins PER_KEY sketches.
ORDER, PER_KEY, KEYS = 3, 2, 40
#: Below this size a table of node ids is sent to all workers; a larger one is joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Nodes of one bucket compared in one task; a larger bucket is cut into blocks, all pairs of which are compared.
BLOCK = 1024
#: Shingles taken together when a block counts what its nodes share.
COLUMNS = 4096

_ODD = np.random.default_rng(5).integers(1, 1 << 63, PER_KEY * KEYS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_RUN = 16


def labelled_shingles(found: np.ndarray) -> np.ndarray:
    """Shingle hashes, each joined with its occurrence number in the text."""
    own = W.shingles(found, SHINGLE)
    order = np.argsort(own, kind="stable")
    again = own[order][1:] == own[order][:-1]
    if again.any():
        place = np.arange(1, len(own) + 1)
        first = np.concatenate([[True], ~again])
        nth = np.empty(len(own), dtype=np.uint64)
        nth[order] = place - np.maximum.accumulate(np.where(first, place, 0))
        own = W.mix(own + nth * np.uint64(0xD6E8FEB86659FD93))
    return own


def sketch_keys(found: np.ndarray) -> np.ndarray:
    """The bucket keys of a text's words: none below SHINGLE words."""
    own = labelled_shingles(found)
    if not len(own):
        return np.zeros(0, np.int64)
    step = max(1, (4 << 20) // len(own))
    sketches = np.concatenate([_sketches(own, _ODD[a : a + step]) for a in range(0, len(_ODD), step)])
    joined = np.arange(KEYS, dtype=np.uint64)
    for part in sketches.reshape(KEYS, PER_KEY).T:
        joined = W.mix(joined * np.uint64(W.BASE) + part)
    return joined.view(np.int64)


def _sketches(own: np.ndarray, odd: np.ndarray) -> np.ndarray:
    n, m = len(own), len(odd)
    if n <= ORDER:
        places = np.broadcast_to(np.arange(n), (m, n))
    else:
        values = (own * odd[:, None]) >> np.uint64(32)
        if n > 8 * _RUN:  # the smallest values lie in the columns with the smallest minima
            columns = -(-n // _RUN)
            padded = np.full((m, _RUN * columns), 1 << 32, dtype=np.uint64)
            padded[:, :n] = values
            padded = padded.reshape(m, _RUN, columns)
            least = np.argpartition(padded.min(axis=1), ORDER - 1, axis=1)[:, :ORDER]
            few = np.take_along_axis(padded, least[:, None, :], axis=2).reshape(m, -1)
            at = np.argpartition(few, ORDER - 1, axis=1)[:, :ORDER]
            places = (at // ORDER) * columns + np.take_along_axis(least, at % ORDER, axis=1)
        else:
            places = np.argpartition(values, ORDER - 1, axis=1)[:, :ORDER]
        places = np.sort(places, axis=1)
    out = np.zeros(m, dtype=np.uint64)
    for column in places.T:
        out = out * np.uint64(W.BASE) + own[column]
    return W.mix(out)


def aligned_similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Shingles that an alignment of two word sequences matches, over all shingles of both; 0 if below `least`.

    The band is as wide as that similarity allows and no wider: with more edits it can't be reached.
    """
    na, nb = len(a) - SHINGLE + 1, len(b) - SHINGLE + 1
    if min(na, nb) < least * max(na, nb) or min(na, nb) < 1:
        return 0.0
    common = int(np.isin(W.shingles(a.astype(np.uint64), SHINGLE), W.shingles(b.astype(np.uint64), SHINGLE)).sum())
    if common < least * (na + nb - common):
        return 0.0
    matched = _matched_shingles(a, b, int((1 - least) / (1 + least) * (na + nb)) + 1)
    similarity = matched / (na + nb - matched)
    return similarity if similarity >= least else 0.0


def _matched_shingles(a: np.ndarray, b: np.ndarray, most_edits: int) -> int:
    """Shingles inside the matching runs of a shortest edit script of `most_edits` insertions and deletions at most."""
    n, m = len(a), len(b)
    same = a[: min(n, m)] == b[: min(n, m)]
    x = len(same) if same.all() else int(same.argmin())
    left, right = a.tolist(), b.tolist()
    reach, score = {0: x}, {0: max(0, x - SHINGLE + 1)}
    if x == n == m:
        return score[0]
    for d in range(1, most_edits + 1):
        for k in range(-d, d + 1, 2):
            down = k == -d or (k != d and reach.get(k - 1, -1) < reach.get(k + 1, -1))
            came = k + 1 if down else k - 1
            x = start = reach.get(came, -2) if down else reach.get(came, -2) + 1
            y = x - k
            if x < 0 or x > n or y > m:
                continue
            while x < n and y < m and left[x] == right[y]:
                x += 1
                y += 1
            reach[k], score[k] = x, score[came] + max(0, x - start - SHINGLE + 1)
            if x >= n and y >= m:
                return score[k]
    return 0


def _sequence_hashes(found: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sequences of words apart."""
    power = W._power_tables(len(found))[0][: len(found)]
    sums = [(x * power).sum(dtype=np.uint64) for x in (found, W.mix(found ^ np.uint64(0x94D049BB133111EB)))]
    one, two = W.mix(np.array(sums, dtype=np.uint64)).view(np.int64).tolist()
    return one, two


def _hash_columns(hashes: list[tuple[int, int] | None]) -> list[pa.Array]:
    return [pa.array([h[k] if h else None for h in hashes], pa.int64()) for k in range(2)]


def _each_text(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    return _each(batch.column(batch.schema.names.index("text")).to_pylist())


def _each(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    for a, b in W.chunks(texts):
        found, starts = W.hashed_words(texts[a:b], W.ALNUM, lower=True)
        for i in range(b - a):
            yield a + i, found[starts[i] : starts[i + 1]]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, keys = [], []
        for _, found in _each_text(batch):
            hashes.append(_sequence_hashes(found) if len(found) else None)
            keys.append(sketch_keys(found).tolist())
        yield pa.RecordBatch.from_arrays([batch.column(0), *_hash_columns(hashes), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "h1", "h2", "keys"])
    W.give_back()


def _word_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node, h1, h2 = (batch.column(k).to_pylist() for k in range(3))
        nodes, lists = [], []
        for i, found in _each_text(batch):
            if len(found) and _sequence_hashes(found) == (h1[i], h2[i]):
                nodes.append(node[i])
                lists.append((found >> np.uint64(32)).astype(np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(lists, pa.binary())], names=["node", "words"])


def _verifier(least: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if aligned_similarity(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), least):
                    rows.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(2)], names=["a", "b"])

    return run


def _sent_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def _linked(members: DataFrame, lists: DataFrame, least: float) -> DataFrame:
    """Components of the nodes of all buckets (members: key, node, n nodes of that key).

    Every node is compared with the first node of each of its buckets; most groups hang together by these links alone.
    Buckets that still hold several components are then compared whole, in blocks inside tasks, which report a
    spanning forest of what they link and never their pairs. So no link between components is lost.
    """
    first = members.groupBy("key").agg(F.min("node").alias("a"))
    pairs = members.join(written(first, "first"), "key").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    with_a = written(pairs, "pairs").join(lists.select(F.col("node").alias("a"), F.col("words").alias("x")), "a")
    with_b = with_a.join(lists.select(F.col("node").alias("b"), F.col("words").alias("y")), "b")
    links = written(with_b.select("a", "b", "x", "y").mapInArrow(_verifier(least), "a long, b long"), "links")
    of = components(links)
    placed = members.join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).where("_low < _high").select("key")
    left = written(placed.join(written(mixed, "open"), "key", "left_semi"), "left")
    more = written(_compared(left.join(lists, "node"), least), "more")
    return of if more.isEmpty() else components(links.union(more))


def _compared(left: DataFrame, least: float) -> DataFrame:
    blocks = F.ceil(F.col("n") / BLOCK)
    own = left.withColumn("own", F.pmod(F.xxhash64(F.lit("block"), "node"), blocks))
    spread = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    spread = spread.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    return spread.select("key", "i", "j", "own", "node", "component", "words").groupBy("key", "i", "j").applyInArrow(_comparer(least), "a long, b long")


def _shared_counts(lists: list[np.ndarray]) -> np.ndarray:
    """How many values each two lists share; a list holds a value once."""
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    values, at, n = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    several = n[at] > 1
    column = (np.cumsum(n > 1) - 1)[at[several]]
    row, order = row[several], np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(lists), len(lists)), dtype=np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        held = np.zeros((len(lists), COLUMNS), dtype=np.float32)
        held[row[a:b], column[a:b] - start] = 1
        out += held @ held.T
    return out


def _comparer(least: float) -> Callable:
    def run(group: pa.Table) -> pa.Table:
        words = [np.frombuffer(w, np.uint32) for w in group.column("words").to_pylist()]
        node, component, own = (group.column(c).to_numpy() for c in ("node", "component", "own"))
        lists = [labelled_shingles(w.astype(np.uint64)) for w in words]
        sizes = np.array([len(x) for x in lists])
        common = _shared_counts(lists)
        near = common >= least * (sizes[:, None] + sizes[None, :] - common)
        near &= component[:, None] != component[None, :]
        if group.column("i")[0].as_py() != group.column("j")[0].as_py():  # pairs within a block are compared where it meets itself
            near &= own[:, None] != own[None, :]
        links, parent = [], {int(c): int(c) for c in component}

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        for p, q in zip(*np.nonzero(np.triu(near)), strict=True):
            a, b = root(int(component[p])), root(int(component[q]))
            if a != b and aligned_similarity(words[p], words[q], least):
                parent[max(a, b)] = min(a, b)
                links.append((int(node[p]), int(node[q])))
        return pa.table([pa.array([x[k] for x in links], pa.int64()) for k in range(2)], names=["a", "b"])

    return run


def near_documents(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of its class), kept.

    Documents with the same words (letters and digits, case folded) are copies, one node, told apart by 128 bits of
    hash. Nodes link if the shingles of five words that an alignment matches are `least` or more of all shingles of
    both; classes are the connected components. Texts under five words have copies only; null texts and texts without
    words are classes of their own. kept marks the rows whose doc_id is the class_id. Null doc_ids and repeated rows are
    kept apart by nothing: equal rows get equal answers. Other columns are ignored; an empty table gives no rows.
    """
    with_class = _classed(docs, least)
    smallest = written(with_class.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("class_id")), "smallest")
    own = F.coalesce("class_id", "doc_id")
    return with_class.join(smallest, "component", "left").select("doc_id", own.alias("class_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def _classed(docs: DataFrame, least: float) -> DataFrame:
    """One row per document: doc_id, h1 and h2 (of its words) and component (all null without words)."""
    signed = written(docs.select("doc_id", "text").mapInArrow(_signatures, "doc_id long, h1 long, h2 long, keys array<long>"), "signatures")
    nodes = signed.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.any_value("keys").alias("keys"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    placed = nodes.select("node", F.explode("keys").alias("key"))
    shared = written(placed.groupBy("key").agg(F.count("node").alias("n")).where("n > 1"), "shared")
    members = written(placed.join(shared, "key"), "members")
    wanted = nodes.select("node", "h1", "h2", F.col("doc_id").alias("_id")).join(members.select("node").distinct(), "node", "left_semi")
    wanted = written(wanted, "wanted")
    candidates = docs.select("doc_id", "text").join(_sent_if_small(wanted, 32), F.col("doc_id").eqNullSafe(F.col("_id")))
    lists = written(candidates.select("node", "h1", "h2", "text").mapInArrow(_word_lists, "node long, words binary").dropDuplicates(["node"]), "words")
    of = _linked(members, lists, least)
    named = written(nodes.select("node", "h1", "h2").join(of, "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("component")), "named")
    return written(signed.select("doc_id", "h1", "h2").join(named, ["h1", "h2"], "left"), "classed")


def without_near_documents(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """The rows of `docs`, with all columns, one of each class of `near_documents`: that of the smallest doc_id.

    Classes are told apart by their component, so unlike texts with one doc_id, or with none, all stay. A null doc_id
    comes after the others; of a doc_id with several nodes in a class the one with the smallest hashes stays, and of
    repeated rows of that doc_id and node one. Null texts and texts without words stay.
    """
    rows = written(_classed(docs, least).where("h1 IS NOT NULL").groupBy("doc_id", "h1", "h2", "component").agg(F.count("h1").alias("n")), "decided")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "h1", "h2")
    chosen = rows.groupBy("component").agg(F.min(order).alias("first")).select("component", F.col("first.doc_id").alias("_least"), F.col("first.h1").alias("_f1"), F.col("first.h2").alias("_f2"))
    is_first = (F.col("h1") == F.col("_f1")) & (F.col("h2") == F.col("_f2")) & F.col("doc_id").eqNullSafe(F.col("_least"))
    decided = rows.join(written(chosen, "chosen"), "component").select(F.col("doc_id").alias("_id"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "n", is_first.alias("first"))
    dropped = written(decided.where("NOT first").select("_id", "_h1", "_h2"), "dropped")
    again = written(decided.where("first AND n > 1").select("_id", "_h1", "_h2"), "again")
    row = docs.select("doc_id", F.struct("*").alias("row"))
    wide = f"doc_id long, h1 long, h2 long, row {row.schema['row'].dataType.simpleString()}"
    noted = row.mapInArrow(_noted, wide)
    match = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
    stay = noted.join(_sent_if_small(dropped, 32), match, "left_anti")
    if again.isEmpty():
        return stay.select("row.*")
    again = _sent_if_small(again, 32)
    one = stay.join(again, match, "left_semi").dropDuplicates(["doc_id", "h1", "h2"])
    return stay.join(again, match, "left_anti").select("row.*").union(one.select("row.*"))


def _noted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = [_sequence_hashes(found) if len(found) else None for _, found in _each(batch.column(1).field("text").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *_hash_columns(hashes), batch.column(1)], names=["doc_id", "h1", "h2", "row"])
    W.give_back()

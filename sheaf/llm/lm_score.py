"""Language-model scores from a log-frequency Bloom filter of quantised bigram counts."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm import words as W
from sheaf.sources.scratch import written

#: Tokens that a task counts before it passes its counts on.
FLUSH = 3 << 19
#: Texts that are Python strings at a time.
ROWS = 256
#: Training text per bucket of n-grams: a bucket, its filter segment and its counts stay of bounded size.
BUCKET_BYTES = 8 << 20
#: A model up to this size is sent to all workers whole; beyond, texts' n-grams travel to the buckets.
BROADCAST_BYTES = 256 << 20
#: Bytes of the model, about, that come to the driver at a time.
PIECE_BYTES = 16 << 20
#: Probes of the first level and of each further one; a filter of 1 / ln 2 bits per probe errs upwards once in 2 to the
#: power of the probes.
PROBES, MORE_PROBES = 8, 6
#: Weight of the bigram estimate.
BIGRAM_WEIGHT = 0.6
MOST_LEVELS = 40

START, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
UNIGRAM, BIGRAM = 0, 1
#: Count that stands for each level, the least one it holds: level q holds counts from 2^(q-1) to 2^q - 1. Counts between
#: powers of two are drawn to one of them before, see `rounded`.
_LEVEL_COUNTS = np.array([0, *(1 << (q - 1) for q in range(1, MOST_LEVELS))], dtype=np.int64)
#: What the filter reads, on average, for a held count of 1, and for an absent n-gram: false levels double the count.
READ_HELD = 1 + 2.0**-MORE_PROBES / (1 - 2 * 2.0**-MORE_PROBES)
READ_ABSENT = 2.0**-PROBES * READ_HELD


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's words and then its end; and where each text begins."""
    found, starts = W.hashed_words(texts, W.SPACED)
    n = len(texts)
    out = np.insert(found, starts[1:], END) if n else found
    return out, starts + np.arange(n + 1)


def bigrams(found: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token the one before it, or START, and the hash of both."""
    before = np.roll(found, 1)
    before[starts[:-1]] = START
    return before, W.mix(before * np.uint64(W.BASE) + found)


def _bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def _counted(hashes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        return np.unique(hashes, return_counts=True)
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    return ordered[first], np.add.reduceat(counts[order], first) if len(first) else counts


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Few texts at a time become Python strings; memory that is freed goes back to the system after each batch."""
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            yield batch.slice(a, ROWS)
        W.give_back()


def _counter(bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.empty((2, FLUSH), dtype=np.uint64), 0
        for batch in _slices(batches):
            texts = batch.column(0).to_pylist()
            for a, b in W.chunks(texts):
                found, starts = tokens(texts[a:b])
                pairs = bigrams(found, starts)[1]
                for k in range(0, len(found), FLUSH):  # a text may be longer than a flush
                    size = len(found[k : k + FLUSH])
                    if n + size > FLUSH:
                        yield from _parts(held[:, :n], bits)
                        n = 0
                    held[:, n : n + size] = found[k : k + FLUSH], pairs[k : k + FLUSH]
                    n += size
        yield from _parts(held[:, :n], bits)
        del held
        W.give_back()

    return run


_PART = {"kind": pa.int32(), "bucket": pa.int64(), "hashes": pa.binary(), "counts": pa.binary()}
_SEGMENT = {"kind": pa.int32(), "bucket": pa.int64(), "size": pa.int64(), "total": pa.int64(), "hashes": pa.binary(), "counts": pa.binary()}
_PART_SQL, _SEGMENT_SQL = (", ".join(f"{c} {'int' if t == pa.int32() else 'long' if t == pa.int64() else 'binary'}" for c, t in of.items()) for of in (_PART, _SEGMENT))


def _rows(rows: list[tuple], of: dict) -> list[pa.Array]:
    return [pa.array([r[k] for r in rows], t) for k, t in enumerate(of.values())]


def _by_bucket(hashes: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """The buckets that sorted hashes fall into, each with its range."""
    buckets = _bucket(hashes, bits)
    if not len(buckets):
        return iter(())
    edges = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
    return zip(buckets[edges].tolist(), edges.tolist(), [*edges[1:].tolist(), len(buckets)], strict=True)


def _parts(held: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    for kind, found in ((UNIGRAM, held[0]), (BIGRAM, held[1])):
        hashes, counts = _counted(found)
        counts = counts.astype(np.uint32)
        rows = [(kind, k, hashes[a:b].tobytes(), counts[a:b].tobytes()) for k, a, b in _by_bucket(hashes, bits)]
        yield pa.RecordBatch.from_arrays(_rows(rows, _PART), names=list(_PART))


def _joined(group: pa.Table, column: str, kind: type) -> np.ndarray:
    parts = [np.frombuffer(x.as_buffer(), kind) for x in group.column(column)]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _segment(group: pa.Table) -> pa.Table:
    """All counts of one bucket: of unigrams in full, of bigrams as a filter (bits in `hashes`)."""
    hashes, counts = _counted(_joined(group, "hashes", np.uint64), _joined(group, "counts", np.uint32).astype(np.int64))
    kind, bucket = (group.column(c)[0].as_py() for c in ("kind", "bucket"))
    body = (hashes.tobytes(), counts.tobytes()) if kind == UNIGRAM else (_filter(hashes, rounded(hashes, counts)), b"")
    return pa.table(_rows([(kind, bucket, len(hashes), int(counts.sum()), *body)], _SEGMENT), names=list(_SEGMENT))


def rounded(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts drawn, by their n-gram's hash, to the power of two below or above, such that they are right on average."""
    low = _LEVEL_COUNTS[levels_of(counts)]
    share = (W.mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(11)).astype(np.float64) / 2.0**53
    return np.where(share * low < counts - low, 2 * low, low)


def _places(hashes: np.ndarray, level: int, probe: int, size: np.ndarray) -> np.ndarray:
    """The bit of one probe for one level, in a filter of `size` bits."""
    h = W.mix(hashes + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64)))
    return ((h + np.uint64(probe) * ((h >> np.uint64(32)) | np.uint64(1))) % size).astype(np.int64)


def _probes(level: int) -> int:
    return PROBES if level == 1 else MORE_PROBES


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(counts.astype(np.float64))[1], MOST_LEVELS - 1)


def _filter(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """A Bloom filter that holds (n-gram, j) for all levels j up to that of the n-gram's count."""
    levels = levels_of(counts)
    set_bits = int((PROBES * (levels > 0) + MORE_PROBES * np.maximum(levels - 1, 0)).sum())
    size = 64 * max(1, math.ceil(set_bits / math.log(2) / 64))
    bits = np.zeros(size, dtype=bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        held = hashes[levels >= level]
        for probe in range(_probes(level)):
            bits[_places(held, level, probe, np.uint64(size))] = True
    return np.packbits(bits).tobytes()


def _probed(hashes: np.ndarray, bits: np.ndarray, offset: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The level of each n-gram: so many levels in turn have all their bits set. offset, size: of its bucket's filter."""
    levels, live = np.zeros(len(hashes), dtype=np.int64), np.arange(len(hashes))
    for level in range(1, MOST_LEVELS):
        for probe in range(_probes(level)):
            at = offset[live] + _places(hashes[live], level, probe, size[live])
            live = live[(bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1]
            if not len(live):
                return levels
        levels[live] = level
    return levels


def train(docs: DataFrame) -> DataFrame:
    """The model of the texts of `docs`, one row per kind and bucket of n-grams (see `_segment`)."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    bits = max(0, math.ceil(math.log2(max(1, size / BUCKET_BYTES))))
    parts = docs.select("text").mapInArrow(_counter(bits), _PART_SQL)
    return written(parts.groupBy("kind", "bucket").applyInArrow(_segment, _SEGMENT_SQL), "lm")


def _looked_up(sorted_hashes: np.ndarray, values: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    if not len(sorted_hashes):
        return np.zeros(len(hashes), dtype=np.int64)
    at = np.minimum(np.searchsorted(sorted_hashes, hashes), len(sorted_hashes) - 1)
    return np.where(sorted_hashes[at] == hashes, values[at], 0)


def _scores(texts: list[str | None], totals: tuple[int, int, int], count_of: Callable, level_of: Callable) -> list[np.ndarray]:
    """n_tokens, n_known, base score and score of each text. totals: N, V and training texts."""
    n, v, n_texts = totals
    found, starts = tokens(texts)
    pairs = bigrams(found, starts)[1]
    words, word_of = np.unique(found, return_inverse=True)
    counts = count_of(words)[word_of]
    kinds, pair_of = np.unique(pairs, return_inverse=True)
    first = np.roll(counts, 1)
    first[starts[:-1]] = n_texts
    alone = (counts + 0.5) / (n + 0.5 * (v + 1))
    full = probability(alone, _LEVEL_COUNTS[level_of(kinds)][pair_of], first, v)
    each = lambda values: np.add.reduceat(values, starts[:-1])
    return [np.diff(starts), each((counts > 0).astype(np.int64)), each(np.log10(alone)), each(np.log10(full))]


def probability(alone: np.ndarray, together: np.ndarray, first: np.ndarray, v: int) -> np.ndarray:
    """Of words with unigram probability `alone` behind a history of count `first`, with `together` read in the filter.

    What the filter reads behind a history, over all v words and the unknown one, false levels included, is
    READ_HELD * first + READ_ABSENT * (v + 1) on average: counts are rounded without bias. The bigram part is a share of
    that, and the back-off weight is what it leaves. So the probabilities behind a history sum to one, up to chance in
    the rounding and in the filter's errors; and a rare history, behind which a hit says little, leaves more to the
    unigrams.
    """
    noise = READ_ABSENT * (v + 1)
    mass = np.maximum(first, 1) + noise
    left = 1 - BIGRAM_WEIGHT * (READ_HELD * first + noise) / mass
    return np.where(first > 0, BIGRAM_WEIGHT * together / mass + left * alone, alone)


def score(docs: DataFrame, model: DataFrame, n_texts: int) -> DataFrame:
    """Columns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, for rows of doc_id, held_out, text.

    Tokens are words between white space, A-Z lower-cased, and each text's end; a null text is empty. base_score is
    the additively smoothed unigram log10 probability, from exact counts. score is the log10 probability with bigrams:
    see `probability`, on counts quantised in the filter and read by repeated membership probes. Tokens are told apart by 64-bit hashes. Texts of any length
    count whole; repeated rows each get their row; other columns are ignored.
    """
    sizes = {r["kind"]: r for r in model.groupBy("kind").agg(F.sum("size").alias("v"), F.sum("total").alias("n"), F.sum(F.length("hashes") + F.length("counts")).alias("bytes")).collect()}
    singles = sizes.get(UNIGRAM)
    totals = (int(singles["n"]), int(singles["v"]), n_texts) if singles else (0, 0, 0)
    rows = docs.select("doc_id", "held_out", "text")
    size = sum(r["bytes"] for r in sizes.values())
    if size <= BROADCAST_BYTES:
        shared = docs.sparkSession.sparkContext.broadcast(_assembled(model, size))
        scored = written(rows.mapInArrow(_scorer(shared, totals), _SCORED), "scored")
        shared.destroy()  # or every run would leave its model in all workers
        return scored
    return _scored_by_buckets(rows, model, totals)


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _assembled(model: DataFrame, size: int) -> dict:
    """The model as plain arrays. It comes in pieces of some buckets, which go as they are joined."""
    n = 1 << int(model.agg(F.coalesce(F.max("bucket"), F.lit(0))).first()[0]).bit_length()
    pieces = min(n, math.ceil(size / PIECE_BYTES)) or 1
    sizes, offsets = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.int64)
    parts: dict[str, list[np.ndarray]] = {c: [] for c in ("hashes", "counts", "bits")}
    for k in range(pieces):
        got = model.where(F.col("bucket").between(k * n // pieces, (k + 1) * n // pieces - 1)).toArrow().sort_by("bucket")
        single, pair = (got.filter(pa.array(got.column("kind").to_numpy() == kind)) for kind in (UNIGRAM, BIGRAM))
        sizes[pair.column("bucket").to_numpy()] = [8 * len(x.as_buffer()) for x in pair.column("hashes")]
        parts["bits"].append(_joined(pair, "hashes", np.uint8))
        parts["hashes"].append(_joined(single, "hashes", np.uint64))
        parts["counts"].append(_joined(single, "counts", np.int64))
    offsets[1:] = np.cumsum(sizes)[:-1]
    whole = {c: np.concatenate(parts.pop(c)) for c in list(parts)}
    if whole["counts"].max(initial=0) < 1 << 32:
        whole["counts"] = whole["counts"].astype(np.uint32)
    return whole | {"sizes": sizes, "offsets": offsets}


def _level_lookup(model: dict) -> Callable:
    width = len(model["sizes"]).bit_length() - 1

    def level_of(hashes: np.ndarray) -> np.ndarray:
        bucket, out = _bucket(hashes, width), np.zeros(len(hashes), dtype=np.int64)
        there = np.flatnonzero(model["sizes"][bucket] > 0)
        out[there] = _probed(hashes[there], model["bits"], model["offsets"][bucket[there]], model["sizes"][bucket[there]])
        return out

    return level_of


def _scored_batch(batch: pa.RecordBatch, totals: tuple[int, int, int], count_of: Callable, level_of: Callable) -> Iterator[pa.RecordBatch]:
    texts = batch.column(batch.schema.names.index("text")).to_pylist()
    for a, b in W.chunks(texts):
        n_tokens, n_known, base, full = _scores(texts[a:b], totals, count_of, level_of)
        columns = [batch.column(k).slice(a, b - a) for k in range(2)]
        columns += [pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array([totals[0]] * (b - a), pa.int64()), pa.array(base), pa.array(full)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def _scorer(shared: object, totals: tuple[int, int, int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        level_of = _level_lookup(model)
        for batch in _slices(batches):
            yield from _scored_batch(batch, totals, lambda h: _looked_up(model["hashes"], model["counts"], h), level_of)

    return run


def _scored_by_buckets(rows: DataFrame, model: DataFrame, totals: tuple[int, int, int]) -> DataFrame:
    """As by a broadcast model, without one: each chunk of texts asks the buckets for the n-grams it holds.

    Chunks and buckets are of bounded size and grow in number with the texts.
    """
    widest = model.agg(F.max("bucket")).first()[0] or 0
    width = int(widest).bit_length()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, math.ceil(size / BUCKET_BYTES))))
    placed = rows.withColumn("chunk", chunk)

    def asked(group: pa.Table) -> pa.Table:
        found, starts = tokens(group.column("text").to_pylist())
        out, chunk = [], group.column("chunk")[0].as_py()
        for kind, hashes in ((UNIGRAM, found), (BIGRAM, bigrams(found, starts)[1])):
            own = np.unique(hashes)
            out += [(kind, k, chunk, own[a:b].tobytes()) for k, a, b in _by_bucket(own, width)]
        return pa.table(_rows(out, _ASKED), names=list(_ASKED))

    def answered(questions: pa.Table, segment: pa.Table) -> pa.Table:
        out = []
        body, counts = (segment.column(c)[0].as_py() if segment.num_rows else b"" for c in ("hashes", "counts"))
        for kind, chunk, blob in zip(*(questions.column(c).to_pylist() for c in ("kind", "chunk", "asked")), strict=True):
            hashes = np.frombuffer(blob, np.uint64)
            got = np.zeros(len(hashes), np.int64)
            if body and kind == UNIGRAM:
                got = _looked_up(np.frombuffer(body, np.uint64), np.frombuffer(counts, np.int64), hashes)
            elif body:
                all_of = np.full(len(hashes), 8 * len(body), dtype=np.uint64)
                got = _probed(hashes, np.frombuffer(body, np.uint8), np.zeros(len(hashes), np.int64), all_of)
            out.append((kind, chunk, blob, got.astype(np.int64).tobytes()))
        return pa.table(_rows(out, _ANSWER), names=list(_ANSWER))

    def scored(texts: pa.Table, answers: pa.Table) -> pa.Table:
        kinds, tables = answers.column("kind").to_numpy(), {}
        for kind in (UNIGRAM, BIGRAM):
            own = answers.filter(pa.array(kinds == kind))
            hashes, got = _joined(own, "asked", np.uint64), _joined(own, "got", np.int64)
            order = np.argsort(hashes)
            tables[kind] = (hashes[order], got[order])
        batches = texts.select(["doc_id", "held_out", "text"]).combine_chunks().to_batches()
        return pa.Table.from_batches([r for b in batches for r in _scored_batch(b, totals, lambda h: _looked_up(*tables[UNIGRAM], h), lambda h: _looked_up(*tables[BIGRAM], h))])

    questions = placed.groupBy("chunk").applyInArrow(asked, "kind int, bucket long, chunk long, asked binary")
    answers = questions.groupBy("kind", "bucket").cogroup(model.groupBy("kind", "bucket")).applyInArrow(answered, "kind int, chunk long, asked binary, got binary")
    return placed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(scored, _SCORED)


_ASKED = {"kind": pa.int32(), "bucket": pa.int64(), "chunk": pa.int64(), "asked": pa.binary()}
_ANSWER = {"kind": pa.int32(), "chunk": pa.int64(), "asked": pa.binary(), "got": pa.binary()}


def train_and_score(docs: DataFrame, held_out: Column) -> DataFrame:
    """Learns from the rows that are not held out and scores all; see `train` and `score`.

    Null texts are empty ones, in training too; repeated rows count each. Without training rows every probability is 1.
    """
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    learnt = rows.where("NOT held_out")
    return score(rows, train(learnt), learnt.count())

"""Language identification by the nearest of several centroids per language, over TF-IDF letter n-grams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm import words as W

#: Hashed n-gram features, for runs of 1 to 3 bytes of lower-cased letters with one space between words.
FEATURES = 2048
#: Most labelled texts that centroids and thresholds are fitted on; document frequencies cover all labelled texts.
SAMPLE = 2000
CENTROIDS = 4
#: A text is rejected if its similarity is below this share of what nearly all sample texts of its length reach.
REJECT_SHARE = 0.5
UNDETERMINED = "und"

_LETTER = regex.compile(r"\p{L}")
_CODES = np.arange(256)
_LOWER = np.where((_CODES >= 65) & (_CODES <= 90), _CODES + 32, _CODES)
_BYTES = np.where(((_LOWER >= 97) & (_LOWER <= 122)) | (_CODES >= 128), _LOWER, 32).astype(np.uint8)
_LENGTH_STEPS = 20


#: A fitted model, of plain lists and arrays, so that workers without this package can hold it: languages, owner (of
#: each centroid), centroids, idf, and least (similarity below which a text is rejected, by length step).
Model = dict


def term_counts(texts: list[str | None]) -> np.ndarray:
    """Counts of the hashed n-grams of each whole text."""
    out = np.zeros((len(texts), FEATURES), dtype=np.float32)
    for a, b in W.chunks(texts):
        raw = [b" " + t.lower().encode("utf-8", "surrogatepass") + b" " if t else b"  " for t in texts[a:b]]
        values = _BYTES[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        row = np.repeat(np.arange(len(raw)), np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)))
        keep = np.ones(len(values), dtype=bool)
        keep[1:] = (values[1:] != 32) | (values[:-1] != 32) | (row[1:] != row[:-1])
        values, row = values[keep].astype(np.uint32), row[keep]
        gram = np.zeros(len(values), dtype=np.uint32)
        for n in range(3):  # the run of n + 1 bytes that begins here
            gram = gram[: len(values) - n] * np.uint32(0x01000193) + values[n:] + np.uint32(1)
            first = row[: len(gram)]
            whole = first == row[n:]
            slot = ((gram * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.int64) % FEATURES
            counts = np.bincount((first * FEATURES + slot)[whole], minlength=len(raw) * FEATURES)
            out[a:b] += counts.reshape(len(raw), FEATURES).astype(np.float32)
    return out


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weighed = np.log1p(counts)
    weighed *= idf
    norm = np.linalg.norm(weighed, axis=1, keepdims=True)
    weighed /= np.where(norm > 0, norm, 1)
    return weighed


def _length_step(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(counts.sum(axis=1) + 1).astype(int), _LENGTH_STEPS - 1)


def _clustered(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from spread-out starts; empty clusters keep their place."""
    chosen = [int(np.argmax(vectors @ vectors.mean(axis=0)))]
    nearest = vectors @ vectors[chosen[0]]
    while len(chosen) < min(k, len(vectors)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, vectors @ vectors[chosen[-1]])
    centres = vectors[chosen].copy()
    for _ in range(rounds):
        own = np.argmax(vectors @ centres.T, axis=1)
        for c in range(len(centres)):
            if (own == c).any():
                mean = vectors[own == c].mean(axis=0)
                centres[c] = mean / max(float(np.linalg.norm(mean)), 1e-12)
    return centres


def fit(labelled: DataFrame, order: Column, sample: int = SAMPLE) -> Model | None:
    """Fits on columns text and lang; None if there is no text with a language.

    Document frequencies come from all labelled texts. Centroids and rejection thresholds come from about `sample`
    texts, shared evenly among the languages, with the smallest values of `order`, which must spread evenly over all
    long integers; rows with the same value, as repeated rows have, count once among them. The driver gets their counts
    as bytes. Empty texts and texts without letters count as texts without n-grams.
    """
    spark = labelled.sparkSession
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang", order.alias("_order"))
    frequency = rows.select("text").mapInArrow(_document_frequency, "n long, df array<double>")
    summed = frequency.select("n", F.posexplode("df")).groupBy("pos").agg(F.sum("n").alias("n"), F.sum("col").alias("df")).collect()
    if not summed:
        return None
    df = np.zeros(FEATURES)
    df[[r["pos"] for r in summed]] = [r["df"] for r in summed]
    idf = np.log((1 + summed[0]["n"]) / (1 + df)).astype(np.float32) + 1
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    each = max(1, sample // len(sizes))
    part = F.lit(0.0)
    for lang, n in sorted(sizes.items()):
        part = F.when(F.col("lang") == lang, min(1.0, each / n)).otherwise(part)
    chosen = rows.where(F.col("_order").cast("double") + 2.0**63 <= part * 2.0**64).dropDuplicates(["_order"])
    got = chosen.select("text", "lang").mapInArrow(_sample_counts, "lang string, counts binary").toArrow()
    if not got.num_rows:
        return None
    counts = np.stack([np.frombuffer(x, dtype=np.float32) for x in got.column("counts").to_pylist()])
    langs = np.array(got.column("lang").to_pylist())
    by_content = np.lexsort((*(counts[:, k] for k in range(8)), counts.sum(axis=1), langs))  # any partitioning, one model
    return _model(counts[by_content], langs[by_content], idf)


def _model(counts: np.ndarray, langs: np.ndarray, idf: np.ndarray) -> Model:
    vectors, languages = _vectors(counts, idf), sorted(set(langs.tolist()))
    clusters = [_clustered(vectors[langs == lang], CENTROIDS) for lang in languages]
    centroids = np.concatenate(clusters)
    owner = np.repeat(np.arange(len(languages)), [len(c) for c in clusters])
    best = (vectors @ centroids.T).max(axis=1)
    step = _length_step(counts)
    least = np.zeros(_LENGTH_STEPS, dtype=np.float32)
    for s in range(_LENGTH_STEPS):
        near = best[np.abs(step - s) <= 1]
        least[s] = REJECT_SHARE * np.quantile(near, 0.01) if len(near) >= 20 else (least[s - 1] if s else 0)
    return {"languages": languages, "owner": owner, "centroids": centroids.astype(np.float32), "idf": idf, "least": least}


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, df = 0, np.zeros(FEATURES)
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for a in range(0, len(texts), 500):
            df += (term_counts(texts[a : a + 500]) > 0).sum(axis=0)
        n += len(texts)
    W.give_back()
    if n:
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "df": pa.array([df.tolist()], pa.list_(pa.float64()))})


def _sample_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for a in range(0, len(texts), 500):
            rows = [r.tobytes() for r in term_counts(texts[a : a + 500])]
            yield pa.RecordBatch.from_pydict({"lang": batch.column(1).slice(a, 500), "counts": pa.array(rows, pa.binary())})


def predict(texts: list[str | None], model: Model | None) -> tuple[list[str], list[float], list[bool]]:
    """Language, similarity to its nearest centroid, and whether the text is rejected as too far from all of them."""
    langs, scores, rejected = [UNDETERMINED] * len(texts), [0.0] * len(texts), [True] * len(texts)
    known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if model else []
    for a in range(0, len(known), 500):
        part = known[a : a + 500]
        counts = term_counts([texts[i] for i in part])
        similarity = _vectors(counts, model["idf"]) @ model["centroids"].T
        nearest = similarity.argmax(axis=1)
        best = similarity[np.arange(len(part)), nearest]
        for i, c, s, far in zip(part, nearest, best, best < model["least"][_length_step(counts)], strict=True):
            langs[i], scores[i], rejected[i] = model["languages"][model["owner"][c]], min(1.0, max(0.0, float(s))), bool(far)
    return langs, scores, rejected


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of `docs` and lang_pred, score (0 to 1) and rejected (which replace columns of those names).

    A text that is null or has no letter is `und`, with score 0, rejected; so is every text if there is no model.
    Prediction reads the text alone; whole texts of any length count. Ties go to the language first in order.
    """
    kept = docs.select(*(c for c in docs.columns if c.lower() not in ("lang_pred", "score", "rejected")))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(_labeller(shared), f"{kinds}, lang_pred string, score double, rejected boolean")


def _labeller(shared: object) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, rejected = predict(batch.column(batch.schema.names.index("text")).to_pylist(), shared.value)
            out = batch.append_column("lang_pred", pa.array(langs, pa.string()))
            yield out.append_column("score", pa.array(scores, pa.float64())).append_column("rejected", pa.array(rejected, pa.bool_()))

    return run


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of `docs`, with its columns, that are not rejected.

    Null texts, texts without a letter and, if there is no model, all texts are rejected. Repeated rows fare alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, rejected = predict(batch.column(batch.schema.names.index("text")).to_pylist(), shared.value)
            yield batch.filter(pa.array([not r for r in rejected], pa.bool_()))
        W.give_back()

    return docs.mapInArrow(run, docs.schema)

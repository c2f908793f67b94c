"""Words of many texts at once, as 64-bit hashes, by array operations on bytes."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes taken together in one array step; a longer text is still taken whole.
CHUNK = 1 << 19

_RNG = np.random.default_rng(7)
#: A random odd number for each byte, and the base of the polynomial, odd and so invertible modulo 2^64.
BYTE_VALUES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _table(is_word: np.ndarray) -> np.ndarray:
    """Byte values with A-Z folded to a-z, and 0 for bytes outside words."""
    codes = np.arange(256)
    folded = np.where((codes >= 65) & (codes <= 90), codes + 32, codes)
    return np.where(is_word, BYTE_VALUES[folded], np.uint64(0))


_CODES = np.arange(256)
#: Words between white space (space, tab to carriage return), A-Z lower-cased.
SPACED = _table(~((_CODES == 32) | ((_CODES >= 9) & (_CODES <= 13))))
#: Runs of ASCII letters and digits and of any other characters beyond ASCII; punctuation parts words.
ALNUM = _table(((_CODES >= 48) & (_CODES <= 57)) | ((_CODES >= 65) & (_CODES <= 90)) | ((_CODES >= 97) & (_CODES <= 122)) | (_CODES >= 128))


class _Local(dict):
    """A cache that stays in its process: functions that are sent to workers take it along empty."""

    def __reduce__(self) -> tuple:
        return _Local, ()


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = _Local()


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, int(n - 1).bit_length())
    if size not in _powers:
        if len(_powers) > 1:  # beside the usual size, keep one of the larger ones
            _powers.pop(max(_powers))
        both = []
        for base in (BASE, INVERSE):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _powers[size] = (both[0], both[1])
    return _powers[size]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def hashed_words(texts: list[str | None], table: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and for each text where its words begin (one more at the end).

    lower: fold the case of all letters, not A-Z alone.
    """
    raw = [(t.lower() if lower else t).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    values = table[np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)]
    inside = np.empty(len(values) + 1, dtype=bool)
    inside[0] = False
    np.not_equal(values, 0, out=inside[1:])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edges[::2], edges[1::2]
    power, inverse = _power_tables(len(values))
    values *= power[: len(values)]
    sums = np.cumsum(values, out=values)
    before = np.where(begin > 0, sums[begin - 1], np.uint64(0)) if len(begin) else np.zeros(0, np.uint64)
    hashes = mix((sums[end - 1] - before) * inverse[begin]) if len(begin) else np.zeros(0, np.uint64)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    return hashes, np.searchsorted(begin, starts)


def give_back() -> None:
    """Freed memory returns to the system, as far as the C library can do that: an idle worker holds little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def chunks(texts: list[str | None], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` characters each."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1 if t else 1
        if size >= limit:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n neighbouring words; run i begins at word i. Fewer than n words give none."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(BASE) + words[k : len(words) - n + 1 + k]
    return mix(out)

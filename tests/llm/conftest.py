"""Awkward documents for all operators."""

from __future__ import annotations

import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "re", "so") for b in ("ran", "del", "tis", "mor", "ven", "lup")]
    return " ".join(rng.choice(vocabulary) + rng.choice(("", "", "", "s", "ed")) for _ in range(words)) + "."


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in any column, empty, blank, odd and very long texts, ties and repeated rows, a clashing extra column."""
    rows = [
        (1, prose(1, 120), "en", "b", 5), (2, prose(2, 80), None, "a", None), (3, None, "en", "a", None), (4, "", "en", None, 0),
        (5, " \n\t ", "de", "a", 3), (6, "12345 --- 678", "de", "b", 9), (7, prose(3, 30_000), "en", "b", 1), (None, prose(4, 50), "en", "c", 1),
        (8, prose(1, 120), "en", None, 5), (9, prose(5, 60), "en", "c", 1), (9, prose(5, 60), "en", "c", 1), (None, None, None, None, None),
        (10, "one two", "en", "c", 7), (11, "\U0001f600 éè \\ [INST] </s>", "fr", "c", 7),
    ]
    return spark.createDataFrame([(*r, f"x{k}") for k, r in enumerate(rows)], DOCUMENTS + ", _row string")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)

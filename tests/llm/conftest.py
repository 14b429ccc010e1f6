"""Small tables for the operators of this subpackage."""

from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int, prefix: str = "w") -> list[str]:
    return [f"{prefix}{rng.randrange(400)}" for _ in range(n)]


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    """Documents with every awkward case: nulls, empty and long texts, copies, near copies, shared passages,
    repeated rows and ids, words in one script and another."""
    rng = random.Random(5)
    passage = " ".join(words(rng, 90, "p"))
    base = words(rng, 220)
    out: list[tuple] = [(1, None, None, None), (2, "", "en", "a"), (3, "   \n\t ", "en", "a"), (4, "one two", "en", "b"), (5, "one two", "en", "b"), (6, "A", "en", None)]
    out += [(10 + k, " ".join(words(rng, 150)) + " " + passage + " " + " ".join(words(rng, 60)), "en", "ab"[k % 2]) for k in range(5)]
    for k in range(12):
        copy = list(base)
        for _ in range(k % 4):
            copy[rng.randrange(len(copy))] = f"edit{k}"
        out.append((30 + k, " ".join(copy), "de", "b"))
    out += [(50, " ".join(base), "de", "b"), (50, " ".join(base), "de", "b"), (50, "other text under the same id", "de", "b"), (None, " ".join(base), "de", "c"), (None, passage, None, "c")]
    out += [(60, "x" * 3000, "en", "c"), (61, "é" * 900 + "x" * 500, "fr", "c"), (62, "naïve café " * 120, "fr", "c"), (63, "Was " * 300, "en", "c"), (64, " ".join(words(rng, 8000)), "en", "c")]
    return [(i, t, lang, source, len(t) if t is not None else None) for i, t, lang, source in out]


@pytest.fixture
def docs(spark, rows):
    """The rows with columns whose names clash with outputs and working columns."""
    from pyspark.sql import functions as F

    names = ("kid", "kh", "n", "score", "size", "label", "start", "spans", "h", "token", "node", "copies", "target")
    return spark.createDataFrame(rows, DOCS).repartition(3).withColumns({c: F.lit(7) for c in names})


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)

"""Ranked search held against direct scoring of every document."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import lexical_blocks as lb

SMALL = lb.Search(depth=5, group=16, clusters=6, seeds=8)


def by_hand(rows, items, depth):
    docs = [(i, Counter(lb._TERM.findall((t or "").translate(lb._LOWER)))) for i, t in rows]
    docs = [(i, c) for i, c in docs if c]
    total, length = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in docs:
            m = 50 + (50 * sum(c.values()) * total) // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in lb.terms_of(text) if t in c)
            if s > 0:
                scored.append((-s, i is not None, i or 0, i))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scored)[:depth])]
    return sorted(out, key=str)


def got(spark, rows, items, how):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, rid int, score int").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in lb.ranked(docs, asked, how).select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = [f"t{k}" for k in range(120)]
    weights = [1 / (k + 1) for k in range(120)]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(1, 60)))) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)]  # a third are copies
    rows += [(None, rows[7][1]), (None, "t5 T5, été"), (5, None), (6, ""), (7, " .,- "), (9, "t50 " * 4000), (9, "t50 " * 4000)]
    items = [(k, " ".join(rng.choices(words, k=rng.randrange(1, 15)))) for k in range(12)]
    items += [(20, rows[7][1]), (20, rows[7][1]), (21, None), (22, "unheard words"), (23, ""), (None, "T5 ÉTÉ été"), (24, "t0"), (25, "t50")]
    return rows, items


@pytest.mark.parametrize("how", [SMALL, lb.Search(depth=5, group=16, clusters=6, batch_bytes=150, wide=3)], ids=["one batch", "batches"])
def test_equal_to_scoring_everything(spark, corpus, how):
    rows, items = corpus
    assert got(spark, rows, items, how) == by_hand(rows, items, 5)


def test_blocks_are_skipped(spark, corpus):
    """Topics stand apart, so lists fall into blocks of which a query opens few; ranks don't change."""
    rng = random.Random(4)
    rows = []
    for i in range(600):
        topic = i % 12
        rows.append((i, " ".join([f"c{rng.randrange(15)}" for _ in range(12)] + [f"x{topic}y{rng.randrange(25)}" for _ in range(12)])))
    items = [(k, " ".join([f"c{j}" for j in range(6)] + [f"x{k}y{j}" for j in range(0, 25, 2)])) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    how = lb.Search(depth=5, group=32, clusters=24, seeds=20)
    found = lb.search_batch(docs, items, how)
    assert sorted((tuple(r) for r in found.ranks.collect()), key=str) == by_hand(rows, items, 5)
    assert found.asked > 200 and found.skipped > 0.25 * found.asked


def test_empty_tables(spark, corpus, empty):
    rows, items = corpus
    assert got(spark, [], items, SMALL) == []
    assert got(spark, rows, [], SMALL) == []
    docs = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    assert lb.ranked(docs, spark.createDataFrame(items, "item_id long, text string"), SMALL).collect() == []


def test_no_entry_is_left_out():
    """Terms outside the entries can't reach the threshold together; the entries are no more than that asks for."""
    rng = np.random.default_rng(1)
    batch = lb.Batch([" ".join(f"w{k}" for k in rng.integers(0, 50, 12)) for _ in range(40)])
    peaks = rng.integers(0, 100, batch.size)
    thresholds = rng.integers(1, 400, 40)
    for q, threshold, inside in zip(batch.queries, thresholds, lb.entries(batch, thresholds, peaks), strict=True):
        rest = peaks[np.setdiff1d(q, inside)]
        assert rest.sum() < threshold
        if len(inside):
            assert rest.sum() + peaks[inside].min() >= threshold

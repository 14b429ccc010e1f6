"""Op 10 against brute force over every window, wherever its shingles stand in the item."""

from __future__ import annotations

import random
from collections import Counter

from tessera.llm import simhash_decontam


def every_window(docs, items, words=5, least=0.8):
    """(document, item) to its best similarity, and the starts of the windows that have it."""
    out = {}
    for i, text in docs:
        w = text.split()
        for item, said in items:
            v = said.split()
            k = min(words, len(v))
            counted = lambda x: Counter(tuple(x[a : a + min(words, len(x))]) for a in range(len(x) - min(words, len(x)) + 1))
            want = counted(v)
            for start in range(k - len(v), len(w) - k + 1):
                have = counted(w[max(start, 0) : start + len(v)])
                lesser = sum((have & want).values())
                s = round(lesser / (have.total() + want.total() - lesser), 6)
                if s >= least:
                    best, starts = out.get((i, item), (0, []))
                    if s >= best:
                        out[i, item] = (s, ([] if s > best else starts) + [start])
    return out


def test_windows_without_a_shingle_in_place(spark):
    rng = random.Random(8)
    said = lambda n, p: [f"{p}{rng.randrange(10**6)}" for _ in range(n)]
    item = said(60, "w")
    swapped = item[30:] + item[:30]
    docs = [(1, said(40, "x") + swapped + said(40, "x")), (2, swapped), (3, said(9, "x") + swapped[4:]), (4, swapped[:-3] + said(50, "x")), (5, said(60, "x") + item + said(9, "x")), (6, item[30:] + said(30, "x") + item[:30])]
    few = ["a", "b", "c"]
    docs += [(10 + k, [rng.choice(few) for _ in range(30 + 5 * k)]) for k in range(8)]
    items = [(1, item), (2, said(40, "v")), (3, [rng.choice(few) for _ in range(9)]), (4, ["a", "b"]), (5, ["a"] * 3 + ["b"] * 3)]
    docs, items = [(i, " ".join(w)) for i, w in docs], [(i, " ".join(w)) for i, w in items]
    want = every_window(docs, items)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["start"], r["similarity"]) for r in simhash_decontam.leaks_digest(d, b).collect()}
    assert got.keys() == want.keys() and {(k, 1) for k in range(1, 6)} <= got.keys() and (6, 1) not in got
    assert all(s == want[k][0] and start in want[k][1] for k, (start, s) in got.items())
    left = [r["doc_id"] for r in simhash_decontam.without_leaks(d, b).collect()]
    assert not {1, 2, 3, 4, 5} & set(left) and 6 in left


def test_texts_that_share_an_item_id(spark):
    """A short and a long item under one id, or none, and a repeated row change nothing about each other."""
    rng = random.Random(9)
    long = [f"w{rng.randrange(10**6)}" for _ in range(50)]
    items = [(i, " ".join(w)) for i, texts in ((1, (long, long[:20])), (2, (long[:20], long)), (None, (long, long[:20], long[:20]))) for w in texts]
    items += [(9, "a a a a a a a a b")] * 2
    docs = [(1, " ".join(["x", *long[:20], "y"])), (2, " ".join(["x", "z", *long, "y"])), (3, "y y " + "a " * 9 + "y y")]  # of 3: 4 of 6 shingles
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in simhash_decontam.leaks_digest(d, b).collect()}
    assert got == {(k, i, k, 1.0) for k in (1, 2) for i in (1, 2, None)}

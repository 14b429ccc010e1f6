"""Alignment of two tokenizers, held against direct comparison of byte ranges."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import token_alignment as ta
from tessera.llm.common import discard

TEXTS = [None, "", " ", "Hello world", "naïve café 東京 🙂", "<|endoftext|> and <s> </s>", "a\x00b\x1fc\ttab\n\n line", "  two  spaces  ", "Hello world", "x" * 3000, "don't we'll 1234567 !!??", "▁ piece", "é ﬁ ½"]


@pytest.fixture(scope="module")
def encoders():
    how = ta.Tokenizers()
    with open(how.a, "rb") as a, open(how.b, "rb") as b:
        return ta.Encoders(a.read(), b.read())


def ranges(ids, sizes):
    at, out = 0, []
    for i in ids:
        out.append((at, at + sizes[i], i))
        at += sizes[i]
    return out


def by_hand(encoders, texts):
    per, corpus = [], Counter()
    for text in texts:
        whole = " " + (text or "")
        a = encoders.a.encode(whole, add_special_tokens=False).ids if text else []
        b = encoders.b.encode(text) if text else []
        ok = all(b"".join(t[i] for i in ids) == whole.encode() for ids, t in ((a, encoders.a_bytes), (b, encoders.b_bytes)))
        ra, rb = (ranges(a, encoders.a_sizes), ranges(b, encoders.b_sizes)) if text and ok else ([], [])
        pairs = [(p, q) for s, e, p in ra for t, f, q in rb if s < f and t < e]
        ends = sorted({e for _, e, _ in ra} & {f for _, f, _ in rb})
        said = [",".join(str(i) for s, e, i in ra if x < e <= y) + "|" + ",".join(str(i) for s, e, i in rb if x < e <= y) for x, y in zip([0, *ends], ends)]
        per.append((len(ra), len(rb), said, pairs))
        corpus.update(set(pairs))
    most = Counter()
    for (p, _), n in corpus.items():
        most[p] = max(most[p], n)
    out = []
    for na, nb, said, pairs in per:
        digest = hashlib.sha256(";".join(said).encode()).hexdigest() if na else ""
        out.append((na, nb, len(said), len(pairs), digest, sum(corpus[x] == most[x[0]] for x in pairs), sum(corpus[x] for x in pairs)))
    return out


@pytest.mark.parametrize("how", [ta.Tokenizers(), ta.Tokenizers(most_sent=0, part=3)], ids=["sent", "parts"])
def test_equal_to_direct_comparison(spark, encoders, how):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, pair int").repartition(3)
    rows = ta.alignment_digest(docs, how).orderBy("doc_id").collect()
    got = [(r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum) for r in rows]
    assert got == by_hand(encoders, TEXTS)
    assert got[0] == got[1] == (0, 0, 0, 0, "", 0, 0) and got[3][0] > 0


def test_both_ways_agree_on_awkward_rows(spark, docs, empty):
    ways = [ta.Tokenizers(), ta.Tokenizers(most_sent=0, part=4)]
    one, two = (sorted(map(tuple, ta.alignment_digest(docs, h).collect()), key=str) for h in ways)
    assert one == two and len(one) == docs.count()
    for h in ways:
        assert ta.alignment_digest(empty, h).collect() == []


def test_groups_give_the_text_back(spark, encoders):
    docs = spark.createDataFrame([(1, "Hello wonderful tokenizers, naïvely")], "doc_id long, text string")
    row = ta.align(docs).first()
    i = j = 0
    for x, y in zip(row.a_cuts, row.b_cuts, strict=True):
        left, right = row.a_ids[i:x], row.b_ids[j:y]
        assert b"".join(encoders.a_bytes[k] for k in left) == b"".join(encoders.b_bytes[k] for k in right)
        i, j = x, y
    assert (i, j) == (row.n_a, row.n_b) and len(row.a_cuts) == row.n_groups


def test_quick_encoder_equals_the_file_s(encoders):
    """Every code point that the quick encoder takes, alone, in words, beside spaces, numbers and signs."""
    assert encoders.fast is not None
    for c in map(chr, range(ta.PLAIN_BELOW)):
        for text in (c, f" {c}", f" a{c}b", f" 1{c}2 ", f"  {c}  x", f" {c}{c} '{c}s", f"\n{c}\n ", f" !{c}?"):
            assert encoders.fast.encode_ordinary(text) == encoders.a.encode(text, add_special_tokens=False).ids, (hex(ord(c)), text)


def test_links_of_groups_cover_every_overlap():
    def both(a, b):
        a, b = np.array(a), np.array(b)
        x, y = ta.cuts(a, b)
        return list(zip(x.tolist(), y.tolist(), strict=True)), list(zip(*map(np.ndarray.tolist, ta.links(a, b, x, y)), strict=True))

    assert both([1, 3], [2, 2]) == ([(2, 2)], [(0, 0), (1, 0), (1, 1)])
    assert both([3, 1, 1], [2, 3]) == ([(3, 2)], [(0, 0), (0, 1), (1, 1), (2, 1)])
    assert both([1, 3, 2], [4, 1, 1]) == ([(2, 1), (3, 3)], [(0, 0), (1, 0), (2, 1), (2, 2)])
    assert both([], []) == ([], [])


def test_scratch_is_deleted(spark):
    df = ta.materialise(spark.range(3), "alignment-test")
    discard(df)
    with pytest.raises(Exception):
        spark.read.parquet(df._scratch)

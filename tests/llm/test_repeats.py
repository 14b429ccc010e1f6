"""Ops 4, 5 and 8 against brute force on the awkward rows and on random ones."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import rlz_spans, signature_tree, suffix_buckets
from tessera.llm.anchors import union

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_bytes(rows, size):
    docs = [(i, (t or "").encode()) for i, t, *_ in rows]
    n = Counter(b[p : p + size] for _, b in docs for p in range(len(b) - size + 1))
    out = []
    for i, b in docs:
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if n[b[p : p + size]] > 1:
                gone[p : p + size] = b"\1" * size
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def brute_words(rows, size):
    docs = [(i, WORD.findall(t or "")) for i, t, *_ in rows]
    key = lambda i: -(2**63) if i is None else i
    first: dict[tuple, int] = {}
    for i, w in docs:
        for p in range(len(w) - size + 1):
            g = tuple(w[p : p + size])
            first[g] = min(first.get(g, 2**63), key(i))
    out = []
    for i, w in docs:
        gone = bytearray(len(w))
        for p in range(len(w) - size + 1):
            if first[tuple(w[p : p + size])] < key(i):
                gone[p : p + size] = b"\1" * size
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def brute_sets(rows, words):
    out = []
    for _, t, *_ in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    return out


def brute_components(rows, words, percent):
    sets, n = brute_sets(rows, words), len(rows)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(n):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    key = lambda i: -(2**63) if i is None else i
    least: dict[int, int] = {}
    for a in range(n):
        least[find(a)] = min(least.get(find(a), 2**63), key(rows[a][0]))
    back = lambda v: None if v == -(2**63) else v
    return [(rows[a][0], len(sets[a]), back(least[find(a)])) for a in range(n)]


def same(df, expected):
    order = lambda r: tuple((v is not None, v) for v in r)
    assert sorted((tuple(r) for r in df.collect()), key=order) == sorted(expected, key=order)


@pytest.mark.parametrize("size", [400, 40])
def test_bytes(docs, rows, size):
    same(suffix_buckets.repeats_digest(docs, size), brute_bytes(rows, size))


@pytest.mark.parametrize("size", [50, 7])
def test_words(docs, rows, size):
    same(rlz_spans.spans_digest(docs, size), brute_words(rows, size))


@pytest.mark.parametrize("shared", [399, 400])
def test_passage_of_over_fifty_words(spark, shared):
    """57 words, with the spaces around them one byte short of 400, stay; op 5 removes them. Of 400 bytes both documents lose them."""
    passage = " ".join(f"word{i:02}" for i in range(57))[400 - shared :]
    rows = [(1, f"ab {passage} cd"), (2, f"ef {passage} gh"), (3, "one more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_buckets.repeats_digest(docs).collect()}
    gone = (400, 1) if shared == 400 else (0, 0)
    assert found == {1: (shared + 4, *gone), 2: (shared + 4, *gone), 3: (8, 0, 0)}
    assert sorted((r.doc_id, r.n_removed) for r in rlz_spans.spans_digest(docs).collect()) == [(1, 0), (2, 57), (3, 0)]


@pytest.mark.parametrize("few", [0, 1, 3])
def test_words_of_common_grams(docs, rows, few):
    """Grams with more blocks than are shipped are compared range by range and window by window."""
    found = rlz_spans.duplicate_words(docs, 7, few=few)
    gone = {(r.doc_id, r.text): [b - a for a, b in union(np.array(r.starts), np.array(r.ends))] for r in found.collect()}
    want = Counter((i, n, gone) for i, n, gone, _ in brute_words(rows, 7))
    assert Counter((i, len(WORD.findall(t)), sum(g)) for (i, t), g in gone.items()) == Counter(dict.fromkeys(want, 1))


def test_matches_grow_to_both_sides():
    own, block = np.array([9, 1, 2, 3, 4, 5, 8], np.uint64), np.array([1, 2, 3, 4, 5], np.uint64)
    assert rlz_spans.grow(own, 2, block, 1) == (1, 4)
    assert rlz_spans.grow(own, 2, block, 4) == (0, 0)
    assert rlz_spans.grow(own, 2, block[:2], 1) == (1, 1)


def test_window_across_factors(spark):
    """The greedy parse ends a factor inside a window that a third document holds whole."""
    w = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(w[:80])), (2, " ".join(w[80:160])), (3, " ".join(w[55:105])), (4, " ".join(w[:160]))]
    rows = [(*r, None, None, None) for r in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    same(rlz_spans.spans_digest(docs, 50), brute_words(rows, 50))


def test_identifiers_of_later_offsets_decide(spark):
    """Suffixes of one initial bucket are told apart by the buckets of what follows at a later offset alone: the same
    regions with the later offsets' buckets made equal come out as repeats."""
    assert suffix_buckets.widths(400, 100) == [100, 200, 400] and suffix_buckets.widths(10, 4) == [4, 8, 10]
    assert suffix_buckets.offsets_by_level([100, 200, 400]) == {0: 2, 200: 1, 100: 0, 300: 0}
    win = suffix_buckets.Windows(8, 2, 3, suffix_buckets._bytes, earlier=False)

    def found(*texts):
        regions = [(i, 0 << 15 | 0, 0, t, [0]) for i, t in enumerate(texts)]
        df = spark.createDataFrame(regions, "region long, own int, left int, context binary, parts array<int>")
        return sorted(r.region for r in suffix_buckets.refine(df, win, [2, 4, 8], "t").collect())

    assert found(b"abcdefgh", b"abcdefgh", b"abcdefgX") == [0, 1]
    assert found(b"abcdefgh", b"abcdefgX", b"abcdefgX", b"Xbcdefgh") == [1, 2]
    assert found(b"abcdefgh", b"abcdXXgh") == []
    assert found(b"aaaaaaaa", b"aaaaaaaa", b"aaaaaaab") == [0, 1]


def test_random_low_entropy(spark):
    """Texts of few symbols, where almost every window repeats somewhere and samples crowd."""
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("ab ") for _ in range(rng.randrange(0, 300))), None, None, None) for i in range(40)]
    rows += [(100 + i, rows[i][1][10:] + rows[i + 1][1], None, None, None) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    same(suffix_buckets.repeats_digest(docs, 24), brute_bytes(rows, 24))
    same(rlz_spans.spans_digest(docs, 9), brute_words(rows, 9))


def test_long_documents_in_pieces(spark, monkeypatch):
    from tessera.llm import anchors, lexer

    monkeypatch.setattr(anchors, "PIECE", 64)
    monkeypatch.setattr(lexer, "SPAN", 50)
    import numpy as np

    rng = np.random.default_rng(0)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    data[3000:4000] = data[500:1500]
    at, low, high = anchors.sample(data, np.array([0, 5000]), 80, 32)
    covered = sorted(int(s) for m, a, b in zip(at, low, high, strict=True) for s in range(m - b, m - a + 1))
    assert covered == list(range(5000 - 80 + 1)) and high.max() <= 48
    inside = at[(at >= 500) & (at + 32 <= 1500)]
    copied = set((at - 2500).tolist())
    assert len(inside) > 10 and sum(int(a) in copied for a in inside[5:-5]) == len(inside[5:-5])


def test_operator_outputs(docs, rows):
    kept = {r["doc_id"]: r for r in rlz_spans.parse(docs).collect() if r["doc_id"] is not None}
    n = {i: len(WORD.findall(t or "")) for i, t, *_ in rows}
    for i, r in kept.items():
        assert [f["start"] for f in r["factors"]] == [0, *(f["end"] for f in r["factors"][:-1])][: len(r["factors"])]
        assert i == 50 or (r["factors"][-1]["end"] if r["factors"] else 0) == n[i]
    assert any(f["source"] is not None for f in kept[11]["factors"])
    spans = {r["doc_id"]: r for r in suffix_buckets.remove_repeats(docs).collect()}
    assert spans[60]["kept"] == b"" and spans[64]["spans"] == []


@pytest.mark.parametrize("how", [signature_tree.Join(), signature_tree.Join(words=5, percent=80), signature_tree.Join(words=2, percent=30, small=3, block=4)])
def test_components(docs, rows, how):
    got = signature_tree.near_components(docs, how).select("doc_id", "n_shingles", "component")
    same(got, brute_components(rows, how.words, how.percent))


@pytest.mark.parametrize("hubs", [1, 64])
def test_large_groups_in_blocks(spark, hubs):
    """A group above block and bucket limits whose copies link by way of their original alone."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = [(0, " ".join(base))]
    for k in range(1, 60):
        copy = list(base)
        for place in rng.sample(range(200), 3):
            copy[place] = f"e{k}_{place}"
        rows.append((k, " ".join(copy)))
    for k in range(60, 80):  # too far from the original, some near each other
        copy = list(base)
        for place in range(5 * (k % 4), 200, 20):
            copy[place] = f"f{k % 4}_{place}" if k % 3 else f"g{k}_{place}"
        rows.append((k, " ".join(copy)))
    rows += [(100 + k, " ".join(f"v{rng.randrange(5000)}" for _ in range(150))) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    how = signature_tree.Join(small=8, block=16, hubs=hubs)
    same(signature_tree.near_components(docs, how).select("doc_id", "n_shingles", "component"), brute_components([(i, t) for i, t in rows], 4, 85))


def test_one_of_each(docs, rows):
    kept = signature_tree.one_of_each(docs, signature_tree.Join())
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in kept.select("doc_id").collect())
    groups = {c for _, n, c in brute_components(rows, 4, 85) if n}
    assert len([1 for ok, i in ids if not (ok and i in (1, 2, 3))]) >= len(groups)
    assert (True, 31) not in ids and (True, 5) not in ids and {(True, 1), (True, 2), (True, 3), (True, 4)} <= set(ids)


def test_empty_tables(empty):
    assert suffix_buckets.repeats_digest(empty).count() == 0
    assert rlz_spans.spans_digest(empty).count() == 0
    assert signature_tree.jaccard_digest(empty).count() == 0


def test_tree_prunes_nothing_that_links():
    rng = random.Random(1)
    import numpy as np

    sets = []
    for _ in range(150):
        base = rng.sample(range(10**6), rng.randrange(1, 60))
        for _ in range(rng.randrange(1, 4)):
            s = set(base)
            for _ in range(rng.randrange(0, 5)):
                s.discard(rng.choice(base))
                s.add(rng.randrange(10**6))
            sets.append(sorted(s))
    how = signature_tree.Join(percent=70)
    root = signature_tree.forest([np.array(s, np.uint64).tobytes() for s in sets], how)
    rows = [(i, s) for i, s in enumerate(sets)]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, s in rows:
        for b in range(a):
            both = len(set(s) & set(sets[b]))
            if 100 * both >= 70 * (len(s) + len(sets[b]) - both):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    assert root == [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("percent", [30, 80, 85, 100])
def test_linked_sets_agree_in_a_part(percent):
    how, rng = signature_tree.Join(percent=percent), np.random.default_rng(percent)
    ranges = how.ranges(400)
    tried = 0
    for _ in range(3000):
        n = int(rng.integers(1, 120))
        pool = rng.integers(0, 2**63, 2 * n + 20).astype(np.uint64)
        a = np.unique(pool[:n])
        b = np.unique(np.append(pool[int(rng.integers(0, n // 4 + 1)) : n], pool[n : n + int(rng.integers(0, n // 5 + 2))]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= percent * (len(a) + len(b) - both):
            tried += 1
            assert np.intersect1d(signature_tree.agreements(a, how, ranges), signature_tree.agreements(b, how, how.ranges(200))).size
    assert tried > 20


def test_inner_nodes_are_pruned():
    """Families of like sets stand side by side, so pairs of inner nodes are ruled out, not pairs of leaves alone."""
    rng = np.random.default_rng(5)
    raw = []
    for k in range(64):
        base = rng.integers(0, 2**63, 80).astype(np.uint64)
        raw += [np.unique(np.append(base[m:], rng.integers(0, 2**63, m).astype(np.uint64))) for m in range(4)]
    order = rng.permutation(len(raw))
    at = np.append(0, np.cumsum([len(raw[i]) for i in order]))
    _, flat = np.unique(np.concatenate([raw[i] for i in order]), return_inverse=True)
    tree = signature_tree.Tree(flat, at, signature_tree.Join())
    roots = tree.roots()
    assert len(set(roots.tolist())) == 64 and tree.pruned[1] > 500 and sum(tree.pruned) < 256 * 255 / 8


def pool_of_lines(n, rng=random):
    """Documents of 20 of 40 lines: common lines and n-grams everywhere, and hardly a link."""
    rng = random.Random(n)
    lines = [" ".join(f"line{k}word{j}" for j in range(8)) for k in range(40)]
    return [(i, " ".join(rng.sample(lines, 20))) for i in range(n)]


def test_templated_documents(spark):
    """A large cluster without links: what is compared grows with the documents, not with their pairs."""
    how = signature_tree.Join()
    most = []
    for n in (500, 1000):
        rows = pool_of_lines(n) + [(10_000 + k, pool_of_lines(n)[k][1] + " one more") for k in range(5)]
        docs = spark.createDataFrame([(*r, None, None, None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
        found = {r["doc_id"]: r["component"] for r in signature_tree.near_components(docs, how).collect()}
        assert {i for i, c in found.items() if i != c} == {10_000 + k for k in range(5)} and all(found[10_000 + k] == k for k in range(5))
        sets = [next(signature_tree.sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), 4)) for _, t in rows]
        grams = spark.createDataFrame([(1, i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "label long, node long, grams binary")
        pairs, many = signature_tree.candidates_of_parts(signature_tree._signs(grams, how), grams.select("label", "node"), how)
        most.append(pairs.count())
        assert many.select("node").distinct().count() < n / 2
    assert max(most) < 100

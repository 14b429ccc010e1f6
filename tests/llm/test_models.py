"""Ops 1, 2 and 6: models against their definitions, held-out accuracy, and rounding to targets."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import langid_ppm, lexer, mixing_pivotal, quality_ftrl


def folded(text: str) -> bytes:
    b = text.encode()
    return bytes(langid_ppm.fold(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0])


def direct_bits(texts, text, order):
    """The code length by the definition, a byte at a time."""
    tree = defaultdict(Counter)
    for t in texts:
        b = folded(t)
        for i in range(len(b)):
            for k in range(min(order, i) + 1):
                tree[b[i - k : i]][b[i]] += 1
    total, b = 0.0, folded(text)
    for i in range(len(b)):
        for k in range(min(order, i), -1, -1):
            seen = tree.get(b[i - k : i])
            if seen:
                n, q = sum(seen.values()), len(seen)
                if b[i] in seen:
                    total -= math.log2(seen[b[i]] / (n + q))
                    break
                total -= math.log2(q / (n + q))
            if k == 0:
                total += 8
    return total


@pytest.mark.parametrize("order", [1, 2, 3])
def test_code_lengths(order):
    rng = random.Random(order)
    texts = {name: ["".join(rng.choice(letters) for _ in range(80)) for _ in range(3)] for name, letters in (("x", "abc é"), ("y", "bcd ñ"), ("z", "cde中 "))}
    model = langid_ppm.Model.train({k: [t.encode() for t in v] for k, v in texts.items()}, order)
    asked = ["", "a", "abc abc é", "zzz", "cde中" * 5, "ABC", "\x00\x01", "ñb"]
    raw = [t.encode() for t in asked]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw]))
    got = model.bits(*langid_ppm.fold(data, offsets))
    for i, t in enumerate(asked):
        for j, name in enumerate(model.names):
            assert got[i, j] == pytest.approx(direct_bits(texts[name], t, order), rel=1e-4, abs=1e-3)


def test_code_length_across_pieces(monkeypatch):
    rng = np.random.default_rng(0)
    text = bytes(rng.integers(97, 101, 3_000_000).astype(np.uint8))
    model = langid_ppm.Model.train({"x": [text[:5000]], "y": [text[7000:9000]]}, 3)
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    assert model.bits(data, offsets)[0, 0] == pytest.approx(sum(model.bits(data[a:b], np.array([0, b - a]))[0, 0] for a, b in ((0, 10**6), (10**6, len(text)))), rel=1e-5)


def test_language_digest(docs, rows, empty):
    got = langid_ppm.language_digest(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert by[1] == by[2] == by[3] == "und" and by[31] == by[36] == "de" and by[62] in ("de", "en", "fr")
    assert langid_ppm.language_digest(empty).count() == 0


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    lang = langid_ppm.language_digest(d).where("held_out").join(d.select("doc_id", "lang"), "doc_id")
    assert lang.where("lang = lang_pred").count() >= 0.98 * lang.count()
    quality = quality_ftrl.quality_digest(d, labels).where("held_out").join(labels, "doc_id")
    assert quality.where("predicted = quality").count() >= 0.97 * quality.count()


def test_shapes_and_ngrams():
    texts = ["The CAT, sat!! 42", "", "The", "the cat"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw]))
    kinds, at = quality_ftrl._shapes(data, offsets)
    assert [bytes(kinds[a:b]).decode() for a, b in zip(at, at[1:], strict=False)] == ["Aa A, a! 0", "", "Aa", "a a"]
    hashes, start, end, counts = lexer.words(data, offsets, lower=True)
    assert counts.tolist() == [4, 0, 1, 2] and hashes[0] == hashes[4] == hashes[5]
    assert [bytes(data[a:b]).decode() for a, b in zip(start, end, strict=True)] == ["The", "CAT,", "sat!!", "42", "The", "the", "cat"]
    grams, have = lexer.ngrams(hashes, counts, 2, short=True)
    assert have.tolist() == [3, 0, 1, 1] and len(set(grams.tolist())) == 5


def test_lexer_pieces(monkeypatch):
    text = ("word  other\tthird\n" * 50 + "x" * 300 + " end").encode()
    data = np.frombuffer(text, np.uint8)
    whole = lexer.words(data, np.array([0, len(text)]))
    monkeypatch.setattr(lexer, "SPAN", 37)
    assert all((a == b).all() for a, b in zip(whole, lexer.words(data, np.array([0, len(text)])), strict=True))


def test_ftrl_learns_and_is_sparse():
    rng = np.random.default_rng(1)
    examples = [(rng.choice(1000, 5, replace=False) + (1000 if k % 2 else 0), np.full(5, 0.45), k % 2) for k in range(400)]
    w = quality_ftrl.learn(examples, quality_ftrl.Ftrl(bits=12))
    right = sum((w[key] @ value + w[-1] > 0) == bool(label) for key, value, label in examples)
    assert right > 380 and np.count_nonzero(w[2000:-1]) == 0


def test_quality_edges(docs, empty, spark, rows):
    labels = spark.createDataFrame([(30, 1, 0), (31, 1, 0), (60, 0, 0), (63, 0, 1), (63, 0, 1), (None, 1, 0), (64, None, None)], "doc_id long, quality int, toxic int")
    got = quality_ftrl.quality_digest(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert {r["score"] for r in quality_ftrl.quality_digest(docs, labels.where("quality = 7")).collect()} == {0.5}
    assert quality_ftrl.quality_digest(empty, labels).count() == 0


def brute_targets(sizes):
    """Share by weight, stop at three times the size, share the excess again."""
    names = sorted((k for k in sizes if k is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = float(sum(sizes.values())), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 500, None: 7}, {"a": 0, "b": 5}, {"a": 1}, {"x": 1, "y": 1, "z": 10_000, "zz": 3}, {None: 4}])
def test_targets(spark, sizes):
    rows = [(s, n) for s, n in sizes.items()]
    got = {r["source"]: r["target"] for r in mixing_pivotal.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_mix(docs, rows, empty):
    got = mixing_pivotal.mix_digest(docs).collect()
    assert len(got) == len(rows)
    size = lambda t: len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")])
    assert sorted(r["size"] for r in got) == sorted(size(t) for _, t, *_ in rows)
    assert all(r["taken"] <= 3 * r["size"] and r["taken"] % max(1, r["size"]) == 0 for r in got)
    again = mixing_pivotal.mix_digest(docs.repartition(7)).collect()
    order = lambda rs: sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in rs)
    assert order(got) == order(again)
    made = mixing_pivotal.materialise_mix(docs, ["doc_id", "text", "source"])
    assert made.count() == sum(r["copies"] for r in got)
    assert mixing_pivotal.mix_digest(empty).count() == 0


def test_mix_nears_targets(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing_pivotal.mix(d, block=64).groupBy("source").agg({"target": "first", "size": "count"}).collect()
    taken = {r["source"]: r["t"] for r in mixing_pivotal.mix(d, block=64).selectExpr("source", "copies * size AS t").groupBy("source").agg({"t": "sum"}).withColumnRenamed("sum(t)", "t").collect()}
    assert all(abs(taken[r["source"]] - r["first(target)"]) <= 0.02 * r["first(target)"] for r in got)


def test_pivot_keeps_words_and_odds():
    rng = random.Random(0)
    rows = [(i, 0, 1, rng.randrange(1, 300), rng.uniform(0.05, 0.95)) for i in range(60)]
    words = sum(s * p for *_, s, p in rows)
    hits = Counter()
    for seed in range(1000):
        got = mixing_pivotal.pivot(rows, seed, 0)
        assert sum(s * p for *_, s, p in got) == pytest.approx(words)
        assert sum(1 for *_, p in got if 1e-9 < p < 1 - 1e-9) <= 1
        hits.update({k: p for k, *_, p in got})
    assert all(abs(hits[k] / 1000 - p) < 4.5 * math.sqrt(p * (1 - p) / 1000) for k, *_, p in rows)


@pytest.mark.parametrize("sizes", [[900, 700, 500, *[9] * 17], list(range(1, 24)), [5000, *range(10, 200, 7)]])
def test_small_sources_keep_their_odds(sizes):
    """Also the last document, and documents larger than all that is left, through two levels of the tree."""
    rows = [(i, 0, 1, s, 0.37) for i, s in enumerate(sizes)]
    n, hits, words = 3000, Counter(), 0
    for seed in range(n):
        blocks = [mixing_pivotal.pivot(rows[k::2], seed, 0) for k in (0, 1)]
        open_ = [r for b in blocks for r in b if 1e-9 < r[4] < 1 - 1e-9]
        whole = [r for b in blocks for r in b if r not in open_] + mixing_pivotal.pivot(open_, seed, 1, True)
        assert all(r[4] in (0.0, 1.0) for r in whole)
        hits.update({k: p for k, *_, p in whole})
    assert all(abs(hits[r[0]] / n - 0.37) < 4.5 * math.sqrt(0.37 * 0.63 / n) for r in rows)


def test_odds_of_a_whole_mix(spark):
    """Over seeds, each document of sources of 20 is taken as often as its rate says."""
    rows = [(i, " ".join(["w"] * (1 + (i * 37) % 90)), "ab"[i % 2]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    n, hits, rates = 12, Counter(), {}
    for seed in range(n):
        for r in mixing_pivotal.mix(docs, seed=seed, block=16).collect():
            hits[r["doc_id"]] += r["copies"]
            rates[r["doc_id"]] = r["target"] / r["source_size"]
    z = [(hits[i] / n - x) / math.sqrt((x % 1) * (1 - x % 1) / n) for i, x in rates.items() if 0.01 < x % 1 < 0.99]
    assert z and max(map(abs, z)) < 4.5 and sum(v * v for v in z) / len(z) < 2


def test_repeated_rows_are_rounded_apart(spark):
    """Thousands of equal rows: dealt to many blocks, and their words come near the target too."""
    rows = [(1, "one two three", "a")] * 6000 + [(i, "four five six seven", "b") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing_pivotal.mix(docs, block=256).groupBy("source", "target").agg({"*": "count", "copies": "sum"}).collect()
    by = {r["source"]: r for r in got}
    assert by["a"]["count(1)"] == 6000 and abs(3 * by["a"]["sum(copies)"] - by["a"]["target"]) <= 3
    assert by["b"]["count(1)"] == 2000 and abs(4 * by["b"]["sum(copies)"] - by["b"]["target"]) <= 4


def test_ftrl_by_its_definition():
    """Coordinate by coordinate, in plain Python."""
    rng = np.random.default_rng(4)
    how = quality_ftrl.Ftrl(bits=6, epochs=2)
    examples = [(rng.choice(64, 4, replace=False), rng.random(4), int(rng.integers(2))) for _ in range(60)]
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= how.l1:
            return 0.0
        return (math.copysign(how.l1, z[i]) - z[i]) / ((how.beta + math.sqrt(n[i])) / how.alpha + how.l2)

    for _ in range(how.epochs):
        for keys, values, label in examples:
            x = {**dict(zip(keys.tolist(), values.tolist(), strict=True)), 64: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - label) * v
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / how.alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    assert quality_ftrl.learn(examples, how) == pytest.approx(np.array([weight(i) for i in range(65)]), abs=1e-12)


def test_score_is_a_sparse_dot_product(spark):
    texts = ["The cat sat, and the cat ran!", "", None, "x1 y2 " * 40, "Ein Satz mit   Wörtern"]
    rng = np.random.default_rng(2)
    how = quality_ftrl.Ftrl(bits=10)
    weights = rng.normal(size=(1 << 10) + 1)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in quality_ftrl.score(df, weights, how).collect()}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        _, key, value = quality_ftrl.features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 10)
        held = defaultdict(float)
        for k, v in zip(key.tolist(), value.tolist(), strict=True):
            held[k] += v
        total = weights[-1] + sum(weights[k] * v for k, v in held.items())
        assert got[i] == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-4)


def test_fits_stay_bounded(spark):
    """One id that stands in thousands of rows and labels, and a language a row."""
    docs = spark.createDataFrame([(7, f"good text {k}", f"l{k}") for k in range(400)] + [(k, f"bad {k}", "xx") for k in range(100, 400)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(7, 1)] * 20 + [(k, 0) for k in range(100, 400)], "doc_id long, quality int")
    weights = quality_ftrl.train(docs, labels, labels["doc_id"].isNotNull(), quality_ftrl.Ftrl(bits=10, per_class=50))
    assert np.count_nonzero(weights)
    nobody = docs["doc_id"].isNull()
    sample = langid_ppm.training_sample(docs, nobody, per_language=20, most_languages=5)
    assert len(sample) == 5 and len(sample["xx"]) == 20 and sorted(sample)[:-1] == ["l0", "l1", "l10", "l100"]

"""Persisted indexes against scans: signs by bands, postings in blocks, counts that follow a store."""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import vectors
from tessera.operators import bounded_maxsim, frames, postings_index, retrieval, sign_index, substring_index, text_index
from tessera.sources.sinks import SnapshotStore

EMBEDDINGS = "/root/testdata/check_l/embeddings.parquet"


@pytest.fixture(scope="module")
def signs(spark, tmp_path_factory):
    """1,500 vectors around 60 middles, and their index."""
    rng = np.random.default_rng(5)
    middles = rng.standard_normal((60, 64))
    v = middles[rng.integers(0, 60, 1500)] + rng.standard_normal((1500, 64)) * 0.35
    rows = spark.createDataFrame([(i // 8, i % 8, x.tolist()) for i, x in enumerate(v)], "page long, patch int, vec array<float>")
    rows = rows.select("page", "patch", vectors.pack_longs(F.col("vec"), 64).alias("bin")).cache()
    return rows, sign_index.SignIndex(spark, f"file://{tmp_path_factory.mktemp('index')}/signs", 64).build(rows)


def tokens_of(rows, n):
    return rows.orderBy("page", "patch").limit(n).select((F.col("page") * 8 + F.col("patch")).alias("tok"), F.col("bin").alias("q_bin"))


def test_codes_are_the_signs_in_order(spark):
    v = [1.0 if c == "1" else -1.0 for c in "1000000000000001" + "0" * 15 + "1" + "1" * 16 + "01" * 8] + [1.0] * 64
    row = spark.createDataFrame([(v,)], "v array<float>").select(vectors.pack_longs(F.col("v"), 128).alias("bin"))
    row = row.select(*[sign_index.band_code(F.col("bin"), b).alias(f"c{b}") for b in range(8)]).first()
    assert tuple(row) == (0x8001, 1, 0xFFFF, 0x5555, *[0xFFFF] * 4)


@pytest.mark.parametrize("flips", [0, 1, 5, 10])
def test_probing_finds_what_its_flips_allow(spark, signs, flips):
    rows, index = signs
    tokens = tokens_of(rows, 5)
    want = rows.join(F.broadcast(tokens)).where(sign_index.level(F.col("q_bin"), F.col("bin"), 4) <= flips)
    want = {(r.tok, r.page, r.patch, r.d) for r in want.select("tok", "page", "patch", vectors.hamming_longs(F.col("q_bin"), F.col("bin"), 1).alias("d")).collect()}
    got = [tuple(r) for r in index.found(tokens, flips).collect()]
    assert set(got) == want and len(got) == len(want) >= 5
    near = rows.join(F.broadcast(tokens)).where(vectors.hamming_longs(F.col("q_bin"), F.col("bin"), 1) <= flips + 3).count()
    assert near == len([g for g in got if g[3] <= flips + 3])  # none within the radius is missed


def test_recall_and_rows_read_on_clusters(spark, signs):
    rows, index = signs
    tuned = sign_index.calibrate(rows, 10, 64, recall=0.95)
    assert tuned.recall >= 0.95 and tuned.read < 0.2
    tokens = tokens_of(rows, 24)
    exact = {tuple(r) for r in sign_index.scan(rows, tokens, 10, 64).collect()}
    found = {tuple(r) for r in sign_index.nearest(index, rows, tokens, 10, tuned).collect()}
    closer = {(t, d) for t, _, _, d in exact}
    assert sum((t, d) in closer for t, _, _, d in found) >= 0.9 * len(exact)  # ties by distance count as found


@pytest.mark.skipif(not Path(EMBEDDINGS).exists(), reason="no larger table of vectors here")
def test_recall_on_embeddings(spark):
    """The hundred nearest of sampled vectors that were not calibrated on; vectors without clusters are the hard case."""
    v = spark.read.parquet(EMBEDDINGS)
    rows = v.select(F.col("vec_id").alias("page"), F.lit(0).alias("patch"), vectors.pack_longs(F.col("embedding"), 64).alias("bin")).cache()
    tuned = sign_index.calibrate(rows, 100, 64, recall=0.9, sample=24)
    tokens = rows.where("page % 3989 = 3").select(F.col("page").alias("tok"), F.col("bin").alias("q_bin"))
    sums = sign_index.levels(rows, tokens, 100, 64).where(F.col("flips") <= tuned.flips).agg(F.sum("near"), F.sum("rows")).first()
    asked = tokens.count()
    assert sums[0] >= 0.88 * 100 * asked and sums[1] < 0.2 * asked * rows.count()


def test_few_rows_are_scanned(spark, signs):
    rows, index = signs
    tokens = tokens_of(rows, 3)
    got = sign_index.nearest(index, rows, tokens, 40, sign_index.Calibration(20, 0.9, 0.5))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, sign_index.scan(rows, tokens, 40, 64).collect()))
    with pytest.raises(ValueError, match="more than 5"):
        index.nearest(tokens, 3, 24)


def corpus(n=700):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(200)]
    rows = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(200)], k=rng.randrange(0, 80)))) for i in range(n)]
    return rows + [(None, "w5 w6 w6"), (100_000, "w7"), (-5, "w150 W150, w150"), (1000, None), (1001, "")]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3)
    return docs, postings_index.PostingsIndex(spark, f"file://{tmp_path_factory.mktemp('index')}/words", "doc_id", buckets=8, span=16).build(docs, "text")


@pytest.mark.parametrize("terms", [["w0"], ["w150", "w0"], ["w5", "w6", "w7"], ["w1", "w1", "unheard"], ["unheard"], [], [f"w{k}" for k in range(0, 200, 7)]])
def test_postings_give_the_scan_s_ranks(spark, indexed, terms):
    docs, index = indexed
    want = retrieval.top(text_index.bm25(docs, "doc_id", "text", terms), 10, "doc_id").collect()
    hits = index.search(terms, 10)
    got = hits.rows.collect()
    assert [r.doc_id for r in got] == [r.doc_id for r in want]
    assert [r.score for r in got] == pytest.approx([r.score for r in want], rel=1e-9)
    both = text_index.bm25(docs, "doc_id", "text", terms)
    assert sorted(index.candidates(terms).collect(), key=str) == sorted(both.select("doc_id").collect(), key=str)


def test_ranges_are_skipped(spark, tmp_path):
    """A rare term decides: ranges of common terms alone can't reach the tenth score."""
    rows = [(i, "common words of all " + ("rare rare" if i % 400 == 0 else f"other{i}")) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = postings_index.PostingsIndex(spark, f"file://{tmp_path}/w", "doc_id", buckets=4, span=32).build(docs, "text")
    hits = index.search(["common", "rare"], 5)
    assert [r.doc_id for r in hits.rows.collect()] == [0, 400, 800, 1200, 1600]
    assert hits.ranges == 125 and hits.read <= 12


def counted(docs):
    rows = text_index.postings(docs, "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
    return sorted(map(tuple, rows.collect())), tuple(text_index.statistics(docs, "text").first())


def test_statistics_follow_a_store(spark, tmp_path):
    docs = lambda *r: spark.createDataFrame(r, "doc_id long, text string")
    store = SnapshotStore(spark, f"file://{tmp_path}/store", "doc_id", buckets=8)
    kept = postings_index.TextStatistics(spark, f"file://{tmp_path}/counts", "doc_id", "text")

    def same():
        kept.follow(store)
        rows = store.read()
        terms, totals = counted(rows) if rows is not None else ([], (0, 0.0))
        assert sorted(map(tuple, kept.terms().select("term", "df", "tf").collect())) == terms
        assert kept.totals() == pytest.approx(totals)

    store.upsert(docs(*[(i, t) for i, t in corpus(60) if i is not None]))
    same()
    store.upsert(docs((3, "new words w1"), (4, None), (500, "w1 w1 w2")))
    same()
    store.delete(docs((3, ""), (7, ""), (12345, "")))
    same()
    store.update(docs((9, "updated words"), (10, "w3")), ["text"])
    same()
    assert len(kept.versions()) == 4
    kept.compact()
    assert kept.versions() == [4]
    same()
    for i in range(4):  # the version that was followed is no longer kept
        store.upsert(docs((600 + i, f"w1 later{i}")))
    same()
    store.delete(store.read())
    same()


def test_a_change_written_again_counts_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a"), (2, "a")], "doc_id long, text string")
    kept = postings_index.TextStatistics(spark, f"file://{tmp_path}/counts", "doc_id", "text")
    for _ in range(2):
        kept.change(1, docs)
    kept.change(2, None, docs.where("doc_id = 2"))
    assert sorted(map(tuple, kept.terms().collect())) == [("a", 1, 2), ("b", 1, 1)] and kept.totals() == (1, 3.0)


@pytest.mark.parametrize("kind", ["random", "clusters", "ties"])
def test_bounded_maxsim_is_exact_and_reads_few_pages(spark, tmp_path, kind):
    rng = np.random.default_rng(11)
    v = rng.standard_normal((4000, 64)).astype(np.float32)
    if kind == "clusters":
        v = (rng.standard_normal((20, 64))[rng.integers(0, 20, 4000)] + 0.3 * v).astype(np.float32)
    if kind == "ties":
        v[:] = v[rng.integers(0, 40, 4000)]
        v[8:16] = 0
    patches = spark.createDataFrame([(i // 8, i % 8, x.tolist()) for i, x in enumerate(v)], "page long, patch int, vec array<float>")
    patches = patches.unionByName(spark.createDataFrame([(9000, 0, None)], patches.schema)).repartition(3)
    tokens = spark.createDataFrame([(t, (v[t * 31] + 0.2 * rng.standard_normal(64)).tolist()) for t in range(4)], "tok int, q_vec array<float>")
    want = retrieval.top(retrieval.maxsim(patches.where("vec IS NOT NULL"), tokens, retrieval.float_similarity()), 5).collect()
    best = bounded_maxsim.BoundedMaxSim(spark, f"file://{tmp_path}/codes").build(patches).top(patches, tokens, 5)
    got = best.rows.collect()
    assert [r.page for r in got] == [r.page for r in want] and [r.score for r in got] == pytest.approx([r.score for r in want])
    assert best.pages == 500 and (best.read <= 25 or kind == "ties")


def test_bounds_hold(spark):
    rng = np.random.default_rng(12)
    v, q = rng.standard_normal((200, 32)) * 10 ** rng.uniform(-3, 3, (200, 1)), rng.standard_normal((3, 32))
    patches = spark.createDataFrame([(i // 4, i % 4, x.tolist()) for i, x in enumerate(v)], "page long, patch int, vec array<double>")
    for r in bounded_maxsim.bounds(bounded_maxsim.encode(patches), q).collect():
        score = (v[r.page * 4 : r.page * 4 + 4] @ q.T).max(0).sum()
        assert r.low <= score <= r.high


@pytest.mark.parametrize("needle", ["secret", "The ", "a.b", "é t", "ab", "", "zzzqqq", "%", "needle in", "NEEDLE"])
def test_substrings_as_contains(spark, tmp_path_factory, needle):
    rng = random.Random(13)
    rows = [(i, " ".join(rng.choices(["the", "of", "a.b", "été tard", "word", "x%y", "secrets"], k=6))) for i in range(400)]
    rows += [(900, "a Needle in a hay\nstack"), (901, None), (902, ""), (None, "needle in null"), (7, "needle in twice"), (7, "needle in twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    at = tmp_path_factory.getbasetemp() / "substrings"
    index = substring_index.SubstringIndex(spark, f"file://{at}", "doc_id", buckets=4, span=64)
    if not at.exists():
        index.build(docs, "text")
    found = index.search(docs, "text", needle)
    want = docs.where(F.contains(F.lower("text"), F.lit(needle.lower()))).collect()
    assert sorted(map(tuple, found.rows.collect()), key=str) == sorted(map(tuple, want), key=str)
    if needle in ("zzzqqq", "needle in", "NEEDLE"):
        assert found.verified <= 5  # one more row has the id of two that hold it


def test_a_term_is_one_row_of_a_frame(spark, tmp_path):
    """A row for each block was mostly rows for rare terms; the words are those of Spark."""
    texts = ["common Straße été", "Ünï-cødé ٣٤ x²y ǅ", "İstanbul common", "áb 汉字，汉字 😀emoji😀", "  ", "common common"]
    rows = [(i or None, texts[i % 6]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    index = postings_index.PostingsIndex(spark, f"file://{tmp_path}/w", "doc_id", buckets=1, span=4).build(docs, "text")
    assert spark.read.parquet(f"file://{tmp_path}/w/postings").where("term = 'common' AND df > 4").count() > 0
    want, totals = counted(docs)
    assert sorted(map(tuple, index.statistics.terms().select("term", "df", "tf").collect())) == want
    assert index.statistics.totals() == pytest.approx(totals)
    hits = index.search(["common", "été"], 10).rows.collect()
    scan = retrieval.top(text_index.bm25(docs, "doc_id", "text", ["common", "été"]), 10, "doc_id").collect()
    assert [r.doc_id for r in hits] == [r.doc_id for r in scan] and [r.score for r in hits] == pytest.approx([r.score for r in scan])


def test_frames_are_cut_between_ranges(spark):
    sizes = [4, 4, 4, 4, 4, 30, 4]
    ranges = [None, 0, 0, 1, 1, 2, 2]
    batch = pa.RecordBatch.from_pydict({"range": pa.array(ranges, pa.int64()), "text": ["x" * n for n in sizes]})
    assert [f.column("range").to_pylist() for f in frames.frames(iter([batch]), 16)] == [[None], [0, 0, 1, 1], [2], [2]]


def test_trigrams_of_any_symbols(spark, tmp_path):
    """Code points beyond 16 bits are one symbol each, before the needle was cut in their midst; many symbols leave few bits for rows."""
    wide = "".join(chr(c) for c in range(0x20000, 0x20000 + 70_000))
    rows = [(1, "say 😀😀 twice"), (2, "NUL \x00\x00\x00 end"), (3, wide), (4, wide[5:]), (5, "ab"), (6, ""), (7, None), (None, "x 😀😀 y"), (None, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    index = substring_index.SubstringIndex(spark, f"file://{tmp_path}/g", "doc_id", buckets=2, span=64).build(docs, "text")
    grams = {r.gram for r in spark.read.parquet(f"file://{tmp_path}/g/trigrams").select("gram").distinct().collect()}
    assert grams == {g for _, t in rows for g in substring_index.trigrams((t or "").lower())}
    for needle, want in ((" 😀😀 ", [None, 1]), ("\x00\x00\x00", [2]), (wide[2:9], [3]), (wide[-4:], [3, 4]), ("TWICE", [1])):
        got = [r.doc_id for r in index.search(docs, "text", needle).rows.collect()]
        assert sorted(got, key=lambda k: (k is not None, k or 0)) == want


def test_short_texts_have_no_trigrams(spark, tmp_path):
    docs = spark.createDataFrame([(1, "ab"), (2, "c")], "doc_id long, text string")
    index = substring_index.SubstringIndex(spark, f"file://{tmp_path}/g", "doc_id", buckets=2).build(docs, "text")
    assert index.search(docs, "text", "abc").rows.collect() == [] and index.search(docs, "text", "B").rows.count() == 1


def test_texts_without_words_make_an_empty_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "?!"), (2, None)], "doc_id long, text string")
    index = postings_index.PostingsIndex(spark, f"file://{tmp_path}/w", "doc_id", buckets=2).build(docs, "text")
    assert index.search(["a"], 3).rows.collect() == index.candidates(["a"]).collect() == [] and index.statistics.totals() == (2, 0.0)

"""Cases of single operators: vectors, diffs, schedules, regions, tables."""

from __future__ import annotations

from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.config import DEFAULT
from tessera.functions import nested, strings, vectors
from tessera.operators import etl, ingestion, regions, retrieval, serving, vector_plan
from tessera.operators import synchronisation as sync
from tessera.plans import ingestion as ingestion_plans
from tessera.sources import sinks, tables


def test_packing_against_numpy(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((20, 128)).astype(np.float32)
    v[0] = 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "i int, v array<float>")
    rows = df.select("i", vectors.pack_bits(F.col("v"), 128).alias("b"), vectors.pack_longs(F.col("v"), 128).alias("w"), vectors.unpack_bits(vectors.pack_bits(F.col("v"), 128)).alias("u")).orderBy("i").collect()
    packed = np.packbits(v > 0, axis=1)
    for r, want, x in zip(rows, packed, v, strict=True):
        assert np.array(r["b"], np.int8).view(np.uint8).tolist() == want.tolist()
        assert b"".join((w % 2**64).to_bytes(8, "big") for w in r["w"]) == want.tobytes()
        assert np.array_equal(r["u"], (x > 0).astype(float))
    pairs = df.alias("a").crossJoin(df.alias("b")).select(F.col("a.i").alias("i"), F.col("b.i").alias("j"), vectors.hamming(vectors.pack_bits(F.col("a.v"), 128), vectors.pack_bits(F.col("b.v"), 128)).alias("d"), vectors.hamming_longs(vectors.pack_longs(F.col("a.v"), 128), vectors.pack_longs(F.col("b.v"), 128)).alias("e"))
    for r in pairs.collect():
        want = int(((v[r["i"]] > 0) != (v[r["j"]] > 0)).sum())
        assert r["d"] == r["e"] == want


REF = "record_id string, s3_key string, url string"


@pytest.mark.parametrize(
    ("old", "new", "added", "removed", "kept"),
    [
        (["f1", "f2"], ["f1", "f2"], 0, 0, 2), (["f1"], ["f1", "f2"], 1, 0, 1), (["f1", "f2"], ["f1"], 0, 1, 1), (["old"], ["new"], 1, 1, 0), ([], ["f1"], 1, 0, 0), (["f1"], [], 0, 1, 0), ([], [], 0, 0, 0),
        (["u:old"], ["u:new"], 1, 1, 0), (["f1", "u:2"], ["f1", "u:3"], 1, 1, 1), ([""], [""], 0, 0, 0),
    ],
)
def test_reference_diff(spark, old, new, added, removed, kept):
    side = lambda keys: spark.createDataFrame([("r", "" if k.startswith("u:") else k, k if k.startswith("u:") else "") for k in keys], REF)
    got = {r["change"]: r["count"] for r in sync.reference_diff(side(old), side(new)).groupBy("change").count().collect()}
    assert (got.get("added", 0), got.get("removed", 0), got.get("unchanged", 0)) == (added, removed, kept)


def test_changes_without_times(spark):
    rows = spark.createDataFrame([("a", None, datetime(2024, 1, 2)), ("b", datetime(2024, 1, 2), datetime(2024, 1, 2)), ("c", None, datetime(2023, 1, 1))], "id string, created_at timestamp_ntz, updated_at timestamp_ntz")
    got = {tuple(r) for r in sync.classify_changes(rows, "id", "created_at", "updated_at", F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz")).collect()}
    assert got == {("a", "update"), ("b", "insert")}
    assert tables.timestamp_column(["id", "created_at"]) == "created_at" and tables.timestamp_column(["id"]) is None
    assert tables.incremental(rows, None, datetime(2024, 1, 1)).count() == 3


def test_schedule_and_failures():
    p = sync.schedule(["a", "b", "c"], {"a"}, 3, 1, 2)
    assert (p.full, p.changed, p.deletes) == (("b",), (), False)
    p = sync.schedule(["a", "b"], {"a", "b"}, 4, 1, 2)
    assert (p.full, p.changed, p.deletes) == ((), ("a", "b"), True) and sync.schedule([], set(), 1, 1, 0).deletes

    def changed(table, deletes):
        if table == "a":
            raise OSError("gone")

    assert sync.run_cycle(p, lambda t: None, changed) == {"a": "FAILED: gone", "b": "COMPLETED"}


def test_snapshots_replay(spark, tmp_path):
    store = sinks.SnapshotStore(spark, f"file://{tmp_path}/s", "id")
    assert store.read() is None
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, v string")
    store.upsert(rows)
    store.upsert(rows)
    assert sorted(tuple(r) for r in store.read().collect()) == [(1, "a"), (2, "b")]
    store.update(spark.createDataFrame([(1, None), (2, "c")], "id long, v string"), ["v"])
    store.delete(spark.createDataFrame([(7,)], "id long"))
    assert sorted(tuple(r) for r in store.read().collect()) == [(1, "a"), (2, "c")] and store.version() == 4
    rows.write.parquet(f"{tmp_path}/s/v5")  # a writer that died before its pointer
    assert store.version() == 4
    sinks.null_sink(rows)


def test_jdbc_options():
    o = tables.jdbc_options("postgresql://u:p%40w@h/db")
    assert (o["url"], o["user"], o["password"]) == ("jdbc:postgresql://h:5432/db?sslmode=require", "u", "p@w")
    assert tables.jdbc_options("postgres://u:p@h:99/db?sslmode=disable")["url"] == "jdbc:postgresql://h:99/db"
    with pytest.raises(ValueError):
        tables.jdbc_options("mysql://h/db")
    with pytest.raises(ValueError):
        tables.safe_identifier('x"; drop')
    assert tables.safe_identifier("orders") == '"orders"'


def test_project_row(spark):
    rows = spark.createDataFrame([(562949953567479, "Test Project", "Test Display Name", datetime(2024, 1, 15, 10, 30), datetime(2024, 3, 20, 15, 45))], "id long, name string, display_name string, created_at timestamp_ntz, updated_at timestamp_ntz")
    d, bad = ingestion.to_documents(rows, "projects", {}, {}, 5)
    r = d.first()
    assert (r["doc_id"], r["content_text"], r["relationships"], r["file_references"]) == ("projects:562949953567479", "Test Project Test Display Name", [], [])
    assert (r["created_at"], r["updated_at"], r["ingested_at"]) == (1705314600000, 1710949500000, 5) and bad.count() == 0
    assert r["metadata"]["created_at"] == "2024-01-15T10:30:00"


def test_photo_and_change_order_rows(spark):
    photo = spark.createDataFrame([(562950208716653, 562949954923622, "1/2/photos/3/IMG_1128.jpg", "HVAC unit installation", "Building A, Floor 2", "https://h.org/x/IMG.jpg")], "id long, project_id long, s3_key string, description string, location string, url string")
    r = ingestion.to_documents(photo, "photos", {"project_id": "projects"}, {"s3_key": "s3_key", "url": "url"}, 1)[0].first()
    assert [x["target_doc_id"] for x in r["relationships"]] == ["projects:562949954923622"] and [x["filename"] for x in r["file_references"]] == ["IMG_1128.jpg", None] and r["content_text"] == "HVAC unit installation Building A, Floor 2"
    order = spark.createDataFrame([(1, None, "CO-011", "T", " ", '{"9": "a/b.pdf", "8": "c"}', True, 1.5)], "id long, project_id long, number string, title string, description string, attachment_s3_keys string, done boolean, cost double")
    r = ingestion.to_documents(order, "change_orders", {"project_id": "projects"}, {"attachment_s3_keys": "jsonb_s3_map"}, 1)[0].first()
    assert r["relationships"] == [] and [(x["file_id"], x["s3_key"]) for x in r["file_references"]] == [("9", "a/b.pdf"), ("8", "c")]
    assert r["content_text"] == "CO-011 T" and r["metadata"]["done"] == "true" and "project_id" not in r["metadata"]


def test_rejects(spark):
    rows = spark.createDataFrame([(1, "7"), (2, "x"), (None, "7"), (3, None)], "id long, project_id string")
    good, bad = ingestion.to_documents(rows, "t", {}, {}, 1)
    assert sorted((r["doc_id"], r["project_id"]) for r in good.collect()) == [("t:1", 7), ("t:3", None)]
    assert sorted(r["error"] for r in bad.collect()) == ["Row without id", "project_id is not a number"]


def test_schema_report(spark):
    frames = {"b": spark.range(3).toDF("id"), "a": spark.range(2000).toDF("id")}
    found = ingestion.discover(spark, frames)
    text = ingestion.schema_report(found["columns"], found["counts"])
    assert text.index("## a (2,000 rows)") < text.index("## b (3 rows)") and tables.database_name(spark) == "default"
    assert ingestion_plans.j1_fk_inference(spark, "").count() == 5


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 400), st.integers(0, 400), st.integers(1, 60), st.integers(1, 60)), max_size=14), st.integers(0, 50))
def test_merged_boxes_are_apart(boxes, gap):
    b = np.array([(x, y, x + w, y + h) for x, y, w, h in boxes], float).reshape(-1, 4)
    got = regions.merge_boxes(b, gap)
    for i in range(len(got)):
        for j in range(i):
            a, c = got[i], got[j]
            assert not (a[0] - gap <= c[2] and a[2] + gap >= c[0] and a[1] - gap <= c[3] and a[3] + gap >= c[1])
    assert all(any(g[0] <= x[0] and g[1] <= x[1] and g[2] >= x[2] and g[3] >= x[3] for g in got) for x in b)


def test_merge_cases():
    assert len(regions.merge_boxes([(0, 0, 10, 10), (20, 0, 30, 10)], 100)) == 1
    assert len(regions.merge_boxes([(0, 0, 10, 10), (410, 0, 420, 10)], 50)) == 2
    assert len(regions.merge_boxes([], 5)) == 0


def _path(box, lines=(), rects=()):
    return {"box": box, "lines": list(lines), "rects": list(rects)}


def _regions(spark, *pages):
    """The regions of pages given as (width_pt, height_pt, width, height, paths, texts)."""
    floats = lambda rows: [[float(v) for v in row] for row in rows]
    held = [
        (i, w, h, float(wp), float(hp), 0, [{"box": floats([p["box"]])[0], "lines": floats(p["lines"]), "rects": floats(p["rects"])} for p in paths], floats(texts))
        for i, (wp, hp, w, h, paths, texts) in enumerate(pages)
    ]
    kinds = f"page_id long, width long, height long, width_pt double, height_pt double, n_images int, paths {regions._PATHS}, texts array<array<double>>"
    df = spark.createDataFrame(held, kinds)
    out = [[] for _ in pages]
    for row in vector_plan.vector_regions(df, *vector_plan.nested_paths(df)).orderBy("page_id", "seq").collect():
        out[row.page_id].append(row)
    return out


def test_vector_regions(spark):
    rng = np.random.default_rng(1)
    near = lambda x0, y0, x1, y1: [_path((x0, y0, x1, y1))] + [_path((x := x0 + rng.integers(0, 400), y := y0 + rng.integers(0, 100), x + 300, y + 200)) for _ in range(7)]
    border = [_path((50, 50, 2542, 1678), lines=[(50, 50, 2542, 50), (2542, 50, 2542, 1678), (2542, 1678, 50, 1678), (50, 1678, 50, 50)])]
    grid = [_path((100, 100 + 50 * i, 600, 100 + 50 * i), [(100, 100 + 50 * i, 600, 100 + 50 * i)]) for i in range(5)]
    grid += [_path((100 + 125 * i, 100, 100 + 125 * i, 300), [(100 + 125 * i, 100, 100 + 125 * i, 300)]) for i in range(5)]
    few, two, bordered, table = _regions(
        spark,
        (612, 792, 1275, 1650, [_path((0, 0, 5, 5))] * 5, []),
        (2592, 1728, 5400, 3600, near(50, 50, 800, 400) + near(1500, 1000, 2400, 1400), []),
        (2592, 1728, 5400, 3600, border + near(300, 300, 900, 700) + near(300, 300, 900, 700), []),
        (792, 612, 1650, 1275, grid, []),
    )
    assert few == [] and len(two) >= 2
    assert bordered and not any(r.width > 0.9 * 5400 and r.height > 0.9 * 3600 for r in bordered)
    assert any(r.content_hint == "table" for r in table)


def test_frames_claim_and_hold(spark):
    """Of nearly equal frames the first stands, one within another goes, what a frame holds isn't merged again, texts make notes."""
    frame = lambda x, y, w, h: _path((x, y, x + w, y + h), rects=[(x, y, x + w, y + h)])
    small = [_path((120 + 30 * k, 120, 140 + 30 * k, 140)) for k in range(8)]
    alone = [_path((1500 + 90 * k, 1200, 1560 + 90 * k, 1300)) for k in range(4)]
    texts = [(1500 + 20 * k, 1320, 1515 + 20 * k, 1330) for k in range(20)]
    (got,) = _regions(spark, (2592, 1728, 5184, 3456, [frame(100, 100, 900, 900), frame(104, 97, 900, 900), frame(200, 200, 500, 500), *small, *alone], texts))
    assert [(r.x, r.y, r.width, r.height, r.confidence, r.content_hint) for r in got] == [
        (200, 200, 1800, 1800, 0.9, "drawing_view"), (3000, 2400, 790, 260, 0.85, "notes"),
    ]


def test_splits_and_tiles():
    density = np.r_[np.full(100, 0.5), np.full(50, 0.01), np.full(100, 0.5)]
    assert regions.blank_splits(density) == [125] and regions.blank_splits(np.full(100, 0.0)) == []
    (split,) = regions.minimum_splits(density, 1, 30)
    assert 90 < split < 160
    blank = np.full((3000, 4000), 255, np.uint8)
    got = regions.content_tiles(blank)
    assert len(got) >= 2 and sum(r["width"] * r["height"] for r in got) >= 0.5 * blank.size
    assert [r["region_type"] for r in regions.detect("auto", blank)][0] == "full_page" and len(regions.detect("auto", np.zeros((600, 800), np.uint8))) == 1
    for method in ("pdf_vector", "other"):
        with pytest.raises(ValueError):
            regions.detect(method, blank)


def test_a_page_without_paths(spark):
    page = regions.drawn_pages(spark.range(3).withColumnRenamed("id", "page_id"))
    got = vector_plan.page_regions(page, "auto").groupBy("page_id").agg(F.collect_set("region_type").alias("t"), F.count("*").alias("n"))
    assert {r.page_id: (sorted(r.t), r.n) for r in got.collect()} == {0: (["detected", "full_page"], 3), 1: (["detected", "full_page"], 3), 2: (["full_page", "tile"], 5)}
    with pytest.raises(Exception, match="needs the page's paths"):
        vector_plan.page_regions(page, "pdf_vector").collect()
    with pytest.raises(ValueError, match="Unknown"):
        vector_plan.page_regions(page, "other")


def test_tiles_agree(spark):
    sizes = [(i, w, h) for i, (w, h) in enumerate([(4000, 3000), (1801, 1800), (100, 9000), (250, 5000), (7300, 2000)])]
    got = regions.tiles(spark.createDataFrame(sizes, "page_id long, width long, height long")).collect()
    want = {(i, t["x"], t["y"], t["width"], t["height"], t["label"]) for i, w, h in sizes for t in regions.page_tiles(w, h)}
    assert {tuple(r) for r in got} == want


def test_verified_keys(spark):
    """Orphans, nulls, repeated targets, a target without a key, a table without rows."""
    frames = {
        "owners": spark.createDataFrame([(1,), (2,), (2,), (None,)], "id long"),
        "cats": spark.createDataFrame([(1, 1), (2, 1), (3, 7), (4, None), (5, 2), (6, 1)], "id long, owner_id long"),
        "dogs": spark.createDataFrame([], "id long, owner_id long, cat_id long"),
        "walks": spark.createDataFrame([("x", 5)], "shoe_id string, n int"),
        "shoes": spark.createDataFrame([("x",)], "name string"),
    }
    found = ingestion.discover(spark, frames)["relationships"]
    got = {tuple(r)[:3]: tuple(r)[3:] for r in ingestion.verified(found, frames).collect()}
    assert got == {("cats", "owner_id", "owners"): (5, 1, 3), ("dogs", "owner_id", "owners"): (0, 0, 0), ("dogs", "cat_id", "cats"): (0, 0, 0)}
    assert ingestion.verified(found.limit(0), frames).count() == 0


def test_search_dispatch():
    with pytest.raises(ValueError):
        retrieval.search("x", "nope", {})
    assert retrieval.profile_name("hybrid", True) == "hybrid_sim" and retrieval.parse_profile("hybrid_sim") == ("hybrid", True)
    cache = retrieval.ResultCache(2)
    for k in (1, 2, 1, 3):
        cache.put(k, k)
    assert cache.get(2) is None and cache.get(1) == 1 and retrieval.ResultCache.query_id("a", "b") == retrieval.ResultCache.query_id("a", "b")


def test_text_cases(spark):
    v = spark.createDataFrame([("the of and",), ("The token",), (None,)], "v string")
    assert [r[0] for r in v.select(strings.without_stop_words(F.col("v"))).collect()] == ["the of and", "token", None]
    assert spark.range(1).select(nested.scored(F.lit("nope"), 3), nested.freshness(F.lit(10), 10)).first()[1] == 1.0
    assert strings.glob_regex("webhook_*") == "^webhook_.*$" and DEFAULT.max_regions == 12


def test_agent_and_models():
    found = {"q": [(5, "five"), (2, "two")], "r": [(2, "two"), (9, "nine")]}
    plan = [("search", "q"), ("search", "r"), ("text", "1"), ("text", "77"), ("answer", "ok")]
    got = serving.Agent(found.get, lambda log: plan[len(log)]).run()
    assert got == {"answer": "ok", "documents": [5, 2, 9]}
    assert serving.Agent(found.get, lambda log: ("search", "q"), steps=2).run()["answer"] is None
    with pytest.raises(ValueError):
        serving.Models({"a": (1, etl.hashed_model)}).make("b")


def test_files_from_a_folder(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"ok one\ftwo")
    (tmp_path / "b.pdf").write_bytes(b"bad")
    (tmp_path / "c.txt").write_bytes(b"no")
    f = etl.files(spark, f"file://{tmp_path}").withColumn("filename", strings.basename(F.col("path")))

    def render(content):
        if content == b"bad":
            raise ValueError("encrypted")
        return [(content, t.decode()) for t in content.split(b"\f")]

    p = etl.pages(f, render)
    assert sorted((r["filename"], r["page_number"], r["error"]) for r in p.collect() if r["error"] is None) == [("a.pdf", 1, None), ("a.pdf", 2, None)]
    assert [r["error"] for r in p.where("error is not null").collect()] == ["encrypted"]
    ids = [r["id"] for r in etl.page_documents(p).orderBy("page_number").collect()]
    assert ids[0].startswith("a_pdf_") and ids[0].endswith("_page_1") and len(ids) == 2


def test_stream_replaces_by_key(spark, tmp_path):
    from tessera.streaming import sync_stream

    schema = "id long, v string, t long"
    src, store = f"{tmp_path}/in", sinks.SnapshotStore(spark, f"file://{tmp_path}/out", "id")
    run = lambda: sync_stream.sync_available(spark, src, spark.createDataFrame([], schema).schema, store, f"{tmp_path}/check", "id", ("t",), 1)
    spark.createDataFrame([(1, "a", 1), (2, "b", 5)], schema).coalesce(1).write.parquet(src)
    run()
    spark.createDataFrame([(1, "new", 2), (2, "older", 4), (3, "c", 1)], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    run()
    assert sorted(tuple(r) for r in store.read().collect()) == [(1, "new", 2), (2, "b", 5), (3, "c", 1)]

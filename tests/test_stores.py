"""Snapshots in buckets, places over ranges, queries of many tokens, labels that fail."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.operators import etl, ranks, regions, retrieval, text_index
from tessera.sources import tables
from tessera.sources.sinks import SnapshotStore


def stored(store):
    return sorted(tuple(r) for r in store.read().collect())


def test_changes_rewrite_their_buckets_alone(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s", "id", buckets=8)
    assert store.read() is None and store.version() == 0
    rows = lambda *r: spark.createDataFrame(r, "id long, v string")
    store.upsert(rows(*[(i, "a") for i in range(100)]))
    before = store._manifest(1)
    store.upsert(rows((5, "b"), (500, "c"), (5, "b")))
    after = store._manifest(2)
    changed = {b for b in after if after[b] != before.get(b)}
    assert 1 <= len(changed) <= 2
    assert stored(store) == sorted([(i, "b" if i == 5 else "a") for i in range(100)] + [(500, "c")])
    store.update(rows((5, "x"), (6, None), (7000, "y")), ["v"])
    assert dict(stored(store))[5] == "x" and dict(stored(store))[6] == "a" and 7000 not in dict(stored(store))
    store.delete(rows(*[(i, "") for i in range(90)]))
    assert stored(store) == sorted([(i, "a") for i in range(90, 100)] + [(500, "c")])
    assert store.versions() == [3, 4]  # older ones are gone


def test_of_two_writers_one_is_told(spark, tmp_path):
    one, two = (SnapshotStore(spark, f"file://{tmp_path}/s", "id", buckets=4) for _ in range(2))
    rows = spark.createDataFrame([(1, "a")], "id long, v string")
    one.upsert(rows)
    with pytest.raises(Exception, match="done-1"):
        two._commit(rows, {0, 1, 2, 3}, 0)  # it began before the other had ended
    assert stored(one) == [(1, "a")]


def test_places(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"), "id").repartition(7)
    got = sorted((r["k"], r["place"]) for r in ranks.numbered(rows, "k").collect())
    assert [p for _, p in got] == list(range(1, 1001))
    assert ranks.numbered(rows.limit(0), "k").count() == 0


def test_too_many_tokens_are_an_error(spark):
    from tessera.config import Settings

    t = spark.range(12).select(F.col("id").alias("tok"))
    assert retrieval.whole_query(t, Settings(most_query_tokens=12)).count() == 12
    with pytest.raises(Exception, match="more than 11 tokens"):
        retrieval.whole_query(t, Settings(most_query_tokens=11)).collect()


def test_fields_of_bm25_are_scored_apart(spark):
    docs = spark.createDataFrame([(1, "red fox", "x"), (2, "blue", "fox fox"), (3, None, None), (4, "dog", "dog")], "id long, a string, b string")
    got = {r["id"]: r for r in text_index.bm25_fields(docs, "id", {"a": ["fox"], "b": ["fox"]}).collect()}
    one = {r["id"]: r["score"] for r in text_index.bm25(docs, "id", "b", ["fox"]).collect()}
    assert set(got) == {1, 2} and got[1]["score_b"] == 0 and got[2]["score_b"] == pytest.approx(one[2])
    assert text_index.bm25_fields(docs, "id", {"a": []}).count() == 0


def test_overlap_of_marks(spark):
    rows = spark.createDataFrame([(1, datetime(2024, 1, 1, 11)), (2, datetime(2024, 1, 1, 11, 59)), (3, datetime(2024, 1, 1, 13))], "id long, t timestamp_ntz")
    ids = lambda **k: sorted(r["id"] for r in tables.incremental(rows, "t", datetime(2024, 1, 1, 12), **k).collect())
    assert ids() == [3] and ids(overlap_s=600) == [2, 3] and ids(overlap_s=600, until=datetime(2024, 1, 1, 12)) == [2]


def test_rows_around_a_change_hold_all_that_differ(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s", "id", buckets=2)
    docs = lambda rows: spark.createDataFrame(rows, "id long, text string")
    store.upsert(docs([(i, f"t{i}") for i in range(50)] + [(99, None)]))
    store.change(docs([(3, "new"), (60, "came"), (4, "t4"), (9, "gone wins")]), docs([(7, ""), (9, "")]))
    was, now = (sorted(tuple(r) for r in x.collect()) for x in store.around(1, 2))
    assert was == [(3, "t3"), (7, "t7"), (9, "t9")] and now == [(3, "new"), (60, "came")]
    was, now = (sorted(tuple(r) for r in x.collect()) for x in store.around(1, 2, slots=1))  # all share a slot: what didn't change is on both sides
    assert len(was) == 51 and len(now) == 50 and len(set(was) & set(now)) == 48


def test_a_first_upsert_asks_for_its_rows_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def each(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    store = SnapshotStore(spark, f"file://{tmp_path}/s", "id", buckets=4)
    store.upsert(spark.range(100).mapInPandas(each, "id long"))
    assert seen.value == 100 and store.read().count() == 100


def test_vectors_leave_in_small_frames(spark):
    import numpy as np

    model = etl.hashed_model(16, 2)
    rows = spark.createDataFrame([(i, None if i == 3 else f"t{i}") for i in range(etl.EMBED_ROWS + 40)], "id long, text string").coalesce(1)
    for r in etl.embed(rows, model).collect():
        want = model([r["text"] or ""])[0]
        assert np.array_equal(np.array(r["vectors"], np.float32), want.astype(np.float32))
        assert r["packed"] == [np.packbits(p > 0).view(np.int8).tolist() for p in want]


def test_overlapping_boxes_meet_once(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = []
    for i in range(120):
        x, y, w, h = (int(v) for v in rng.integers(-300, 900, 4))
        rows.append((i % 3, i, x, y, x + abs(w) + 1, y + abs(h) + 1))
    boxes = spark.createDataFrame(rows, "page_id long, box long, x0 long, y0 long, x1 long, y1 long")
    got = sorted((r["box"], r["o_box"]) for r in regions.overlaps(boxes, boxes).collect())
    want = sorted((a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and b[2] < a[4] and b[4] > a[2] and b[3] < a[5] and b[5] > a[3])
    assert got == want


def test_equal_boxes_meet_as_one_and_lose_no_pair(spark):
    rows = [(1, i, 0, 0, 10 + i % 2, 300) for i in range(11)]  # two places, in blocks of four rows
    boxes = spark.createDataFrame(rows, "page_id long, box long, x0 long, y0 long, x1 long, y1 long")
    other = boxes.withColumns({"box": F.col("box") + 100, "note": F.concat(F.lit("n"), "box")})
    got = regions.overlaps(boxes, other, block=4)
    assert got.columns == [*boxes.columns, *[f"o_{c}" for c in other.columns if c != "page_id"]]
    told = sorted((r["box"], r["x1"], r["o_box"], r["o_x1"], r["o_note"]) for r in got.collect())
    assert told == sorted((i, 10 + i % 2, 100 + j, 10 + j % 2, f"n{j}") for i in range(11) for j in range(11))


def test_labels_fall_back_one_by_one(spark):
    def model(texts):
        if "bad" in texts:
            raise TimeoutError
        return [t.upper() for t in texts]

    rows = spark.createDataFrame([(1, k, t) for k, t in enumerate(("a", "bad", "c", None))], "page_id long, region long, text string")
    got = {r["region"]: (r["label"], r["by_model"]) for r in etl.labelled(rows.coalesce(1), model).collect()}
    assert got == {0: ("A", True), 1: ("region_1", False), 2: ("C", True), 3: ("", True)}

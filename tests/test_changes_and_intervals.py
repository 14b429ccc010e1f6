"""Merge on read against a dictionary; interval joins against every pair."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import intervals
from tessera.sources.change_store import ChangeStore


def size_of(path):
    return sum(p.stat().st_size for p in path.rglob("*") if p.is_file())


def test_changes_are_applied_at_reading(spark, tmp_path):
    rng, held = random.Random(3), {}
    store = ChangeStore(spark, f"file://{tmp_path}/s", "id", buckets=4, compact_after=7)
    rows = lambda r: spark.createDataFrame(r, "id long, v string, n int")
    assert store.read() is None
    for step in range(18):
        ids = rng.sample(range(40), 6)
        kind = ("upsert", "delete", "update")[step % 3]
        if kind == "upsert":
            new = [(i, f"s{step}", step if i % 2 else None) for i in ids]
            held.update({i: (v, n) for i, v, n in new})
            store.upsert(rows(new))
        elif kind == "delete":
            for i in ids:
                held.pop(i, None)
            store.delete(rows([(i, None, None) for i in ids]))
        else:
            new = [(i, f"u{step}" if i % 3 else None, step) for i in ids]
            for i, v, n in new:
                if i in held:
                    held[i] = (v if v is not None else held[i][0], n)
            store.update(rows(new), ["v", "n"])
        assert sorted(map(tuple, store.read().collect())) == sorted((i, *x) for i, x in held.items())
    before = store.version()
    store.compact()
    assert store.version() > before and store._pointer(store.version())[1] == []
    assert sorted(map(tuple, store.read().collect())) == sorted((i, *x) for i, x in held.items())


def test_a_small_change_writes_little(spark, tmp_path):
    store = ChangeStore(spark, f"file://{tmp_path}/s", "id", buckets=2)
    store.upsert(spark.range(40_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v")))
    store.compact()
    whole = size_of(tmp_path)
    store.upsert(spark.createDataFrame([(5, "new")], "id long, v string"))
    store.delete(spark.createDataFrame([(6,)], "id long"))
    assert size_of(tmp_path) - whole < 0.01 * whole
    assert store.read().where("id IN (5, 6)").collect() == [(5, "new")] and store.read().count() == 39_999


def test_older_versions_and_second_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "id long, v string")
    one, two = (ChangeStore(spark, f"file://{tmp_path}/s", "id", buckets=2) for _ in range(2))
    one.upsert(rows)
    one.upsert(rows.withColumn("v", F.lit("b")))
    assert one.read(1).collect() == [(1, "a")] and one.read().collect() == [(1, "b")]
    with pytest.raises(Exception, match="pointer-2"):
        two._point(2, 0, [])


def test_overlaps_equal_all_pairs(spark):
    rng = random.Random(7)

    def some(n, longest):
        return [(rng.choice(["a", "b", None]), i, x := rng.randrange(-500, 500), x + int(rng.random() ** 4 * longest) - (i % 29 == 0)) for i in range(n)]

    left, right = some(300, 900), some(250, 60)
    left += [("a", 900, -10_000, 10_000), ("a", 901, 5, 5), ("a", 901, 5, 5), ("b", 902, None, 3)]
    a, b = (spark.createDataFrame(r, "k string, i int, low long, high long") for r in (left, right))
    got = sorted((r.i, r.o_i) for r in intervals.overlap_join(a, b, ["k"]).collect())
    good = lambda r: r[0] is not None and r[2] is not None and r[2] <= r[3]
    want = sorted((x[1], y[1]) for x in left for y in right if good(x) and good(y) and x[0] == y[0] and x[2] <= y[3] and y[2] <= x[3])
    assert got == want and len(got) > 2000
    assert intervals.overlap_join(a.limit(0), b, ["k"]).count() == 0


def test_a_long_interval_is_in_few_bins(spark):
    rows = spark.createDataFrame([("a", 0, 10**12)], "k string, low long, high long")
    points = spark.range(1000).select(F.lit("a").alias("k"), (F.col("id") * 10**9).alias("low"), (F.col("id") * 10**9).alias("high"))
    assert intervals.overlap_join(rows, points, ["k"]).count() == 1000


def test_crossings(spark):
    rng = random.Random(2)
    lines = [[(rng.randrange(3), float(rng.randrange(100)), x := float(rng.randrange(100)), x + rng.randrange(1, 40)) for _ in range(80)] for _ in range(2)]
    h, v = (spark.createDataFrame(x, "page_id int, at double, low double, high double") for x in lines)
    got = sorted((r.page_id, r.h_at, r.h_low, r.v_at, r.v_low) for r in intervals.crossings(h, v).collect())
    want = sorted((p, a, lo, b, l2) for p, a, lo, hi in lines[0] for q, b, l2, h2 in lines[1] if p == q and lo <= b <= hi and l2 <= a <= h2)
    assert got == want and want

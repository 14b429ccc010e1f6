"""Keyed state of sightings: the stream against windows over the whole table, over any cut and after a restart."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("google.protobuf")

from tessera.streaming import presence as p  # noqa: E402
from tessera.streaming.sync_stream import arriving, run_available  # noqa: E402

HOUR = 3_600_000


@pytest.fixture
def keyed(spark):
    for k, v in p.state_store().items():
        spark.conf.set(k, v)
    yield spark
    for k in p.state_store():
        spark.conf.unset(k)


def write(spark, rows, path):
    timed = spark.createDataFrame(rows, "key string, ms long").select("key", F.timestamp_millis("ms").alias("ts"))
    timed.coalesce(1).write.mode("append").parquet(path)


def run(spark, path, at, missing):
    stream = arriving(spark, path, "key string, ts timestamp", files_per_batch=1)
    run_available(p.presence(stream, missing), f"{at}/out", f"{at}/marks")
    return sorted(tuple(r) for r in spark.read.schema(p.CHANGES).parquet(f"{at}/out").collect())


def test_stream_equals_windows_across_restarts(keyed, tmp_path):
    """Listings every hour; keys come, go and come back; rows are out of order by less than the delay."""
    spark, rng = keyed, random.Random(4)
    rows = []
    for k in range(12):
        away = set(rng.sample(range(40), 18)) if k % 3 else set()
        last = rng.randrange(10, 40)
        rows += [(f"k{k}", h * HOUR + rng.randrange(1000)) for h in range(k % 5, last) if h not in away]
    rows += [("end", 40 * HOUR), ("end", 41 * HOUR)]
    rows.sort(key=lambda r: r[1] + rng.randrange(HOUR // 2))
    folder = f"file://{tmp_path}/in"
    at = f"file://{tmp_path}"
    thirds = [rows[: len(rows) // 3], rows[len(rows) // 3 : len(rows) * 2 // 3], rows[len(rows) * 2 // 3 :]]
    for part in thirds:  # each is a run of its own: the state comes back from the checkpoint
        for a in range(0, len(part), 25):
            write(spark, part[a : a + 25], folder)
        got = run(spark, folder, at, 3 * HOUR)
    want = p.presence_batch(spark.read.schema("key string, ts timestamp").parquet(folder), 3 * HOUR)
    assert got == sorted(tuple(r) for r in want.collect())
    assert {c for _, c, _ in got} == {"insert", "delete"} and len(got) > 30


def test_batch_by_hand(spark):
    rows = [("a", 0), ("a", 2), ("a", 2), ("a", 9), ("b", 1), ("z", 100)]
    timed = spark.createDataFrame(rows, "key string, ms long").select("key", F.timestamp_millis("ms").alias("ts"))
    got = sorted(tuple(r) for r in p.presence_batch(timed, 3, late_ms=10).collect())
    assert got == [("a", "delete", 5), ("a", "delete", 12), ("a", "insert", 0), ("a", "insert", 9), ("b", "delete", 4), ("b", "insert", 1)]


def test_state_is_a_stay_and_not_its_sightings():
    """A bucket's state doesn't grow with the sightings; any cut of two keys' sightings tells the same."""
    import numpy as np
    import pandas as pd

    rng, missing = np.random.default_rng(2), 10
    ms = np.unique(rng.integers(0, 4000, 300))
    seen = pd.DataFrame({"key": [None if m % 2 else "a" for m in ms], "first": ms, "last": ms, "told": False})
    told = []
    for cuts in ((4100,), (900, 2000, 4100), tuple(range(100, 4200, 100))):
        stays, out, before = p.merged(seen.iloc[:0], missing), [], -1
        for now in cuts:
            part = seen[(seen["last"] > before) & (seen["last"] <= now + 50)].sample(frac=1, random_state=1)  # some are ahead of the mark, some come again
            stays = p.merged(pd.concat([stays, part]) if len(stays) else part, missing)
            changes, stays = p.passed(stays, now, missing)
            out += [tuple(r) for r in changes.to_numpy().tolist()]
            before = now
        assert stays.empty
        told.append(sorted(out, key=repr))
    assert told[0] == told[1] == told[2] and len(told[0]) > 40
    dense = pd.DataFrame({"key": "a", "first": range(1000), "last": range(1000), "told": False})
    assert p.merged(dense, missing).to_numpy().tolist() == [["a", 0, 999, False]]

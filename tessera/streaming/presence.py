"""Which keys a source still has, as keyed state over a stream of sightings.

A source that keeps no times of change is listed again and again; each listing sends a sighting (key, time) of every
record. A key is *inserted* when it is first seen and *deleted* when it hasn't been seen for ``missing`` after its last
sighting. What is kept of a key is its stays, each the first and the last sighting of a run without a gap of more than ``missing``,
however many sightings there are. Keys are dealt into buckets, and a bucket's stays are one state with one timer, at the next moment
that tells something: so a batch costs a call a bucket and not one a key. Neither the order within the watermark's delay nor the cut
into micro-batches changes the result, and a key that is never seen again is deleted without another row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGES = "key string, change string, at_ms long"
#: A row of arrays, a place for each stay: its key, first and last sighting, and whether its insert has been told.
STATE = "key array<string>, first array<long>, last array<long>, told array<boolean>"
FIELDS = ["key", "first", "last", "told"]


def merged(runs: pd.DataFrame, missing_ms: int) -> pd.DataFrame:
    """Stays of these runs (key, first, last, told) of sightings: those of a key that no gap of more than ``missing_ms`` parts are one."""
    if runs.empty:
        return runs
    code = pd.factorize(runs["key"], use_na_sentinel=False)[0]
    order = np.lexsort((runs["first"].to_numpy(), code))
    runs, code = runs.iloc[order].reset_index(drop=True), code[order]
    reach = runs["last"].groupby(code).cummax().to_numpy()
    starts = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (runs["first"].to_numpy()[1:] > reach[:-1] + missing_ms)])
    ends = np.r_[starts[1:], len(runs)] - 1
    told = np.logical_or.reduceat(runs["told"].to_numpy(dtype=bool), starts)
    return pd.DataFrame({"key": runs["key"].to_numpy()[starts], "first": runs["first"].to_numpy()[starts], "last": reach[ends], "told": told})


def passed(stays: pd.DataFrame, now: int, missing_ms: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """What the watermark ``now`` lets be told of these stays, as changes, and the stays that go on."""
    begun, gone = stays["first"] <= now, stays["last"] + missing_ms <= now
    new, old = stays[begun & ~stays["told"].astype(bool)], stays[gone]
    parts = [pd.DataFrame({"key": new["key"], "change": "insert", "at_ms": new["first"]}), pd.DataFrame({"key": old["key"], "change": "delete", "at_ms": old["last"] + missing_ms})]
    return pd.concat([x for x in parts if len(x)] or parts[:1], ignore_index=True), stays.assign(told=begun)[~gone]


def _processor(missing_ms: int) -> Callable:
    def step(bucket: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(FIELDS, state.get if state.exists else ([], [], [], []), strict=True))
        stays = pd.DataFrame({"key": pd.Series(held["key"], dtype=object)} | {c: np.array(held[c], dtype=np.int64) for c in ("first", "last")} | {"told": np.array(held["told"], dtype=bool)})
        if not state.hasTimedOut:
            for frame in frames:  # one at a time: a bucket's sightings needn't fit into memory
                ms = frame["ms"].to_numpy(dtype=np.int64)
                seen = pd.DataFrame({"key": frame["key"].astype(object), "first": ms, "last": ms, "told": False})
                stays = merged(pd.concat([stays, seen], ignore_index=True) if len(stays) else seen, missing_ms)
        now = state.getCurrentWatermarkMs()
        out, left = passed(stays, now, missing_ms)
        if len(left):
            state.update(tuple(left[c].tolist() for c in FIELDS))
            at = int(np.where(left["told"], left["last"] + missing_ms, left["first"]).min())
            state.setTimeoutTimestamp(max(at - 1, now, 1))  # it goes off once the watermark is beyond this
        elif state.exists:
            state.remove()
        if len(out):
            yield out

    return step


def presence(sightings: DataFrame, missing_ms: int, late: str = "1 hour", buckets: int = 512) -> DataFrame:
    """(key, change, at_ms) of a stream of (key string, ts timestamp); sightings later than ``late`` behind the latest are dropped.

    ``buckets``: one holds the stays of its share of the keys in memory while it is worked on."""
    timed = sightings.where("ts IS NOT NULL").withWatermark("ts", late)
    timed = timed.select("key", "ts", F.unix_millis("ts").alias("ms"), F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"))
    return timed.groupBy("bucket").applyInPandasWithState(_processor(missing_ms), CHANGES, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def state_store() -> dict[str, str]:
    """Settings of a session that keeps the state of many keys outside the executors' heap."""
    return {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def presence_batch(sightings: DataFrame, missing_ms: int, late_ms: int = 3_600_000) -> DataFrame:
    """What the stream says once all of a table has gone through it, by windows: gaps of more than ``missing_ms`` end a stay, and so does the
    end of a stay that lies as long before the last watermark."""
    ms = F.unix_millis("ts")
    rows = sightings.select("key", ms.alias("ms")).distinct()
    mark = F.broadcast(sightings.agg((F.max(ms) - late_ms).alias("mark")))  # one row
    over = W.partitionBy("key").orderBy("ms")
    rows = rows.join(mark).where("ms <= mark").withColumns({"before": F.lag("ms").over(over), "after": F.lead("ms").over(over)})
    starts = rows.where(F.col("before").isNull() | (F.col("ms") > F.col("before") + missing_ms)).select("key", F.lit("insert").alias("change"), F.col("ms").alias("at_ms"))
    end = F.col("ms") + missing_ms
    gone = rows.where(F.coalesce(F.col("after") > end, end <= F.col("mark"))).select("key", F.lit("delete").alias("change"), end.alias("at_ms"))
    return starts.unionByName(gone)

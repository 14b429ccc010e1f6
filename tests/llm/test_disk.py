"""What the pipeline's stages hold on disk: shuffled rows, shuffle files and intermediate tables."""

from __future__ import annotations

import random
import time
from pathlib import Path

from pyspark.sql import functions as F

from tessera.llm import signature_tree
from tessera.llm.common import CLEANUP, discard, materialise


def shuffled(spark) -> int:
    """Bytes that the session's tasks have written to shuffles."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def shuffle_files(spark) -> set[str]:
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {str(p) for at in manager.localDirs() for p in Path(at.getPath()).rglob("shuffle_*.data")}


def test_one_of_each_moves_rows_once(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.randbytes(6).hex() for _ in range(400)), "en", "a", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    docs = materialise(docs, "test-docs")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as where the kept ids are many
    try:
        kept = signature_tree.one_of_each(docs, signature_tree.Join())
        before = shuffled(spark)
        materialise(kept, "test-kept")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert 0 < shuffled(spark) - before < 1.3 * sum(len(r[1]) for r in rows)


def test_one_of_repeated_rows(spark):
    """Of rows equal in id and text that of the least hash of its JSON stays, and one of equal rows."""
    texts = ["a b c d e f g", "a b c d e f g h", "", None, "other words than these", "A b c d e f g"]
    rows = [(i % 4 if i % 4 else None, texts[i % 6], "xyz"[i % 3], str(i % 5), i % 2) for i in range(200)]
    rows += [(90, "a row that stands alone in the table", "x", "y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kid long").repartition(5)
    found = signature_tree.one_of_each(docs, signature_tree.Join())
    assert found.columns == docs.columns
    turn = F.xxhash64(F.to_json(F.struct(*docs.columns))).alias("turn")
    least: dict[tuple, tuple] = {}
    for r in docs.select("*", turn).collect():
        key = r["doc_id"], r["text"] or ""
        least[key] = min(least.get(key, (r["turn"], None)), (r["turn"], tuple(r)[:-1]), key=lambda x: (x[0], x[1] is None))
    component = {(r["kid"], r["kh"]): r["label"] for r in signature_tree.near_components(docs).collect()}
    names = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(-(2**63))).alias("k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).distinct().collect()
    best: dict = {}
    for r in names:
        label = component[r["k"], r["h"]]
        group = ("row", r["k"], r["h"]) if label is None else label
        best[group] = min(best.get(group, (r["k"], r["h"], None)), (r["k"], r["h"], (r["doc_id"], r["text"])), key=lambda x: (x[0], x[1], x[2] is None))
    want = [least[x[2]][1] for x in best.values()]
    assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(map(repr, want))


def test_scratch_tables_leave_no_shuffle(spark):
    before, kept = shuffle_files(spark), spark.conf.get(CLEANUP, None)
    out = materialise(spark.range(10_000).selectExpr("id", "id % 7 AS k").repartition(3, "k").groupBy("id").count(), "test-shuffled")
    assert out.count() == 10_000 and spark.conf.get(CLEANUP, None) == kept
    until = time.time() + 20  # files are deleted in the background
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    # The count's own shuffle of one row a task is left to Spark.
    assert sum(Path(p).stat().st_size for p in left if Path(p).exists()) < 2_000
    discard(out)


def test_pipeline_keeps_one_table_of_a_stage(spark):
    import corpus_pipeline

    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) / "tessera"
    before = set(shared.glob("pipeline-*"))
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    left = [p.name.rpartition("-")[0] for p in set(shared.glob("pipeline-*")) - before]
    assert left == ["pipeline-secret-scans"] and out.count() > 0

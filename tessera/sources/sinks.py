"""Writers: versioned snapshots with a pointer, checkpoint logs, and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import synchronisation as sync


class SnapshotStore:
    """Documents of a store as versions of a Parquet table in buckets by the hash of their key.

    A change rewrites the buckets that its keys fall in, into a folder of the new version; the version's pointer, a
    manifest of the folder that each bucket is in, is written last and only if no other writer has made it,
    so a writer that dies leaves the version before, and of two writers one is told to try again. Writes are
    idempotent by key. Buckets that no manifest of the last ``keep`` versions names are deleted.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64, keep: int = 2) -> None:
        self.spark, self.path, self.key, self.buckets, self.keep = spark, path.rstrip("/"), key, buckets, keep

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        found = self._fs().globStatus(self._path("done-*")) or []
        return sorted(int(f.getPath().getName().split("-")[1]) for f in found)

    def version(self) -> int:
        """The last version with a pointer, 0 if there is none."""
        return max(self.versions(), default=0)

    def _manifest(self, version: int) -> dict[int, str]:
        """Bucket to folder; one line a bucket, and as many lines as buckets at most."""
        if not version:
            return {}
        lines = self.spark.read.text(f"{self.path}/done-{version}").collect()
        return {int(b): folder for b, folder in (line[0].split(" ") for line in lines)}

    def _folders(self, manifest: dict[int, str], only: set[int] | None = None) -> DataFrame | None:
        wanted = [f"{self.path}/{folder}" for b, folder in sorted(manifest.items()) if only is None or b in only]
        return self.spark.read.parquet(*wanted) if wanted else None

    def read(self, version: int | None = None) -> DataFrame | None:
        """The store as of a version, the last one by default; null if it has none."""
        return self._folders(self._manifest(self.version() if version is None else version))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _touched(self, ids: DataFrame) -> set[int]:
        return {r[0] for r in ids.select(self._bucket().alias("b")).distinct().collect()}

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("store_bucket", self._bucket()).repartition("store_bucket")

    def _commit(self, rows: DataFrame | None, touched: set[int], before: int) -> int:
        """Write the new content of the touched buckets, rows that are dealt, then the pointer."""
        version, manifest = before + 1, self._manifest(before)
        folder = f"v{version}-{uuid.uuid4().hex}"
        if rows is not None:
            rows.write.partitionBy("store_bucket").parquet(f"{self.path}/{folder}")
        written = {b for b in touched if self._fs().exists(self._path(f"{folder}/store_bucket={b}"))}
        manifest = {b: f for b, f in manifest.items() if b not in touched} | {b: f"{folder}/store_bucket={b}" for b in written}
        out = self._fs().create(self._path(f"done-{version}"), False)  # an error if another writer was first
        out.write(bytearray("\n".join(f"{b} {f}" for b, f in sorted(manifest.items())).encode()))
        out.close()
        self._clean()
        return version

    def _clean(self) -> None:
        versions = self.versions()
        for old in versions[: -self.keep]:
            held = {f for v in versions[-self.keep :] for f in self._manifest(v).values()}
            for folder in set(self._manifest(old).values()) - held:
                self._fs().delete(self._path(folder), True)
            self._fs().delete(self._path(f"done-{old}"), False)

    def change(self, rows: DataFrame | None, gone: DataFrame | None = None) -> int:
        """Upsert ``rows`` and delete the keys of ``gone`` in one version; of rows with one key any one counts.

        What is stored, what comes and what goes are dealt into buckets once, where the last of a key decides. A store without rows has no
        bucket to be read, so that the incoming rows aren't asked for theirs first."""
        before = self.version()
        manifest = self._manifest(before)
        parts = [x.select(self.key) for x in (rows, gone) if x is not None]
        touched = set().union(*[self._touched(x) for x in parts]) if manifest else set(range(self.buckets))
        now = self._folders(manifest, touched)
        ranked = [x.withColumn("store_rank", F.lit(i)) for i, x in enumerate((now, rows)) if x is not None]
        if not ranked:
            return self._commit(None, touched, before)
        if gone is not None:
            ranked.append(gone.where(F.col(self.key).isNotNull()).select(self.key, F.lit(2).alias("store_rank")))
        stacked = ranked[0]
        for x in ranked[1:]:
            stacked = stacked.unionByName(x, allowMissingColumns="store_rank" in x.columns and len(x.columns) == 2)
        last = F.row_number().over(W.partitionBy("store_bucket", self.key).orderBy(F.desc("store_rank")))
        kept = self._dealt(stacked).withColumn("store_last", last).where("store_last = 1 AND store_rank < 2")
        return self._commit(kept.drop("store_last", "store_rank"), touched, before)

    def around(self, before: int, after: int, slots: int = 1 << 20) -> tuple[DataFrame | None, DataFrame | None]:
        """(was, now): rows of two versions that hold all that differ, and of those that don't some, the same on both sides. Rows are compared
        by digests and looked up by slots of their keys, at most ``slots`` that every task gets, so that no row is shuffled."""
        old, new = self._manifest(before), self._manifest(after)
        touched = {b for b in old.keys() | new.keys() if old.get(b) != new.get(b)}
        was, now = self._folders(old, touched), self._folders(new, touched)
        if was is None or now is None:
            return was, now
        slot = F.pmod(F.xxhash64(self.key, F.lit("slot")), F.lit(slots)).alias("store_slot")
        digest = F.unhex(F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(now.columns)]), {"ignoreNullFields": "false"}), 256)).alias("digest")
        both = was.select(slot, digest, F.lit(-1).alias("sign")).unionByName(now.select(slot, digest, F.lit(1).alias("sign")))
        differ = both.groupBy("store_slot", "digest").agg(F.sum("sign").alias("n")).where("n <> 0").select("store_slot").distinct()
        was, now = (x.withColumn("store_slot", slot).join(F.broadcast(differ), "store_slot", "left_semi").drop("store_slot") for x in (was, now))
        return was, now

    def difference(self, before: int, after: int) -> tuple[DataFrame | None, DataFrame | None]:
        """(gone, came): the rows of one version that the other doesn't have, from the buckets that were rewritten between them."""
        old, new = self._manifest(before), self._manifest(after)
        touched = {b for b in old.keys() | new.keys() if old.get(b) != new.get(b)}
        was, now = self._folders(old, touched), self._folders(new, touched)
        if was is None or now is None:
            return was, now
        return was.exceptAll(now), now.exceptAll(was)

    def upsert(self, rows: DataFrame) -> int:
        """Rows in the place of those with their keys."""
        return self.change(rows)

    def update(self, rows: DataFrame, fields: list[str]) -> int:
        """These fields of stored rows; keys that the store doesn't have are left out."""
        before = self.version()
        touched = self._touched(rows)
        now = self._folders(self._manifest(before), touched)
        return self._commit(None if now is None else self._dealt(sync.update_fields(now, rows, self.key, fields)), touched, before)

    def delete(self, ids: DataFrame) -> int:
        return self.change(None, ids)


def append_checkpoint(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(path)


def null_sink(df: DataFrame) -> None:
    """Run the plan and drop its rows."""
    df.write.format("noop").mode("overwrite").save()


def feed_results(rows: DataFrame, ok: str) -> DataFrame:
    """(doc_id, success, error) of each row, by a condition that says what a store would take."""
    good = F.coalesce(F.expr(ok), F.lit(False))
    return rows.select("doc_id", good.alias("success"), F.when(~good, F.lit("rejected")).alias("error"))


def schema_json(columns: DataFrame) -> DataFrame:
    """(table_name, json): each table's columns as a JSON document."""
    one = columns.groupBy("table_name").agg(F.array_sort(F.collect_list(F.struct("position", "column_name", "data_type", "nullable"))).alias("columns"))
    return one.select("table_name", F.to_json(F.struct("table_name", "columns")).alias("json"))


def posted(rows: DataFrame, code: str, body: str, chars: int = 200) -> DataFrame:
    """The answers to documents posted one by one: codes 200 and 201 are taken; any other is an error with its code and
    the first characters of the answer."""
    ok = F.coalesce(F.col(code).isin(200, 201), F.lit(False))
    said = F.concat(F.col(code).cast("string"), F.lit(": "), F.substring(F.coalesce(body, F.lit("")), 1, chars))
    return rows.withColumn("success", ok).withColumn("error", F.when(~ok, said))

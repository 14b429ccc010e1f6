"""A store whose changes are files beside its buckets, applied when it is read."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.sinks import SnapshotStore

GONE, STEP, PATCHED = "__gone", "__step", "__patched"


class ChangeStore:
    """Merge on read: a base in buckets (``SnapshotStore``) and, since its version, a folder for each change.

    A change writes its own rows and nothing else: whole rows of upserts, keys of deletions, keys and fields of updates. Reading
    takes of each changed key the last whole row or deletion, from the base if there is none, and puts later fields over it. A
    pointer, a file that names the base's version and the changes in order, is made last and exclusively, so
    a writer that dies leaves the version before and of two writers one is told to try again. After ``compact_after`` changes they
    are merged into the base's touched buckets.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64, compact_after: int = 16) -> None:
        self.spark, self.path, self.key, self.compact_after = spark, path.rstrip("/"), key, compact_after
        self.base = SnapshotStore(spark, f"{self.path}/base", key, buckets)

    def _at(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        at, fs = self._at("pointer-*")
        return sorted(int(f.getPath().getName().split("-")[1]) for f in fs.globStatus(at) or [])

    def version(self) -> int:
        return max(self.versions(), default=0)

    def _pointer(self, version: int) -> tuple[int, list[str]]:
        """(base version, change folders in order)."""
        if not version:
            return 0, []
        lines = self.spark.read.text(f"{self.path}/pointer-{version}", wholetext=True).first()[0].split("\n")
        return int(lines[0]), lines[1:]

    def _point(self, version: int, base: int, folders: list[str]) -> int:
        at, fs = self._at(f"pointer-{version}")
        out = fs.create(at, False)  # an error if another writer was first
        out.write(bytearray("\n".join([str(base), *folders]).encode()))
        out.close()
        return version

    def _log(self, rows: DataFrame) -> int:
        before = self.version()
        base, folders = self._pointer(before)
        folder = f"change-{before + 1}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        version = self._point(before + 1, base, [*folders, folder])
        if len(folders) + 1 >= self.compact_after:
            self.compact()
        return version

    def upsert(self, rows: DataFrame) -> int:
        """Whole rows in the place of those with their keys; of rows with one key any one counts."""
        return self._log(rows.dropDuplicates([self.key]).withColumns({GONE: F.lit(False), PATCHED: F.lit(None).cast("array<string>")}))

    def delete(self, ids: DataFrame) -> int:
        return self._log(ids.select(self.key).distinct().withColumns({GONE: F.lit(True), PATCHED: F.lit(None).cast("array<string>")}))

    def update(self, rows: DataFrame, fields: list[str]) -> int:
        """These fields of stored rows; a null leaves the old value, keys that the store doesn't have are left out."""
        kept = rows.select(self.key, *fields).dropDuplicates([self.key])
        return self._log(kept.withColumns({GONE: F.lit(False), PATCHED: F.array(*map(F.lit, fields))}))

    def read(self, version: int | None = None) -> DataFrame | None:
        """The store as of a version, the last one by default; null if it has none."""
        base_version, folders = self._pointer(self.version() if version is None else version)
        base = self.base.read(base_version) if base_version else None
        if not folders:
            return base
        changes = None
        for step, folder in enumerate(folders):
            part = self.spark.read.parquet(f"{self.path}/{folder}").withColumn(STEP, F.lit(step))
            changes = part if changes is None else changes.unionByName(part, allowMissingColumns=True)
        columns = base.columns if base is not None else [c for c in changes.columns if c not in (GONE, STEP, PATCHED)]
        for c in columns:  # a log of deletions or updates alone has fewer
            if c not in changes.columns:
                changes = changes.withColumn(c, F.lit(None).cast(base.schema[c].dataType))
        return self._merged(base, changes, columns)

    def _merged(self, base: DataFrame | None, changes: DataFrame, columns: list[str]) -> DataFrame:
        """One row a changed key is all that the shuffle of changes ends in; base rows are asked only whether theirs is among them."""
        rest = [c for c in columns if c != self.key]
        whole = F.col(PATCHED).isNull()
        row = F.struct(*rest)
        last = F.max_by(F.struct(GONE, row.alias("row"), STEP), F.when(whole, F.col(STEP)))
        patches = F.array_sort(F.collect_list(F.when(~whole, F.struct(STEP, row.alias("row")))))
        state = changes.groupBy(self.key).agg(F.when(F.count_if(whole) > 0, last).alias("last"), patches.alias("patches"))
        # Of each field the last value that a patch after the last whole row has; the number of changes bounds the list.
        floor = F.coalesce(F.col("last")[STEP], F.lit(-1))

        def patched(name: str) -> Column:
            later = F.filter("patches", lambda p: (p[STEP] > floor) & p["row"][name].isNotNull())
            return F.when(F.size(later) > 0, F.element_at(F.transform(later, lambda p: p["row"][name]), F.lit(-1)))

        newest = {c: patched(c) for c in rest}
        state = state.select(self.key, "last", *[v.alias(f"new_{c}") for c, v in newest.items()])
        told = state.where(F.col("last").isNotNull() & ~F.col("last")[GONE])
        out = told.select(self.key, *[F.coalesce(f"new_{c}", F.col("last")["row"][c]).alias(c) for c in rest]).select(*columns)
        if base is None:
            return out
        kept = base.join(state.select(self.key, F.col("last").isNotNull().alias("over"), *[f"new_{c}" for c in rest]), self.key, "left")
        kept = kept.where(~F.coalesce("over", F.lit(False)))
        return kept.select(*[F.coalesce(f"new_{c}", c).alias(c) if c != self.key else F.col(c) for c in columns]).unionByName(out)

    def compact(self) -> int:
        """Merge the changes into the base, rewriting the buckets of changed keys, and point to it; then they go."""
        before = self.version()
        base_version, folders = self._pointer(before)
        if not folders:
            return before
        now = self.read(before)
        keys = None
        for folder in folders:
            part = self.spark.read.parquet(f"{self.path}/{folder}").select(self.key)
            keys = part if keys is None else keys.unionByName(part)
        keys = keys.distinct()
        fresh = now.join(keys, self.key, "left_semi")
        gone = keys.join(now, self.key, "left_anti")
        version = self._point(before + 1, self.base.change(fresh, gone), [])
        for folder in folders:  # versions before this one can't be read any more
            at, fs = self._at(folder)
            fs.delete(at, True)
        for old in self.versions()[:-1]:
            at, fs = self._at(f"pointer-{old}")
            fs.delete(at, False)
        return version

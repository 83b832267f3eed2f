"""A table that streams can upsert into: bucketed files that never change, and one small pointer for each commit.

A batch rewrites the buckets that hold its keys into new files and then writes one row to ``commits``: the version, where
every bucket's files are, and the last batch of each source. The row is one file that appears at once, so a reader sees
all of a batch or nothing. A batch that was stopped half way leaves files that no commit names; a batch that comes again
after its commit is left out.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from voxlake.operators.lifecycle import merge_maps
from voxlake.plans.spread import spread

BUCKET = "vt_bucket"
COMMIT_SQL = "version long, schema string, batches map<string,long>, folders map<int,string>"
Merge = Callable[[DataFrame, DataFrame], DataFrame]


def replace_rows(keys: list[str]) -> Merge:
    """New rows take the place of held ones with their keys; the batch has one row a key."""

    def merge(held: DataFrame, new: DataFrame) -> DataFrame:
        return spread(held, keys).join(new.select(*keys), keys, "left_anti").unionByName(new.select(*held.columns))

    return merge


def merge_states(key: str = "task_id", state: str = "state") -> Merge:
    """Shallow merge of state maps: the keys of a new one win, and of several new ones for one project those with the
    larger ``seq``; new projects are added."""

    def merge(held: DataFrame, new: DataFrame) -> DataFrame:
        fields = new.select(key, "seq", F.explode(state).alias("name", "value")).groupBy(key, "name").agg(F.max_by("value", F.struct("seq", "value")).alias("value"))
        newest = fields.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("__new"))
        known = new.select(key).distinct().join(newest, key, "left")  # a project may come with an empty map
        return spread(held, [key]).join(known, key, "full").select(key, merge_maps(F.col(state), F.col("__new")).alias(state))

    return merge


@dataclass(frozen=True)
class VersionedTable:
    """Rows by ``keys`` in ``buckets`` of the ``by`` columns (all keys by default) below ``path``, a folder that
    all machines share. A bucket is rewritten by one task, so their number follows the size of the table. One writer
    at a time, as a stream is."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    buckets: int = 64
    by: tuple[str, ...] = ()

    def create(self, rows: DataFrame) -> bool:
        """Version 0, with these rows; False where the table is there already."""
        if self.head() is not None:
            return False
        self._commit(0, rows.schema.json(), {}, self._write(rows))
        return True

    def head(self, version: int | None = None) -> Row | None:
        """The last commit, or the one asked for; None where there is none."""
        if not self._exists("commits"):
            return None
        commits = self.spark.read.schema(COMMIT_SQL).parquet(self._at("commits"))
        wanted = commits if version is None else commits.where(F.col("version") == version)
        return wanted.orderBy(F.col("version").desc()).first()

    def read(self, version: int | None = None, near: DataFrame | None = None) -> DataFrame:
        """The table as of a commit, the last one by default; ``near``: only the buckets that can hold its keys."""
        commit = self._known(version)
        return self._files(commit, None if near is None else self._touched(self._bucketed(near)))

    def holds(self, batch_id: int, source: str = "stream") -> bool:
        """Whether this batch of the source, or a later one, is in the table."""
        return self._known().batches.get(source, batch_id - 1) >= batch_id

    def upsert(self, batch: DataFrame, batch_id: int, source: str = "stream", merge: Merge | None = None) -> bool:
        """Merge a batch into the table (``replace_rows`` by default); False where this batch of the source is in it
        already. Rows without a key to their bucket are left out. ``merge`` gets the held rows of the batch's buckets
        and the batch."""
        if self.holds(batch_id, source):
            return False
        last = self._known()
        new = batch.dropna(subset=list(self.by or self.keys)).persist()
        try:
            touched = self._touched(self._bucketed(new))
            merged = (merge or replace_rows(list(self.keys)))(self._files(last, touched), new)
            written = self._write(merged) if touched else {}
            kept = {b: folder for b, folder in last.folders.items() if b not in touched}
            self._commit(last.version + 1, last.schema, {**last.batches, source: batch_id}, {**kept, **written})
        finally:
            new.unpersist()
        return True

    def sink(self, source: str = "stream", merge: Merge | None = None) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``."""
        
        def write(batch: DataFrame, batch_id: int) -> None:
            self.upsert(batch, batch_id, source, merge)

        return write

    def vacuum(self, keep: int = 10) -> None:
        """Delete the commits before the last ``keep`` ones, and the files that none of those left names."""
        commits = self.spark.read.schema(COMMIT_SQL).parquet(self._at("commits"))
        newest = commits.orderBy(F.col("version").desc()).limit(keep).collect()  # ``keep`` rows
        used = {folder.rsplit("/", 1)[0] for r in newest for folder in r.folders.values()}
        for r in commits.where(F.col("version") < min(r.version for r in newest)).select(F.input_file_name().alias("f")).toLocalIterator():
            self._delete(r.f)
        for name in self._names("data"):
            if f"data/{name}" not in used:
                self._delete(self._at(f"data/{name}"))

    def _known(self, version: int | None = None) -> Row:
        commit = self.head(version)
        if commit is None:
            raise ValueError(f"nothing is committed to {self.path}" + (f" as version {version}" if version is not None else ""))
        return commit

    def _at(self, name: str) -> str:
        return f"{self.path.rstrip('/')}/{name}"

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*(self.by or self.keys)), F.lit(self.buckets)).cast("int"))

    def _touched(self, bucketed: DataFrame) -> set[int]:
        return {r[0] for r in bucketed.select(BUCKET).distinct().collect()}  # ``buckets`` numbers at most

    def _files(self, commit: Row, only: set[int] | None = None) -> DataFrame:
        folders = sorted(folder for bucket, folder in commit.folders.items() if only is None or bucket in only)
        schema = StructType.fromJson(json.loads(commit.schema))
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self._at(f) for f in folders])

    def _write(self, rows: DataFrame) -> dict[int, str]:
        """New files for the rows, each bucket by a task of its own; where every bucket that has rows now is."""
        name = f"data/{uuid4().hex}"
        self._bucketed(rows).repartitionById(self.buckets, BUCKET).write.partitionBy(BUCKET).parquet(self._at(name))
        found = [n for n in self._names(name) if n.startswith(f"{BUCKET}=")]
        return {int(n.split("=")[1]): f"{name}/{n}" for n in found}

    def _commit(self, version: int, schema: str, batches: dict[str, int], folders: dict[int, str]) -> None:
        row = self.spark.createDataFrame([(version, schema, batches, folders)], COMMIT_SQL)
        row.coalesce(1).write.mode("append").parquet(self._at("commits"))

    # The folder may be in any store that Spark reaches, so it is listed as Spark does.
    def _file(self, path: str):
        context = self.spark.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(context._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        target, store = self._file(self._at(name))
        return store.exists(target)

    def _names(self, name: str) -> list[str]:
        target, store = self._file(self._at(name))
        return [s.getPath().getName() for s in store.listStatus(target)] if store.exists(target) else []

    def _delete(self, path: str) -> None:
        target, store = self._file(path)
        store.delete(target, True)

"""Stores of keyed rows: the latest row of each key, kept small by compaction."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from ..operators.state import latest_by_key
from ..scratch import remove

_FOLDERS = "version long, bucket int, folder string"


@dataclass(frozen=True)
class KeyedStore:
    """Rows of ``schema`` below ``path``; of the rows of a key (``keys``) the last by ``order`` counts, and it is gone if its column ``deleted``
    (a boolean that the schema may have) holds. Keys are dealt to ``buckets`` by hash.

    Changes are written as deltas; ``compact`` merges the deltas into a base with one row a key, rewriting only the buckets that they touch. A
    manifest, one small Parquet folder a version, names the folders that hold each bucket; the newest complete one counts. It is written
    last, so a job that fails leaves the state before it, with some files that nothing names, which ``vacuum`` removes. Reading costs
    the base and the deltas since the last compaction. One writer at a time."""

    path: str
    schema: StructType
    keys: tuple[str, ...]
    order: tuple[str, ...]
    buckets: int = 16

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("bucket")

    def manifest(self, spark: SparkSession) -> tuple[int, list[tuple[int, str]]]:
        """(version, [(bucket, folder)]) of the newest complete version; (0, []) of a store that isn't there. As many rows as buckets times
        deltas since the last compaction."""
        fs, root = _files(spark, f"{self.path}/manifest")
        if not fs.exists(root):
            return 0, []
        rows = spark.read.schema(_FOLDERS).option("recursiveFileLookup", True).parquet(f"{self.path}/manifest")
        last = rows.agg(F.max("version")).first()[0]
        if last is None:
            return 0, []
        # A version without folders has one row without a folder.
        return last, [(r.bucket, r.folder) for r in rows.where(F.col("version") == last).collect() if r.folder]

    def _publish(self, spark: SparkSession, version: int, folders: list[tuple[int, str]]) -> None:
        rows = [(version, b, f) for b, f in sorted(folders)] or [(version, None, None)]
        # What is there already is the start of a version that failed.
        spark.createDataFrame(rows, _FOLDERS).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{version}")

    def _write(self, rows: DataFrame, folder: str) -> list[tuple[int, str]]:
        """Writes rows by bucket; (bucket, folder) of the buckets that have some."""
        spark = rows.sparkSession
        # A name is written anew if the same micro-batch comes again.
        rows.select(*self.schema.names, self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{folder}")
        fs, root = _files(spark, f"{self.path}/{folder}")
        names = [s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()]
        return [(int(n.split("=")[1]), f"{folder}/{n}") for n in names if n.startswith("bucket=")]

    def _read(self, spark: SparkSession, folders: list[str]) -> DataFrame:
        if not folders:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def _latest(self, rows: DataFrame) -> DataFrame:
        return latest_by_key(rows, list(self.keys), list(self.order)).select(*self.schema.names)

    def _living(self, rows: DataFrame) -> DataFrame:
        return rows.where(~F.coalesce("deleted", F.lit(False))) if "deleted" in self.schema.names else rows

    def put(self, changes: DataFrame, name: str | None = None) -> None:
        """Adds changes. A ``name`` makes it safe to put them again: they are then stored once."""
        spark = changes.sparkSession
        version, held = self.manifest(spark)
        added = self._write(changes, f"delta-{name or uuid.uuid4().hex}")
        self._publish(spark, version + 1, list({*held, *added}))

    def put_stream(self, changes: DataFrame, name: str) -> DataStreamWriter:
        """Writer that puts each micro-batch of a stream; one that is written twice after a failure counts once."""
        return changes.writeStream.foreachBatch(lambda batch, i: self.put(batch, f"{name}-{i}"))

    def get_all(self, spark: SparkSession) -> DataFrame:
        _, held = self.manifest(spark)
        return self._living(self._latest(self._read(spark, [f for _, f in held])))

    def get(self, wanted: DataFrame) -> DataFrame:
        """Rows of the wanted keys; only their buckets are read."""
        spark = wanted.sparkSession
        _, held = self.manifest(spark)
        # At most ``buckets`` numbers.
        hit = {r.bucket for r in wanted.select(self._bucket()).distinct().collect()}
        rows = self._read(spark, [f for b, f in held if b in hit])
        return self._living(self._latest(rows.join(wanted.select(*self.keys).distinct(), list(self.keys), "left_semi")))

    def compact(self, spark: SparkSession) -> list[int]:
        """Merges the deltas into the base; the buckets that were rewritten."""
        version, held = self.manifest(spark)
        touched = sorted({b for b, f in held if f.startswith("delta-")})
        if touched:
            rows = self._living(self._latest(self._read(spark, [f for b, f in held if b in touched])))
            self._publish(spark, version + 1, [x for x in held if x[0] not in touched] + self._write(rows, f"base-{uuid.uuid4().hex}"))
        return touched

    def clear(self, spark: SparkSession) -> None:
        """An empty store."""
        self._publish(spark, self.manifest(spark)[0] + 1, [])

    def vacuum(self, spark: SparkSession) -> None:
        """Removes what the newest manifest doesn't name: older manifests, merged deltas, replaced bases, leavings of failed jobs. Not while others
        read an older version."""
        version, held = self.manifest(spark)
        fs, root = _files(spark, self.path)
        if not version:
            return
        named = {f for _, f in held} | {f"manifest/{version}"}
        for top in fs.listStatus(root):
            for inner in fs.listStatus(top.getPath()) if top.isDirectory() else []:
                folder = f"{top.getPath().getName()}/{inner.getPath().getName()}"
                if inner.isDirectory() and folder not in named:
                    remove(spark, f"{self.path}/{folder}")
            if top.isDirectory() and not any(f.startswith(f"{top.getPath().getName()}/") for f in named):
                remove(spark, f"{self.path}/{top.getPath().getName()}")


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path in its terms."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at

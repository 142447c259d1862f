"""Keyed tables on shared storage that can be changed without a rewrite: buckets, copy on write, one manifest.

A table's rows lie in buckets by a hash of their key. A change rewrites the buckets that hold changed rows under a new
version and then adds a manifest, a single small file that names the version of each bucket. Readers go by the newest
manifest, so they see a change as a whole or not at all; files of other buckets are never touched. Changes that are
numbered are made once: a batch at or below the manifest's last one is passed over, so a repeated write after a
failure gives the same table.

All reading and writing goes through Spark's own readers and writers.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hallkeeper.session import cut_lineage
from hallkeeper.tables import Tables

_MANIFEST = "bucket int, version int, rows bigint, batch bigint, schema string"
_HEADER = -1
"""The manifest's row that holds for the whole table."""

_BUCKET = "__bucket"

SLICES = 32
"""Parts that a bucket's rows are dealt to when they are written, so that the tasks don't depend on the few buckets."""


@dataclass(frozen=True)
class Manifest:
    """The version of each filled bucket, the table's schema and the last numbered batch."""

    version: int
    buckets: Mapping[int, int]
    schema: StructType
    batch: int


class BucketedTable:
    """A keyed table in a folder. The number of buckets is fixed when it is created."""

    def __init__(self, spark: SparkSession, folder: str, key: Sequence[str], buckets: int):
        self.spark, self.folder, self.key, self.n = spark, folder.rstrip("/"), list(key), buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in self.key]), F.lit(self.n)).cast("int")

    def manifest(self) -> Manifest:
        """The newest manifest; as many rows as there are buckets."""
        found = self.spark.read.schema(f"{_MANIFEST}, manifest int").parquet(f"{self.folder}/manifests")
        newest = found.agg(F.max("manifest")).scalar()
        rows = found.filter(F.col("manifest") == newest).collect()
        header = next(r for r in rows if r.bucket == _HEADER)
        versions = {r.bucket: r.version for r in rows if r.bucket != _HEADER}
        return Manifest(header.manifest, versions, StructType.fromJson(_json(header.schema)), header.batch)

    def _write(self, rows: DataFrame, version: int) -> dict[int, int]:
        """Write whole buckets under a version; gives the rows of each."""
        folder = f"{self.folder}/data/version={version}"
        placed = rows.withColumn(_BUCKET, self._bucket())
        part = F.pmod(F.hash(*[F.col(c) for c in self.key]), F.lit(SLICES))
        placed.repartition(F.col(_BUCKET), part).write.mode("overwrite").partitionBy(_BUCKET).parquet(folder)
        written = self.spark.read.schema(placed.schema).parquet(folder)
        return {r[_BUCKET]: r["count"] for r in written.groupBy(_BUCKET).count().collect()}

    def _commit(self, version: int, buckets: Mapping[int, int], schema: StructType, batch: int) -> None:
        rows = [(_HEADER, version, 0, batch, schema.json()), *[(b, v, 0, batch, None) for b, v in sorted(buckets.items())]]
        one = self.spark.createDataFrame(rows, _MANIFEST).coalesce(1)
        one.write.mode("overwrite").parquet(f"{self.folder}/manifests/manifest={version}")

    def create(self, rows: DataFrame) -> BucketedTable:
        """Write the first version; the folder should be new."""
        buckets = dict.fromkeys(self._write(rows, 0), 0)
        self._commit(0, buckets, rows.schema, -1)
        return self

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """The current rows, of the given buckets only if any are given."""
        now = self.manifest()
        return self._rows(now, now.buckets if buckets is None else buckets)

    def _rows(self, now: Manifest, buckets) -> DataFrame:
        wanted = [b for b in buckets if b in now.buckets]
        if not wanted:
            return self.spark.createDataFrame([], now.schema)
        paths = [f"{self.folder}/data/version={now.buckets[b]}/{_BUCKET}={b}" for b in wanted]
        return self.spark.read.schema(now.schema).parquet(*paths)

    def _buckets_of(self, *keys: DataFrame | None) -> list[int]:
        found: set[int] = set()
        for rows in keys:
            if rows is not None:
                found |= {r[0] for r in rows.select(self._bucket()).distinct().collect()}
        return sorted(found)

    def rows_of(self, keys: DataFrame) -> DataFrame:
        """The current rows with the given keys; only their buckets are read."""
        now = self.manifest()
        rows = self._rows(now, self._buckets_of(keys))
        return rows.join(keys.select(*self.key), self.key, "left_semi").select(*rows.columns)

    def merge(self, changed: DataFrame, deleted: DataFrame | None = None, batch: int | None = None) -> list[int]:
        """Replace or add ``changed`` rows and drop the keys of ``deleted``; gives the buckets written anew.

        Either has each key at most once. Rows equal to the stored ones change nothing. A batch number must grow from
        change to change; one that the table has seen changes nothing.
        """
        now = self.manifest()
        if batch is not None and now.batch >= batch:
            return []
        columns = now.schema.names
        new = changed.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in now.schema.fields])
        near = self._rows(now, self._buckets_of(new, deleted))
        before = near.select(*self.key, F.struct(*columns).alias("__old"))
        differs = ~F.coalesce(F.struct(*[F.col(c) for c in columns]).eqNullSafe(F.col("__old")), F.lit(False))
        real = cut_lineage(new.join(before, self.key, "left").filter(differs).select(*columns))
        gone = None
        if deleted is not None:
            gone = cut_lineage(near.join(deleted.select(*self.key), self.key, "left_semi").select(*self.key))
        buckets = self._buckets_of(real, gone)
        if not buckets:
            return []
        dropped = real.select(*self.key) if gone is None else real.select(*self.key).unionByName(gone)
        kept = self._rows(now, buckets).join(dropped, self.key, "left_anti").select(*columns)
        written = self._write(kept.unionByName(real), now.version + 1)
        versions = {b: v for b, v in now.buckets.items() if b not in buckets} | dict.fromkeys(written, now.version + 1)
        self._commit(now.version + 1, versions, now.schema, now.batch if batch is None else batch)
        return buckets


def _json(text: str):
    import json

    return json.loads(text)


class Store:
    """Bucketed tables under one folder."""

    def __init__(self, spark: SparkSession, folder: str, keys: Mapping[str, Sequence[str]], buckets: int = 16):
        self.spark, self.folder, self.keys, self.buckets = spark, folder.rstrip("/"), dict(keys), buckets

    def table(self, name: str) -> BucketedTable:
        return BucketedTable(self.spark, f"{self.folder}/{name}", self.keys[name], self.buckets)

    def create(self, t: Tables) -> Store:
        """Write the first version of every table of the store."""
        for name in self.keys:
            self.table(name).create(t[name])
        return self

    def tables(self) -> Tables:
        """The tables as they are now; each is read on first use."""
        return Tables({name: self.table(name).read for name in self.keys})

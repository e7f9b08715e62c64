"""An index whose changes are written: a base folder, folders of changes, and a manifest that says which of them count.

Upserts and deletes write only the rows they touch; the manifest of the next version then names the new folder. It is written
aside and renamed, so a version is there as a whole or not at all: a write that fails leaves the version before, with at
most a folder nobody names. Reading merges: of the changes to a key the last one counts, and a base row is replaced or hidden by
it. ``compact`` writes the merged rows as a new base once there are many changes. Versions are never overwritten, so a
reader that began on one can go on.

A null key is a key like any other. A base may hold several rows of one key (they are replaced or hidden together).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerloom.sources.index import upsert
from answerloom.sources.manifest import Versioned


class WrittenIndex(Versioned):
    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str) -> WrittenIndex:
        """A new index with ``rows``, or a new first state of an index that is there."""
        self = cls(rows.sparkSession, path)
        self._replace(rows, key)
        return self

    def _replace(self, rows: DataFrame, key: str) -> None:
        after = (self.versions() or [-1])[-1]
        manifest = {"key": key, "schema": rows.schema.json(), "base": self._write(rows), "changes": []}
        self._commit(manifest, after)

    def _change(self, kind: str, rows: DataFrame) -> None:
        version, manifest = self._latest()
        manifest["changes"].append({"kind": kind, "folder": self._write(rows)})
        self._commit(manifest, version)

    def upsert(self, new: DataFrame, order: str | None = None) -> None:
        """Rows of ``new`` replace those with the same key; of several with one key the one with the largest ``order`` counts.
        Columns the index does not have are left out, those missing are null."""
        _, manifest = self._latest()
        schema = T.StructType.fromJson(json.loads(manifest["schema"]))
        had = set(new.columns)
        extra = [F.col(order)] if order and order not in schema.names else []
        rows = new.select(
            *[(F.col(f.name) if f.name in had else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema], *extra
        )
        empty = self.spark.createDataFrame([], schema)
        self._change("upsert", upsert(empty, rows, manifest["key"], order))

    def delete(self, doomed: Column) -> None:
        """Hide the rows a filter selects; rows for which it is null stay."""
        _, manifest = self._latest()
        key = manifest["key"]
        current = self.read()
        gone = current.where(F.coalesce(doomed, F.lit(False))).select(key).distinct()
        self._change("delete", gone)

    def clear(self) -> None:
        """No rows, the same schema."""
        version, manifest = self._latest()
        empty = self.spark.createDataFrame([], T.StructType.fromJson(json.loads(manifest["schema"])))
        self._commit(manifest | {"base": self._write(empty), "changes": []}, version)

    def read(self, version: int | None = None) -> DataFrame:
        manifest = self.manifest(version)
        schema = T.StructType.fromJson(json.loads(manifest["schema"]))
        key = manifest["key"]
        base = self.spark.read.schema(schema).parquet(f"{self.path}/{manifest['base']}")
        if not manifest["changes"]:
            return base
        row = F.struct(*schema.names)
        only_key = T.StructType([schema[key]])
        changes = None
        for number, change in enumerate(manifest["changes"]):
            folder = f"{self.path}/{change['folder']}"
            if change["kind"] == "upsert":
                rows = self.spark.read.schema(schema).parquet(folder).select(F.col(key).alias("_key"), row.alias("_row"))
            else:
                rows = self.spark.read.schema(only_key).parquet(folder)
                rows = rows.select(F.col(key).alias("_key"), F.lit(None).cast(schema).alias("_row"))
            rows = rows.withColumn("_number", F.lit(number))
            changes = rows if changes is None else changes.unionByName(rows)
        last = changes.groupBy("_key").agg(F.max_by(F.struct("_row"), "_number").alias("_last"))
        kept = base.join(last.select("_key"), base[key].eqNullSafe(F.col("_key")), "left_anti")
        return kept.unionByName(last.where("_last._row is not null").select("_last._row.*"))

    def compact(self) -> None:
        """The merged rows as the new base."""
        version, manifest = self._latest()
        if manifest["changes"]:
            self._commit(manifest | {"base": self._write(self.read(version)), "changes": []}, version)

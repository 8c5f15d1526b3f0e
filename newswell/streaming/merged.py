"""A keyed table that small batches change: what a batch writes grows with the batch, not with the table.

Rows lie in hash buckets of their key. A batch reads the buckets that its keys fall into, merges, and
writes the rows that differ as a further layer of those buckets; a bucket with many layers is rewritten
alone. The log entry of a version lists the layers of each bucket, so readers see whole versions, and a batch that
runs again finds its version committed and does nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from newswell.sources.snapshots import CommitLog
from newswell.storage import exists, stored

#: Buckets of a table, and layers of a bucket after which it is rewritten.
BUCKETS, MOST_LAYERS = 64, 8


class MergedTable:
    """``keys`` choose a row's bucket and are not null; ``rows`` (the same, if not given) tell rows apart. All writers use the same number of buckets."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], buckets: int = BUCKETS, most_layers: int = MOST_LAYERS, rows: list[str] | None = None):
        self.spark, self.folder, self.keys, self.buckets, self.most_layers, self.ids = spark, folder, keys, buckets, most_layers, rows or keys
        self.touched: set[int] = set()  # since the table was opened
        self.log = CommitLog(spark, f"{folder}/_log")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _entry(self) -> dict:
        version = self.log.latest()
        return self.log.entry(version) if version else {"version": 0, "layers": {}, "schema": None, "batch": -1}

    def _rows(self, layers: dict[str, list[str]], schema: StructType) -> DataFrame:
        """The newest row of each key in some buckets, without those that are gone. A layer's folder begins with its number."""
        full = StructType.fromJson(json.loads(schema.json())).add("__gone", "boolean").add("__layer", "long")
        paths = [f"{self.folder}/{layer}/__bucket={b}" for b, own in layers.items() for layer in own]
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(full).parquet(*paths)
        newest = rows.groupBy(*self.ids).agg(F.max_by(F.struct(*(c for c in rows.columns)), "__layer").alias("__r")).select("__r.*")
        return newest.where("NOT __gone").select(*schema.names)

    def read(self) -> DataFrame:
        """All rows of the latest version."""
        entry = self._entry()
        if entry["schema"] is None:
            raise LookupError(f"{self.folder} has no version")
        return self._rows(entry["layers"], StructType.fromJson(json.loads(entry["schema"])))

    def apply(self, batch: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], number: int = -1, schema: StructType | None = None, also: set[int] | None = None) -> dict:
        """Put ``merge(present, batch)`` in place of the rows in the batch's buckets; gives what was read and written.

        ``present`` holds the rows of these buckets; what ``merge`` leaves out is gone. ``number`` is that of a stream's batch,
        and ``also`` names buckets that are merged although the batch has no row of theirs.
        """
        entry = self._entry()
        if number >= 0 and entry["batch"] >= number:
            return {"buckets": 0, "written": 0, "compacted": 0}
        batch = stored(batch.where(" AND ".join(f"`{k}` IS NOT NULL" for k in self.keys)), "batch")
        kind = StructType.fromJson(json.loads(entry["schema"])) if entry["schema"] else schema or batch.schema
        touched = sorted({r[0] for r in batch.select(self._bucket()).distinct().collect()} | (also or set()))  # at most the number of buckets
        self.touched.update(touched)
        layers = {k: list(v) for k, v in entry["layers"].items()}
        own = {str(b): layers.get(str(b), []) for b in touched}
        empty = not any(own.values())  # then all that is merged is new
        present = self._rows(own, kind) if empty else stored(self._rows(own, kind), "present")
        merged = merge(present, batch).select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in kind.fields))
        merged = merged if empty else stored(merged, "merged")
        same = F.xxhash64(F.to_json(F.struct(*kind.names), {"ignoreNullFields": "false"}))
        before = present.select(*self.ids, same.alias("__was"))
        changed = merged.withColumn("__now", same).join(before, self.ids, "left").where("__was IS NULL OR __was <> __now").drop("__was", "__now").withColumn("__gone", F.lit(False))
        gone = present.join(merged.select(*self.ids), self.ids, "left_anti").withColumn("__gone", F.lit(True))
        version = entry["version"] + 1
        layer = f"{version:012d}-{uuid.uuid4().hex}"
        full = [b for b, x in own.items() if len(x) + 1 > self.most_layers]
        rows = (merged.withColumn("__gone", F.lit(False)) if empty else changed.unionByName(gone)).withColumn("__bucket", self._bucket())
        if full:  # buckets with too many layers get all their rows, as their only layer
            inside = F.col("__bucket").isin([int(b) for b in full])
            rows = rows.where(~inside).unionByName(merged.withColumn("__gone", F.lit(False)).withColumn("__bucket", self._bucket()).where(inside))
        rows = rows.withColumn("__layer", F.lit(version).cast("bigint"))
        rows.write.partitionBy("__bucket").parquet(f"{self.folder}/{layer}")
        written = self.spark.read.schema(StructType.fromJson(json.loads(rows.schema.json()))).parquet(f"{self.folder}/{layer}")
        wrote = {str(r[0]): r[1] for r in written.groupBy("__bucket").agg(F.count("*")).collect()}
        for b in wrote:
            layers[b] = [layer] if b in full else [*layers.get(b, []), layer]
        for b in full:
            if b not in wrote:
                layers.pop(b, None)
        self.log.commit(version, {"version": version, "layers": layers, "schema": kind.json(), "batch": max(number, entry["batch"])})
        return {"buckets": len(touched), "written": sum(wrote.values()), "compacted": len(full)}

    def run(self, stream: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], schema: StructType | None = None) -> DataFrame:
        """Apply a stream's batches, all that has landed; gives the table. Batches already committed are left out after a restart."""
        base = self.log.latest() and self._entry()["batch"] + 1 if not exists(self.spark, f"{self.folder}/_checkpoint") else 0
        stream.writeStream.foreachBatch(lambda batch, number: self.apply(batch, merge, base + number, schema) and None).option("checkpointLocation", f"{self.folder}/_checkpoint").trigger(availableNow=True).start().awaitTermination()
        return self.read()

"""Sharding by jump consistent hash, in DataFrame functions only.

A key's shard depends on the key and the shard count alone (Lamping and Veach,
2014): there is no ring or table to keep, and going from n to n + 1 shards moves
about one key in n + 1, all of them into the new shard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newswell.llm.shared import clean_names

SHARDS = 24
#: Rows that are numbered together in one window group; a shard has as many groups as it needs.
SLOT_ROWS = 50_000

#: Fixed values of the published algorithm: the generator's multiplier and the modulus of its state.
_MULTIPLIER = 2862933555777941757
_MODULUS = 1 << 64


def jump_hash(key: Column, shards: int) -> Column:
    """Shard 0 to ``shards - 1`` of a bigint key, taken as an unsigned number. A null key counts as 0.

    The state is a decimal because a bigint product would overflow. At most
    ``shards`` steps are needed; once the jump leaves the range, the rest do nothing.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    start = F.coalesce(key.cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    start = F.when(start < 0, start + F.lit(str(_MODULUS)).cast("decimal(38,0)")).otherwise(start).cast("decimal(38,0)")
    state = F.struct(F.lit(-1).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("j"), start.alias("k"))

    def step(s: Column, _: Column) -> Column:
        following = ((s["k"].cast("decimal(20,0)") * F.lit(_MULTIPLIER).cast("decimal(19,0)") + 1) % F.lit(str(_MODULUS)).cast("decimal(20,0)")).cast("decimal(38,0)")
        jumped = F.transform(
            F.array(following),
            lambda k: F.struct(s["j"].alias("b"), F.floor((s["j"] + 1) * (F.lit(float(1 << 31)) / (F.floor(k / F.lit(1 << 33).cast("decimal(20,0)")).cast("double") + 1))).cast("bigint").alias("j"), k.alias("k")),
        )
        return F.when(s["j"] < shards, jumped[0]).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), state, step, lambda s: s["b"].cast("int"))


def stable_key(df: DataFrame, key: str) -> Column:
    """A key as the number that is hashed: a whole number is itself, another value its 64-bit hash, null stays null."""
    column = F.col(f"`{key}`")
    return column if df.schema[key].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else F.when(column.isNotNull(), F.xxhash64(column))


def shard_rows(df: DataFrame, shards: int = SHARDS, key: str = "doc_id") -> DataFrame:
    """Adds ``shard`` (int). Keys may be of any type that Spark hashes; rows with equal keys, repeated rows included, share a shard. An empty table stays empty."""
    return df.withColumn("shard", jump_hash(stable_key(df, key), shards))


def number_slots(df: DataFrame, key: str = "doc_id", rows: int | None = None) -> DataFrame:
    """Adds ``slot`` (long), numbering the rows of each ``shard`` from 0 without gaps.

    A shard's rows are dealt into groups by a hash of key and row content; groups are
    numbered one after the other from their counts, so no shard is sorted as a whole
    and many rows of one key or of one text don't meet; only rows equal in every column do.
    Repeated rows get slots of their own.
    """
    total = df.count() if rows is None else rows
    parts = max(1, math.ceil(total / SLOT_ROWS))
    dealt = df.withColumn("__part", F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns if dict(df.dtypes)[c].split("<")[0] not in ("map", "variant"))), F.lit(parts)).cast("int"))
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "__part").agg(F.count("*").alias("__n")).select("shard", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = Window.partitionBy("shard", "__part").orderBy(F.col(f"`{key}`").asc_nulls_last())
    numbered = dealt.withColumn("__own", F.row_number().over(own))
    return numbered.join(offsets, ["shard", "__part"]).withColumn("slot", (F.col("__before") + F.col("__own") - 1).cast("bigint")).select(*df.columns, "slot")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The rows of ``docs`` with ``shard`` and ``slot``; columns of these names are replaced. Null ids hash as 0."""
    base = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot")))
    return number_slots(shard_rows(base, shards))


def op7_jump_sharding(spark, sf_dir: str) -> DataFrame:
    docs = clean_names(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text).cast("bigint").alias("text_crc32"), F.lit("key").alias("law"))
    sharded = shard_rows(sized).withColumn("grown_shard", jump_hash(F.col("doc_id"), SHARDS + 1))
    return number_slots(sharded, rows=docs.count()).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")

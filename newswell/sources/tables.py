"""Stored tables: snapshots, digests, run records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newswell.functions.dates import backfill_offset
from newswell.sources.snapshots import SnapshotTable
from newswell.storage import exists, new_folder


def write_snapshot(df: DataFrame, name: str, folder: str | None = None, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Commit ``df`` as a new version of a table (see :class:`SnapshotTable`) and read that version back; earlier ones stay as they are."""
    table = SnapshotTable(df.sparkSession, name, folder)
    return table.read(table.write(df, partition_by=partition_by))


def snapshot_counters(df: DataFrame, run_ts: Column) -> DataFrame:
    """The envelope of a snapshot, one row: when it was built, its articles, sources, annotated ones and those with relatives."""
    return df.agg(run_ts.alias("built_at"), F.count("*").alias("n_items"), F.count_distinct("source").alias("n_sources"), F.count_if("llm_enriched").alias("n_enriched"), F.count_if(F.col("related_count") > 0).alias("n_related"))


def rewrite_snapshot(table: SnapshotTable) -> int:
    """Commit the latest version with dates of Korean articles in the offset of Seoul. The version it replaces is its backup, which ``restore`` brings back."""
    before = table.latest()
    old = table.read(before)
    return table.write(old.withColumn("date_raw", backfill_offset(F.col("date_raw"), F.col("lang"), F.col("date_unknown"))), expect=before)


def run_record(df: DataFrame, name: str, run_ts: Column, n_in: int | None = None) -> DataFrame:
    """Counters of a table, a row of the run log. The stamp is that of the run, so that a rerun gives the same row."""
    return df.agg(F.lit(name).alias("name"), run_ts.alias("built_at"), F.lit(n_in).cast("bigint").alias("n_in"), F.count("*").alias("n_out"))


def append_run(record: DataFrame, log: str) -> DataFrame:
    """Append to the run log and read all of it; a run that is recorded already is not appended again."""
    spark = record.sparkSession
    if exists(spark, log):
        record = record.join(spark.read.parquet(log).select("name", "built_at"), ["name", "built_at"], "left_anti")
    record.write.mode("append").parquet(log)
    return spark.read.parquet(log)


def write_digests(cards: DataFrame, key: str = "day", what: str = "digests") -> DataFrame:
    """Cards with ``kind`` and a day, stored by kind, year and month, and read back."""
    day = F.to_date(F.col(key))
    dated = cards.withColumns({"yyyy": F.date_format(day, "yyyy"), "mm": F.date_format(day, "MM")})
    path = new_folder(cards.sparkSession, what)
    dated.write.partitionBy("kind", "yyyy", "mm").parquet(path)
    return cards.sparkSession.read.schema(dated.schema).parquet(path)

"""Streaming forms: deduplication, daily counters, trends, merges and quotas over landed files."""

from __future__ import annotations

import datetime as dt
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from newswell.operators.history import first_per_key, merge_articles, upsert_history
from newswell.session import ship
from newswell.storage import new_folder
from newswell.streaming.merged import MergedTable


def _folder(spark: SparkSession) -> str:
    return new_folder(spark, "stream")


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of Parquet files; a single file is a stream of one."""
    schema = spark.read.parquet(path).schema
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    single = at.getFileSystem(hadoop).getFileStatus(at).isFile()
    folder, name = path.rsplit("/", 1)
    reader = spark.readStream.schema(schema)
    df = reader.option("pathGlobFilter", name).parquet(folder) if single else reader.parquet(path)
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


@contextmanager
def state_store(spark: SparkSession, provider: str | None):
    """Queries started within it use this state store; the session's own setting comes back after."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    if provider:
        spark.conf.set(key, provider)
    try:
        yield
    finally:
        if provider and before is None:
            spark.conf.unset(key)
        elif provider:
            spark.conf.set(key, before)


def run_to_table(df: DataFrame, mode: str, keys: list[str] | None = None, store: str | None = None) -> DataFrame:
    """Run a stream over all that has landed and give what it wrote.

    ``append`` writes files exactly once. ``update`` gives groups that changed, which replace those of the same ``keys`` in
    a :class:`MergedTable`; the watermark frees the state of groups that can't change any more.
    """
    spark, folder = df.sparkSession, _folder(df.sparkSession)
    out = f"{folder}/out"
    writer = df.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        with state_store(spark, store):
            writer.format("parquet").option("path", out).outputMode("append").start().awaitTermination()
        return spark.read.schema(df.schema).parquet(out)

    table = MergedTable(spark, out, keys)
    writer.outputMode("update").foreachBatch(lambda batch, number: table.apply(batch, lambda present, new: upsert_history(present, new, keys), number, df.schema) and None).start().awaitTermination()
    return table.read()


def stream_dedup(df: DataFrame, ts: str, keys: list[str], memory: str = "30 days") -> DataFrame:
    """The first arrival of each key within the memory."""
    return df.withWatermark(ts, memory).dropDuplicatesWithinWatermark(keys)


def stream_source_daily(df: DataFrame, ts: str, by: str, late: str = "2 days") -> DataFrame:
    """Arrivals of each source and day of Seoul."""
    local = df.withColumn("__local", F.from_utc_timestamp(ts, "Asia/Seoul")).withWatermark("__local", late)
    return local.groupBy(F.window("__local", "1 day").alias("w"), by).agg(F.count("*").alias("fetched")).select(by, F.date_format("w.start", "yyyy-MM-dd").alias("day"), "fetched")


def stream_trend(df: DataFrame, ts: str, by: str, late: str = "2 days") -> DataFrame:
    """Arrivals of each source in sliding windows of seven days."""
    return df.withWatermark(ts, late).groupBy(F.window(ts, "7 days", "1 day").alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), "n")


#: The first day of Unix time.
EPOCH = dt.date(1970, 1, 1).toordinal()


class Quota(StatefulProcessor):
    """Requests that each sender has been granted, a number a day, until two days after the day began.

    All days of a sender are one value and have one timer, that of the first, so a batch asks the state a few times a sender.
    """

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getValueState("used", "days array<string>, used array<long>")

    def _end(self, day: str) -> int:
        return (dt.date.fromisoformat(day).toordinal() - EPOCH + 2) * 86_400_000

    def _keep(self, used: dict[str, int], now: int, before: str | None) -> None:
        """Store a sender's days at once, and a timer for the first of them if it is not that of ``before``, which has one."""
        self.used.update((list(used), list(used.values())))
        if min(used) != before:
            self.handle.registerTimer(max(self._end(min(used)), now + 1))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived: Counter[str] = Counter()
        for pdf in rows:
            arrived.update(pdf["day"].tolist())
        used = self._used()
        first, out = min(used, default=None), []
        for day, n in sorted(arrived.items()):
            admitted = min(n, max(0, self.limit - used.get(day, 0)))
            used[day] = used.get(day, 0) + admitted
            out.append((key[0], day, admitted))
        self._keep(used, timerValues.getCurrentWatermarkInMs(), first)
        yield pd.DataFrame(out, columns=["ip", "day", "admitted"])

    def _used(self) -> dict[str, int]:
        stored = self.used.get()
        return dict(zip(*stored)) if stored else {}

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        now = max(now, timerValues.getCurrentWatermarkInMs())
        left = {day: n for day, n in self._used().items() if self._end(day) > now}
        if left:
            self._keep(left, now, None)
        else:
            self.used.clear()
        return iter(())

    def close(self) -> None:
        pass


#: Fixed value: the state store that map state and timers need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_quota(df: DataFrame, limit: int = 5) -> DataFrame:
    """``ip, day, admitted``: how many requests of each sender and UTC day each batch admits.

    The state is a number for each day of a sender, all in one value; a timer frees a day two days after it began. The query needs
    ``STATE_STORE`` as its state store (see :func:`run_to_table`). Requests without a sender or time are left out.
    """
    ship(df.sparkSession)
    keyed = df.where("ip IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", "1 day").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return keyed.groupBy("ip").transformWithStateInPandas(Quota(limit), "ip string, day string, admitted long", "append", "EventTime")


def stream_merge(stream: DataFrame, table: str, keys: list[str], *order: Column) -> DataFrame:
    """Upsert every batch into a :class:`MergedTable` at ``table``: the first row of each key in ``order`` stays. Gives the table."""
    return MergedTable(stream.sparkSession, table, keys).run(stream, lambda present, batch: first_per_key(batch.unionByName(present), keys, *order))


def stream_merge_last(spark: SparkSession, path: str, shape: Callable[[DataFrame], DataFrame], keys: list[str], *order: Column) -> DataFrame:
    """Run :func:`stream_merge` over landed files and read the table."""
    return stream_merge(shape(read_stream(spark, path)), _folder(spark), keys, *order)


def stream_merge_articles(stream: DataFrame, prev: DataFrame, run_ts: Column, keep_days: int = 30) -> DataFrame:
    """Merge every batch of articles into a :class:`MergedTable` as :func:`merge_articles` does, annotations kept; gives the table.

    Stored articles that do not arrive are looked at when a batch touches their bucket, and those of all other buckets once, at the end.
    """
    table = MergedTable(prev.sparkSession, _folder(prev.sparkSession), ["url"])
    table.apply(prev.withColumn("is_new", F.lit(False)), lambda _, rows: rows)

    def merge(present: DataFrame, batch: DataFrame) -> DataFrame:
        new = first_per_key(batch, ["url"], F.col("ord"))
        return merge_articles(present.select(*new.columns), new, run_ts, keep_days)

    table.touched.clear()
    table.run(stream, merge)
    left = set(range(table.buckets)) - table.touched
    if left:
        table.apply(prev.select(*stream.columns).limit(0), merge, also=left)
    return table.read()


def late_corrections(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """The stored articles with dates corrected by a batch.

    A known date of the batch takes the place of a stored one that is unknown or looks like the time of collection.
    """
    from newswell.operators.classify import suspicious_date

    known = first_per_key(batch.where("NOT date_unknown AND published_at IS NOT NULL"), ["url"], F.col("ord")).select("url", F.col("published_at").alias("__at"))
    wrong = suspicious_date(F.col("date_unknown"), F.col("published_at"), F.col("first_seen")) & F.col("__at").isNotNull()
    wrong = F.coalesce(wrong, F.col("__at").isNotNull() & F.col("published_at").isNull())
    out = stored.join(known, "url", "left").withColumn("corrected", wrong)
    return out.withColumns({"published_at": F.when(F.col("corrected"), F.col("__at")).otherwise(F.col("published_at")), "date_unknown": F.col("date_unknown") & ~F.col("corrected")}).drop("__at")


def stream_late_corrections(stream: DataFrame, stored_: DataFrame, ts: str = "published_at", horizon: str = "2 days") -> DataFrame:
    """:func:`late_corrections` by every batch, rows later than the horizon left out; gives all articles. They are told apart by ``url`` and ``ord``.

    The table that batches change holds what a correction reads and changes, and not the articles' texts; these join at the end.
    """
    ids, dated = ["url", "ord"], ["published_at", "date_unknown", "first_seen"]
    table = MergedTable(stored_.sparkSession, _folder(stored_.sparkSession), ["url"], rows=ids)
    table.apply(stored_.select(*ids, *dated).withColumn("corrected", F.lit(False)), lambda _, rows: rows)

    def correct(present: DataFrame, batch: DataFrame) -> DataFrame:
        after = late_corrections(present.withColumnRenamed("corrected", "__before"), batch)
        return after.withColumn("corrected", F.col("corrected") | F.col("__before")).drop("__before")

    narrow = stream.select(*dict.fromkeys((*ids, "published_at", "date_unknown", ts)))
    now = table.run(narrow.withWatermark(ts, horizon), correct).select(*ids, *(F.col(c).alias(f"__{c}") for c in (*dated, "corrected")))
    hit = F.col("__corrected").isNotNull()  # articles without an address are in no table
    one = lambda c: F.when(hit, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in dated else F.col(c)
    return stored_.join(now, ids, "left").select(*(one(c) for c in stored_.columns), F.coalesce("__corrected", F.lit(False)).alias("corrected"))

"""Stored tables with numbered versions: a commit log says which version is the latest, which came before, and when each was built."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newswell.storage import shared_folder


class SnapshotConflict(RuntimeError):
    """Another writer committed the version first."""


class CommitLog:
    """Numbered JSON entries in a folder. An entry is written aside and renamed into place, which fails if its number is taken.

    One of two writers of a number wins on file systems whose rename is atomic, such as HDFS and local ones.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(folder).toUri(), spark.sparkContext._jsc.hadoopConfiguration())

    def _name(self, version: int) -> str:
        return f"{self.folder}/{version:012d}.json"

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder)))
        return sorted(int(n[:12]) for n in names if len(n) == 17 and n.endswith(".json"))

    def latest(self) -> int:
        """The number of the last version, 0 where there is none."""
        return max(self.versions(), default=0)

    def entry(self, version: int) -> dict:
        stream = self._fs.open(self._path(self._name(version)))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def commit(self, version: int, entry: dict) -> None:
        aside = f"{self.folder}/.{uuid.uuid4().hex}"
        self._fs.mkdirs(self._path(self.folder))
        stream = self._fs.create(self._path(aside), False)
        stream.write(bytearray(json.dumps(entry, sort_keys=True).encode()))
        stream.close()
        try:
            none = self.spark.sparkContext._gateway.new_array(getattr(self.spark.sparkContext._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
            self._files.rename(self._path(aside), self._path(self._name(version)), none)
        except Exception as e:
            self._fs.delete(self._path(aside), False)
            if self._fs.exists(self._path(self._name(version))):
                raise SnapshotConflict(f"version {version} of {self.folder} is there already") from e
            raise


class SnapshotTable:
    """Versions of one table. Data are written first, to a folder of their own, and a version is there once its log entry is."""

    def __init__(self, spark: SparkSession, name: str, folder: str | None = None):
        self.spark, self.name = spark, name
        self.folder = f"{folder or shared_folder(spark)}/{name}"
        self.log = CommitLog(spark, f"{self.folder}/_log")

    def latest(self) -> int:
        return self.log.latest()

    def write(self, df: DataFrame, expect: int | None = None, built_at: str | None = None, partition_by: tuple[str, ...] = ()) -> int:
        """Commit ``df`` as the version after ``expect`` (the latest, if not given); raises :class:`SnapshotConflict` if that is there already."""
        before = self.latest() if expect is None else expect
        path = f"{self.folder}/data-{uuid.uuid4().hex}"
        df.write.partitionBy(*partition_by).parquet(path)
        return self._commit(before, {"path": path, "schema": df.schema.json(), "built_at": built_at})

    def _commit(self, before: int, entry: dict) -> int:
        built = entry.get("built_at") or self.spark.sql("SELECT date_format(current_timestamp(), \"yyyy-MM-dd'T'HH:mm:ss\")").first()[0]
        self.log.commit(before + 1, {**entry, "built_at": built, "version": before + 1, "before": before})
        return before + 1

    def entry(self, version: int | None = None, as_of: str | None = None) -> dict:
        """The log entry of a version, of the last one built at ``as_of`` (ISO time) or before, or of the latest."""
        found = [v for v in self.log.versions() if version is None or v == version]
        for v in reversed(found):
            entry = self.log.entry(v)
            if as_of is None or entry["built_at"] <= as_of:
                return entry
        raise LookupError(f"{self.name} has no such version")

    def read(self, version: int | None = None, as_of: str | None = None) -> DataFrame:
        from pyspark.sql.types import StructType

        entry = self.entry(version, as_of)
        return self.spark.read.schema(StructType.fromJson(json.loads(entry["schema"]))).parquet(entry["path"])

    def backup_of(self, version: int | None = None) -> int:
        """The version that a version replaced; 0 for the first."""
        return self.entry(version)["before"]

    def restore(self, version: int, expect: int | None = None) -> int:
        """A new version with the data of an old one; nothing is copied."""
        old = self.entry(version)
        return self._commit(self.latest() if expect is None else expect, {"path": old["path"], "schema": old["schema"], "restores": version})

    def history(self) -> DataFrame:
        rows = [(e["version"], e["before"], e["built_at"], e.get("restores")) for e in map(self.log.entry, self.log.versions())]
        return self.spark.createDataFrame(rows, "version long, before long, built_at string, restores long")


def daily_digest(cards: DataFrame, articles: DataFrame, top: int = 10) -> DataFrame:
    """``day, n_cards, cards, top, kinds``: of each day its cards in order, its best articles by score, and how many articles of each kind it has.

    ``cards`` has ``day, ord, title``, ``articles`` has ``day, ord, title, url, score, kind``. The first ``CARDS`` cards are listed; kinds are few.
    """
    from pyspark.sql import Window

    shown = cards.withColumn("__r", F.row_number().over(Window.partitionBy("day").orderBy("ord"))).where(F.col("__r") <= CARDS)
    listed = shown.groupBy("day").agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", "title"))), lambda x: x["title"]).alias("cards"))
    counted = cards.groupBy("day").agg(F.count("*").alias("n_cards"))
    best = articles.withColumn("rank", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("score"), "ord"))).where(F.col("rank") <= top)
    best = best.groupBy("day").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "ord", "title", "url", "score"))), lambda x: F.struct(x["ord"].alias("ord"), x["title"].alias("title"), x["url"].alias("url"), x["score"].alias("score"))).alias("top"))
    kinds = articles.groupBy("day", "kind").agg(F.count("*").alias("n")).groupBy("day").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("kind", F.lit("")).alias("kind"), "n")))).alias("kinds"))
    out = counted.join(listed, "day", "full").join(best, "day", "full").join(kinds, "day", "full")
    return out.withColumn("n_cards", F.coalesce("n_cards", F.lit(0)))


#: Cards of a day that its digest lists, at most.
CARDS = 100

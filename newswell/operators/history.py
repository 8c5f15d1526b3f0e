"""Merging, ranking, retention and set operations over article tables. Ties are broken by input order, ``ord``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Annotations that a stored article keeps when it arrives again.
KEPT_FIELDS = ("summary_ko", "insight_ko", "entities", "relations", "persona_score", "persona_reason", "primary_category", "llm_enriched", "ner_only")


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key. One aggregation, combined before the shuffle, instead of a sort of every group."""
    rest = F.struct(*(F.col(c) for c in df.columns))
    place = F.struct(*(o.alias(f"o{k}") for k, o in enumerate(order)))
    return df.groupBy(*keys).agg(F.min_by(rest, place).alias("__row")).select("__row.*")


def top_n_per(df: DataFrame, keys: list[str], n: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group with their rank; Spark keeps ``n`` a group before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n).withColumn(rank, F.col(rank).cast("bigint"))


def merge_articles(prev: DataFrame, new: DataFrame, run_ts: Column, keep_days: int = 30) -> DataFrame:
    """New arrivals joined with the stored table on ``url``.

    A known article takes the new row but keeps its annotations, its first sighting, and its
    date if the new one is unknown. A stored article that does not arrive stays while its date
    is readable and recent; dates that look like collection times are flagged.
    """
    fields = [c for c in KEPT_FIELDS if c in prev.columns and c in new.columns]
    rest = [c for c in new.columns if c not in (*fields, "url", "first_seen", "date_unknown", "published_at")]
    j = new.alias("n").join(prev.alias("p"), F.col("n.url") == F.col("p.url"), "full_outer")
    arrived, stored = F.col("n.url").isNotNull(), F.col("p.url").isNotNull()
    pick = lambda c: F.when(arrived, F.col(f"n.{c}")).otherwise(F.col(f"p.{c}"))
    old_date = arrived & stored & F.col("n.date_unknown") & ~F.col("p.date_unknown")
    suspicious = F.col("p.date_unknown") | (F.abs(F.unix_timestamp("p.published_at") - F.unix_timestamp("p.first_seen")) < 120)
    out = j.select(
        F.coalesce("n.url", "p.url").alias("url"),
        F.when(old_date, F.col("p.published_at")).otherwise(pick("published_at")).alias("published_at"),
        F.when(old_date, F.lit(False)).when(arrived, F.col("n.date_unknown")).otherwise(F.coalesce(suspicious, F.lit(False))).alias("date_unknown"),
        F.coalesce("p.first_seen", "n.first_seen").alias("first_seen"),
        *(F.coalesce(f"p.{c}", f"n.{c}").alias(c) for c in fields),
        *(pick(c).alias(c) for c in rest),
        (arrived & ~stored).alias("is_new"),
        arrived.alias("__arrived"),
    )
    recent = F.col("published_at") >= run_ts - F.expr(f"interval {keep_days} days")
    return out.where(F.when(F.col("__arrived"), F.coalesce(recent, F.lit(True))).otherwise(F.coalesce(recent, F.lit(False)))).drop("__arrived")


def restore_annotations(df: DataFrame, cache: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Annotations of an earlier run, for rows that have none, from annotated rows of the cache."""
    kept = cache.where(F.coalesce("llm_enriched", F.lit(False)) | F.coalesce("ner_only", F.lit(False))).select("url", *(F.col(c).alias(f"__{c}") for c in fields))
    return df.join(kept, "url", "left").select(*(F.coalesce(c, f"__{c}").alias(c) if c in fields else F.col(c) for c in df.columns))


def new_url_counts(new: DataFrame, prev: DataFrame, by: str = "source") -> DataFrame:
    return new.join(prev.select("url"), "url", "left_anti").groupBy(by).agg(F.count("*").alias("n_new"))


def force_include(items: DataFrame, top: DataFrame, wanted: Column, n: int, *order: Column) -> DataFrame:
    """``top`` with up to ``n`` more items that ``wanted`` marks and that are not in it."""
    more = items.where(wanted).join(top.select("url"), "url", "left_anti").orderBy(*order).limit(n)
    return top.unionByName(more, allowMissingColumns=True)


def prune_history(df: DataFrame, run_date: Column, period: str = "period", key: str = "key") -> DataFrame:
    """Daily keys of 60 days, weekly of 26 weeks, monthly of 12 months; keys are compared as strings."""
    day = F.date_format(F.date_sub(run_date, 60), "yyyy-MM-dd")
    week_start = F.date_sub(run_date, 26 * 7)
    week = F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), week_start), F.weekofyear(week_start))
    month = F.date_format(F.add_months(run_date, -12), "yyyy-MM")
    return df.where(F.when(F.col(period) == "daily", F.col(key) >= day).when(F.col(period) == "weekly", F.col(key) >= week).otherwise(F.col(key) >= month))


def upsert_history(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` replaces the rows of ``old`` with the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def merge_bookmarks(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union by ``key``; of both the later ``saved_at`` wins, ``a`` in a tie."""
    both = a.withColumn("__side", F.lit(1)).unionByName(b.withColumn("__side", F.lit(0)))
    return both.groupBy("key").agg(F.max_by("saved_at", F.struct("saved_at", "__side")).alias("saved_at"), F.max_by(F.when(F.col("__side") == 1, "a").otherwise("b"), F.struct("saved_at", "__side")).alias("side"))


def apply_toggles(events: DataFrame) -> DataFrame:
    """Keys that are set after all toggles: an odd number of them. Saved at the last."""
    return events.groupBy("key").agg(F.count("*").alias("n"), F.max("ts").alias("saved_at")).where("n % 2 = 1").drop("n")


def union_sources(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def rank_cards(cards: DataFrame, high, medium, most: int | None = None) -> DataFrame:
    """Cards by importance within ``period, key``, with the number in their tag rewritten.

    Two or more high terms come first, then one, then a medium one; more hits before fewer; then the old order.
    """
    from newswell.functions.terms import term_hits

    found = term_hits(F.lower(F.concat_ws(" ", "tag", "title", "body")), {"high": high, "medium": medium})
    work = cards.withColumn("__found", found).withColumns({"__high": F.col("__found.high.hits"), "__medium": F.col("__found.medium.hits")}).drop("__found")
    tier = F.when(F.col("__high") >= 2, 0).when(F.col("__high") == 1, 1).when(F.col("__medium") >= 1, 2).otherwise(3)
    hits = F.when(F.col("__high") >= 1, F.col("__high")).otherwise(F.col("__medium"))
    work = work.withColumn("tier", tier).withColumn("rank", F.row_number().over(Window.partitionBy("period", "key").orderBy("tier", F.desc(hits), "ord")).cast("bigint"))
    own = F.regexp_extract("tag", r"(?i)^\s*TREND\s+\d+\s*[·•]\s*(.+)$", 1)
    out = work.withColumn("tag", F.when(own != "", F.format_string("TREND %02d · %s", "rank", own)).otherwise(F.col("tag"))).drop("__high", "__medium")
    return out.where(F.col("rank") <= most) if most else out


def recent_keys(df: DataFrame, n: int, key: str = "key") -> DataFrame:
    """The latest ``n`` keys of each period."""
    return df.select("period", key).distinct().withColumn("rank", F.row_number().over(Window.partitionBy("period").orderBy(F.desc(key)))).where(F.col("rank") <= n).withColumn("rank", F.col("rank").cast("bigint"))


def admit(requests: DataFrame, limit: int = 5, who: str = "ip", ts: str = "ts", day: Column | None = None) -> DataFrame:
    """The first ``limit`` requests of each sender and UTC day. A group is one sender's day."""
    return top_n_per(requests.withColumn("__day", F.to_date(ts) if day is None else day), [who, "__day"], limit, F.col(ts)).drop("__day")


# ------------------------------------------------------------ windows of time and periods


def within_days(df: DataFrame, run_ts: Column, days: int, column: str = "published_at") -> DataFrame:
    """Rows of the last ``days`` days."""
    return df.where(F.col(column) >= run_ts - F.expr(f"interval {days} days"))


def fetched_days(df: DataFrame, run_ts: Column, days: int = 1) -> DataFrame:
    """Articles dated, in Seoul, not more than ``days`` days before the run; those without a date pass."""
    from newswell.functions.dates import seoul_date

    return df.where(F.col("date_unknown") | (seoul_date(F.col("published_at")) >= F.date_sub(F.to_date(run_ts), days)))


def in_period(df: DataFrame, first: str, last: str) -> DataFrame:
    """Articles with a known date from ``first`` to ``last``, days as strings, both included."""
    return df.where(~F.col("date_unknown") & F.substring("date_raw", 1, 10).between(first, last))


def recent_papers(df: DataFrame, since: str) -> DataFrame:
    """Papers with a known date from ``since`` on."""
    return df.where(F.col("source_type").isin("arxiv", "openalex") & ~F.col("date_unknown") & (F.substring("date_raw", 1, 10) >= since))


def added_since(df: DataFrame, since: Column) -> DataFrame:
    """Articles first seen, or else published, since an instant."""
    return df.where(F.coalesce("first_seen", "published_at") >= since)


def retain_by_source(df: DataFrame, run_sources: DataFrame, since: Column) -> DataFrame:
    """Old articles go, but for those of sources that did not take part in the run."""
    present = run_sources.select("source").distinct().withColumn("__in_run", F.lit(True))
    return df.join(present, "source", "left").where((F.to_date("published_at") >= since) | F.col("__in_run").isNull()).drop("__in_run")


def keep_unless_recent(df: DataFrame, columns: tuple[str, ...], run_ts: Column, days: int = 3) -> DataFrame:
    """Annotations of articles of the last ``days`` days are taken off, so that they are made anew."""
    recent = F.coalesce(F.col("published_at") >= run_ts - F.expr(f"interval {days} days"), F.lit(False))
    return df.withColumns({c: F.when(~recent, F.col(c)) for c in columns})


def best_of_enough(df: DataFrame, keys: list[str], n: int, least: int, *order: Column) -> DataFrame:
    """The first ``n`` of each group that has ``least`` rows or more."""
    enough = df.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select(*keys)
    return top_n_per(df.join(enough, keys, "left_semi"), keys, n, *order)


def annotation_budget(df: DataFrame, n: int = 300) -> DataFrame:
    """The ``n`` most important articles without annotations."""
    return df.where(~F.coalesce(F.col("llm_enriched"), F.lit(False))).orderBy(F.desc("score"), F.desc("date_raw"), "ord").limit(n)


def expand_selection(picked: DataFrame, cited: DataFrame) -> DataFrame:
    """``url, ord``: picked articles and those that picked cards cite, each address once."""
    return picked.select("url", "ord").unionByName(cited.select("url", "ord")).where("url <> ''").groupBy("url").agg(F.min("ord").alias("ord"))


def match_bookmarks(marks: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """How many bookmarks have an article, and how many have none."""
    found = items.select(key).distinct().withColumn("matched", F.lit(True))
    return marks.join(found, key, "left").groupBy(F.coalesce("matched", F.lit(False)).alias("matched")).agg(F.count("*").alias("n"))

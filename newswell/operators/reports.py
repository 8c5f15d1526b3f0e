"""Counts, facets, trends, bookmarks, papers and feed queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newswell.functions.dates import seoul_date


def facet_counts(pool: DataFrame, dim: str = "categories") -> DataFrame:
    """Articles of each value of a multi-valued column."""
    return pool.select(F.explode(F.array_distinct(dim)).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def period_stats(items: DataFrame, history: DataFrame, run_ts: Column, periods=(1, 7, 30, 60)) -> DataFrame:
    """Articles, new, annotated and related ones, and active sources of each period of ``days`` days of Seoul, today's included.

    ``new`` leaves out dates after today. A source is active if ``history`` (``source, day, fetched``) has something fetched.
    Rows meet a dimension of a few periods, so one pass of each table serves all.
    """
    today = seoul_date(run_ts)
    fanned = lambda day: F.explode(F.filter(F.array(*map(F.lit, periods)), lambda d: F.datediff(today, day) < d)).alias("days")
    own = items.withColumn("__day", seoul_date(F.col("published_at"))).select("*", fanned(F.col("__day"))).groupBy("days").agg(F.count("*").alias("n_items"), F.count_if(F.col("__day") <= today).alias("n_new"), F.count_if("llm_enriched").alias("n_enriched"), F.count_if(F.col("related_count") > 0).alias("n_related"))
    active = history.where((F.col("fetched") > 0) & (F.col("day") <= today)).select("source", fanned(F.col("day"))).groupBy("days").agg(F.count_distinct("source").alias("n_sources"))
    return own.join(active, "days", "full").fillna(0)


def trend_matrix(df: DataFrame, dim: str, run_date: Column, days: int = 7, k: int = 10, value: Column | None = None) -> DataFrame:
    """``dim, day, n`` of the ``k`` largest values over the last ``days`` days, with zeros for days without any."""
    window = df.where(F.col("day").between(F.date_sub(run_date, days - 1), run_date))
    counts = window.groupBy(dim, "day").agg((F.sum(value) if value is not None else F.count("*")).cast("bigint").alias("n"))
    top = counts.groupBy(dim).agg(F.sum("n").alias("total")).orderBy(F.desc("total"), dim).limit(k)
    grid = top.select(dim, F.explode(F.sequence(F.date_sub(run_date, days - 1), run_date)).alias("day"))
    return grid.join(counts, [dim, "day"], "left").select(dim, "day", F.coalesce("n", F.lit(0)).alias("n"))


def source_daily(status: DataFrame) -> DataFrame:
    return status.groupBy("source", "day").agg(F.sum("fetched").cast("bigint").alias("fetched"), F.count_if("is_new").alias("new"))


def source_status(status: DataFrame, history: DataFrame, items: DataFrame) -> DataFrame:
    """Each source's status with the days of its history (``day, fetched``; null where there are none) and the type of its first article."""
    kind = items.groupBy("source").agg(F.min_by("source_type", "ord").alias("source_type"), F.count("*").alias("n_all"))
    return status.join(history, "source", "left").join(kind, "source", "left")


def source_report(status: DataFrame, history: DataFrame, items: DataFrame, run_ts: Column, days: int) -> DataFrame:
    """For each source: status, articles and fetched ones of a period of days of Seoul, and the last active day of it, or ever; most articles first.

    ``status`` has a row a source, ``history`` ``source, day, fetched``.
    """
    today = seoul_date(run_ts)
    inside = lambda day: day.between(F.date_sub(today, days - 1), today)
    live = F.col("fetched") > 0
    past = history.groupBy("source").agg(F.sum(F.when(inside(F.col("day")), F.col("fetched")).otherwise(0)).cast("bigint").alias("fetched"), F.coalesce(F.max(F.when(inside(F.col("day")) & live, F.col("day"))), F.max(F.when(live, F.col("day")))).alias("last_active"))
    own = items.groupBy("source").agg(F.min_by("source_type", "ord").alias("source_type"), F.count_if(inside(seoul_date(F.col("published_at")))).alias("n_new"))
    return status.join(past, "source", "left").join(own, "source", "left").fillna(0, ["fetched", "n_new"]).orderBy(F.desc("n_new"), "source")


def status_histogram(report: DataFrame) -> DataFrame:
    """Sources of each status, with the articles of the period that they have."""
    return report.groupBy("status").agg(F.count("*").alias("n_sources"), F.sum("n_new").alias("n_new"))


def bookmark_profile(marked: DataFrame, strengths: Column, top: int = 3, share: float = 0.2, least: int = 35) -> DataFrame:
    """One row: mean strengths of saved articles, the ``top`` categories, and whether too many lie under the cut."""
    under = F.count_if(F.col("score") < least) / F.count("*")
    work = marked.withColumn("__b", strengths)
    means = work.agg(*(F.avg(f"__b.{c}").alias(c) for c in ("law", "global", "policy", "promo")), (under > share).alias("lower_cut"))
    cats = facet_counts(marked).orderBy(F.desc("n"), "value").limit(top).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "value"))).alias("c"))
    return means.crossJoin(F.broadcast(cats.select(F.transform("c", lambda x: x["value"]).alias("top_categories"))))


def build_stats(items: DataFrame) -> DataFrame:
    return items.agg(F.count("*").alias("total"), F.count_if("llm_enriched").alias("enriched"), F.count_if(F.col("related_count") > 0).alias("with_related"))


def persona_histogram(items: DataFrame, agenda: Column) -> DataFrame:
    """Articles of each rating and the share of them on the agenda."""
    return items.groupBy("persona_score").agg(F.count("*").alias("n"), F.avg(agenda.cast("int")).alias("agenda"))


def saved_items(items: DataFrame, marks: DataFrame, key: str = "ord") -> DataFrame:
    """Saved articles with the time of saving."""
    return items.join(marks.select(key, "saved_at"), key)


def saved_order(df: DataFrame, n: int) -> DataFrame:
    """The latest saved first; an old mark without a time counts as saved at 1."""
    return df.orderBy(F.desc(F.coalesce("saved_at", F.lit(1))), "ord").limit(n)


def quartiles(df: DataFrame, value: str) -> DataFrame:
    """Positional quartiles ``s[n // 4]``, ``s[n // 2]``, ``s[3 n // 4]``, extremes, mean and the share below 35.

    Positions come from counts of the distinct values, not from a sort of all rows.
    """
    per = df.groupBy(value).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    per = per.withColumn("upto", upto).withColumn("total", F.sum("n").over(Window.partitionBy()))
    at = lambda p: F.min(F.when(F.col("upto") > p, F.col(value)))
    t = F.col("total")
    return per.agg(at(F.floor(t / 4)).alias("q1"), at(F.floor(t / 2)).alias("q2"), at(F.floor(3 * t / 4)).alias("q3"), F.min(value).alias("least"), F.max(value).alias("most"), (F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias("mean"), (F.sum(F.when(F.col(value) < 35, F.col("n")).otherwise(0)) / F.sum("n")).alias("below_35"))


def title_keywords(papers: DataFrame, stopwords, k: int = 20) -> DataFrame:
    """The most frequent words of four letters or more, and pairs of neighbours, of titles; stop words never count."""
    words = F.regexp_extract_all(F.lower("title"), F.lit("([a-z]{4,})"), F.lit(1))
    good = lambda w: ~w.isin(*stopwords) if stopwords else F.lit(True)
    both = F.transform(F.array(words), lambda ws: F.concat(F.filter(ws, good), F.array_compact(F.zip_with(F.slice(ws, F.lit(1), F.greatest(F.size(ws) - 1, F.lit(0))), F.slice(ws, F.lit(2), F.greatest(F.size(ws) - 1, F.lit(0))), lambda a, b: F.when(good(a) & good(b), F.concat_ws(" ", a, b))))))[0]
    return papers.select(F.explode(both).alias("keyword")).groupBy("keyword").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "keyword").limit(k)


def institution_counts(papers: DataFrame, names, k: int = 15) -> DataFrame:
    """In how many papers each name occurs."""
    text = F.lower(F.concat_ws(" ", "title", "summary"))
    found = F.transform(F.array(text), lambda t: F.array_compact(F.array(*(F.when(F.contains(t, F.lit(n.lower())), F.lit(n)) for n in names))))[0]
    return papers.select(F.explode(found).alias("name")).groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(k)


def resolve_citations(cards: DataFrame, ranked: DataFrame, most: int = 5, keys=("period", "key")) -> DataFrame:
    """Card citations, 1-based places in the ranked list of the period, as articles; places outside the list are dropped."""
    cited = cards.select(*keys, "ord", F.posexplode(F.slice("sources", 1, most)).alias("place", "rank"))
    return cited.join(ranked.select(*keys, "rank", "url", F.substring("title", 1, 140).alias("title")), [*keys, "rank"])


def attach_papers(cards: DataFrame, ranked: DataFrame, most: int = 8, keys=("period", "key")) -> DataFrame:
    """Cards with their cited papers as structs in ``papers``; a ``paper_count`` that they bring stays, else it is the number cited.

    ``sources`` holds 1-based places in the ranked list of the period; places outside it are dropped.
    """
    shown = ranked.select(*keys, "rank", F.struct("url", F.substring("title", 1, 160).alias("title"), "source", F.substring("date_raw", 1, 10).alias("date")).alias("paper"))
    cited = cards.select(*keys, "ord", F.posexplode(F.slice("sources", 1, most)).alias("place", "rank")).join(shown, [*keys, "rank"])
    papers = cited.groupBy(*keys, "ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "paper"))), lambda x: x["paper"]).alias("papers"))
    own = F.col("paper_count") if "paper_count" in cards.columns else F.lit(None).cast("int")
    out = cards.join(papers, [*keys, "ord"], "left").withColumn("paper_count", F.coalesce(own, F.greatest(F.size("papers"), F.lit(0))))
    return out.withColumn("papers", F.coalesce("papers", F.array().cast(out.schema["papers"].dataType)))


def uncited_items(ranked: DataFrame, cards: DataFrame) -> DataFrame:
    """Ranked articles that no card cites."""
    return ranked.join(resolve_citations(cards, ranked).select("url"), "url", "left_anti")


def persona_coverage(items: DataFrame, cards: DataFrame, ranked: DataFrame, least: int = 8) -> DataFrame:
    """For each source its highly rated articles and how many of them cards cite."""
    cited = resolve_citations(cards, ranked).select("url").distinct().withColumn("__cited", F.lit(True))
    return items.where(F.col("persona_score") >= least).join(cited, "url", "left").groupBy("source").agg(F.count("*").alias("n_high"), F.count_if(F.col("__cited").isNotNull()).alias("n_cited"))


def joined_head(df: DataFrame, key: str, n: int, order: str, value: Column, separator: str = ", ") -> DataFrame:
    """The first ``n`` values of each key in order, joined; a key never holds more than those."""
    top = df.select(key, F.col(order).alias("__o"), value.alias("__v")).withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy("__o"))).where(F.col("__r") <= n)
    return top.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__r", "__v"))), lambda x: x["__v"]), separator).alias("head"))


def fallback_summary(cards: DataFrame, key: str, most: int = 5) -> DataFrame:
    """A period's summary from the tags of its first cards, without their numbers."""
    tag = F.regexp_replace("tag", "^TREND [0-9]+ · ", "")
    return joined_head(cards, key, most, "ord", tag).withColumnRenamed("head", "summary")


def fallback_citations(cards: DataFrame, ranked: DataFrame, generic=(), least: int = 3, most: int = 5, pool: int = 30, keys=("period", "key")) -> DataFrame:
    """Articles for cards without citations: those of the first ``pool`` of whose first ten longer title words ``least`` stand in the card."""
    words = F.slice(F.filter(F.split(F.lower("title"), r"\s+"), lambda w: (F.length(w) > 3) & (~w.isin(*generic) if generic else F.lit(True))), 1, 10)
    listed = ranked.where(F.col("rank") <= pool).select(*keys, "rank", "url", words.alias("words"))
    text = F.lower(F.concat_ws(" ", "tag", "card_title", "body"))
    j = cards.where("size(sources) = 0").withColumnRenamed("title", "card_title").withColumn("text", text).join(listed, list(keys))
    hits = j.where(F.size(F.filter("words", lambda w: F.contains(F.col("text"), w))) >= least)
    return hits.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "ord").orderBy("rank"))).where(F.col("place") <= most).withColumn("place", F.col("place").cast("bigint")).select(*keys, "ord", "place", "url")


@dataclass(frozen=True)
class FeedSpec:
    """What a reader asks of the feed; unset parts don't filter."""

    lang: str | None = None
    day: str | None = None
    within_days: int | None = None
    categories: tuple[str, ...] = ()
    search: tuple[str, ...] = ()
    order: str = "importance"
    page: int = 1
    page_size: int = 60


def feed_query(df: DataFrame, spec: FeedSpec, run_ts: Column) -> DataFrame:
    """Filtered, ordered and paged articles. Filters are plain predicates, so that they reach the scan."""
    if spec.lang:
        df = df.where(F.col("lang") == spec.lang)
    if spec.day:
        df = df.where(seoul_date(F.col("published_at")) == spec.day)
    if spec.within_days:
        df = df.where(F.col("published_at") >= run_ts - F.expr(f"interval {spec.within_days} days"))
    if spec.categories:
        df = df.where(F.arrays_overlap("categories", F.array(*map(F.lit, spec.categories))))
    if spec.search:
        text = F.lower(F.concat_ws(" ", "title", "summary", "source", F.concat_ws(" ", "categories")))
        df = df.where(F.exists(F.array(*(F.lit(t.lower()) for t in spec.search)), lambda t: F.contains(text, t)))
    return df.orderBy(*ORDERS[spec.order]()).limit(spec.page * spec.page_size)


def feed_page(df: DataFrame, spec: FeedSpec, run_ts: Column) -> DataFrame:
    """One page of the feed alone."""
    return feed_query(df, spec, run_ts).offset((spec.page - 1) * spec.page_size)


ORDERS = {
    "importance": lambda: (F.desc(F.coalesce("persona_score", F.lit(-1))), F.desc("score"), F.desc("published_at"), F.col("ord")),
    "snapshot": lambda: (F.desc("score"), F.desc("date_raw"), F.col("ord")),
    "latest": lambda: (F.desc("published_at"), F.col("ord")),
}


def expand_search(terms, synonyms: dict[str, tuple[str, ...]]) -> tuple[str, ...]:
    """Search terms with their synonyms in either language."""
    out = []
    for t in terms:
        out += [t, *synonyms.get(t, ()), *(k for k, v in synonyms.items() if t in v)]
    return tuple(dict.fromkeys(out))


def band_of_periods(items: DataFrame, cards: DataFrame, least: dict[str, int]) -> DataFrame:
    """For each period key: articles, uncited ones, and whether cards are to be built, extended or left. ``cards`` has a row ``period, key, url`` a citation."""
    cited = cards.select("period", "key", "url").distinct().withColumn("cited", F.lit(True))
    counts = items.join(cited, ["period", "key", "url"], "left").groupBy("period", "key").agg(F.count("*").alias("n_items"), F.count_if(F.col("cited").isNull()).alias("n_uncited"))
    have = cards.select("period", "key").distinct().withColumn("built", F.lit(True))
    need = F.create_map(*(F.lit(x) for kv in least.items() for x in kv))
    out = counts.join(have, ["period", "key"], "left")
    enough = F.col("n_items") >= F.coalesce(F.try_element_at(need, F.col("period")), F.lit(1))
    action = F.when(F.col("built").isNull() & enough, "build").when(F.col("built") & (F.col("period") == "daily") & (F.col("n_uncited") >= 5), "extend").otherwise("keep")
    return out.select("period", "key", "n_items", "n_uncited", action.alias("action"))

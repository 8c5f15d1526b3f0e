"""Queries of facets, statistics, trends, bookmarks, the feed, sinks, payload readers and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from newswell.functions import dates
from newswell.functions.lexicon import DEMO
from newswell.operators import classify, history, reports
from newswell.plans import article_queries
from newswell.plans.article_queries import _any, _hits
from newswell.plans.base import ARTICLES, Registry, articles, clean_sql, run_ts, shape_articles, stripped_sql, table, unescaped_sql
from newswell.sources import payloads, tables
from newswell.sources.snapshots import SnapshotTable, daily_digest
from newswell.storage import new_folder
from newswell.streaming import streams

_R = Registry()
QUERIES, SQL, query = _R.QUERIES, _R.SQL, _R.query


@query("a14_source_daily", "SELECT event_type AS source, strftime(ts, '%Y-%m-%d') AS day, count(*) AS fetched, count_if(event_id % 3 = 0)::BIGINT AS new FROM events GROUP BY ALL")
def a14(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("source"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.lit(1).alias("fetched"), (F.col("event_id") % 3 == 0).alias("is_new"))
    return reports.source_daily(e)


@query("a15_facet_counts", ARTICLES + "SELECT c AS value, count(*) AS n FROM (SELECT unnest(categories) AS c FROM articles WHERE lang = 'en') GROUP BY c")
def a15(spark, d):
    return reports.facet_counts(articles(spark, d).where("lang = 'en'"))


_HISTORY = """, h AS (SELECT 'src' || (user_id % 20) AS source, ts::DATE AS day, count(*) AS fetched FROM events GROUP BY ALL), status AS (SELECT source, CASE WHEN max(day) >= DATE '2024-01-30' THEN 'active' ELSE 'quiet' END AS status FROM h GROUP BY source),
a AS (SELECT *, (published_at + INTERVAL 9 HOUR)::DATE AS own FROM articles)
"""
_TODAY = "DATE '2024-01-31'"


def _history(spark, d):
    return table(spark, d, "events").groupBy(F.concat(F.lit("src"), F.col("user_id") % 20).alias("source"), F.to_date("ts").alias("day")).agg(F.count("*").alias("fetched"))


def _status(h):
    return h.groupBy("source").agg(F.when(F.max("day") >= "2024-01-30", "active").otherwise("quiet").alias("status"))


@query("a16_period_stats", ARTICLES + _HISTORY + f""", d AS (SELECT unnest([1, 7, 30, 60])::INT AS days), i AS (SELECT days, count(*) AS n_items, count_if(own <= {_TODAY})::BIGINT AS n_new, count_if(llm_enriched)::BIGINT AS n_enriched, count_if(related_count > 0)::BIGINT AS n_related FROM a, d WHERE datediff('day', own, {_TODAY}) < days GROUP BY days),
s AS (SELECT days, count(DISTINCT source) AS n_sources FROM h, d WHERE fetched > 0 AND day <= {_TODAY} AND datediff('day', day, {_TODAY}) < days GROUP BY days)
SELECT coalesce(i.days, s.days) AS days, coalesce(n_items, 0) AS n_items, coalesce(n_new, 0) AS n_new, coalesce(n_enriched, 0) AS n_enriched, coalesce(n_related, 0) AS n_related, coalesce(n_sources, 0) AS n_sources FROM i FULL JOIN s ON i.days = s.days""")
def a16(spark, d):
    return reports.period_stats(articles(spark, d), _history(spark, d), run_ts())


_REPORT = ARTICLES + _HISTORY + f""", p AS (SELECT source, sum(CASE WHEN day BETWEEN {_TODAY} - 6 AND {_TODAY} THEN fetched ELSE 0 END)::BIGINT AS fetched, coalesce(max(CASE WHEN day BETWEEN {_TODAY} - 6 AND {_TODAY} THEN day END), max(day)) AS last_active FROM h GROUP BY source),
k AS (SELECT source, arg_min(source_type, ord) AS source_type, count(*) AS n_all, count_if(own BETWEEN {_TODAY} - 6 AND {_TODAY})::BIGINT AS n_new FROM a GROUP BY source),
r AS (SELECT source, status, fetched, strftime(last_active, '%Y-%m-%d') AS last_active, source_type, coalesce(n_new, 0) AS n_new FROM status LEFT JOIN p USING (source) LEFT JOIN k USING (source))
"""


@query("a17_source_report", _REPORT + "SELECT * FROM r")
def a17(spark, d):
    h = _history(spark, d)
    out = reports.source_report(_status(h), h, articles(spark, d), run_ts(), 7)
    return out.select("source", "status", "fetched", F.date_format("last_active", "yyyy-MM-dd").alias("last_active"), "source_type", "n_new")


@query("a17b_status_histogram", _REPORT + "SELECT status, count(*) AS n_sources, sum(n_new)::BIGINT AS n_new FROM r GROUP BY status")
def a17b(spark, d):
    h = _history(spark, d)
    return reports.status_histogram(reports.source_report(_status(h), h, articles(spark, d), run_ts(), 7))


@query("j16b_source_status", _REPORT + "SELECT status.source, status, strftime(day, '%Y-%m-%d') AS day, fetched, source_type, n_all FROM status LEFT JOIN h USING (source) LEFT JOIN k USING (source)")
def j16b(spark, d):
    h = _history(spark, d)
    return reports.source_status(_status(h), h, articles(spark, d)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def _trend(dim: str, frm: str, k: int) -> str:
    return f", t AS ({frm}), w AS (SELECT {dim}, day, count(*) AS n FROM t WHERE day BETWEEN DATE '2024-01-23' AND DATE '2024-01-29' GROUP BY ALL), top AS (SELECT {dim}, sum(n) AS total FROM w GROUP BY ALL ORDER BY total DESC, {dim} LIMIT {k}), g AS (SELECT {dim}, (DATE '2024-01-23' + i::INT)::DATE AS day FROM top, range(7) r(i)) SELECT g.{dim}, strftime(g.day, '%Y-%m-%d') AS day, coalesce(n, 0)::BIGINT AS n FROM g LEFT JOIN w ON w.{dim} = g.{dim} AND w.day = g.day"


def _shown(df):
    return df.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("a18_category_trend", ARTICLES + _trend("category", "SELECT unnest(categories) AS category, (published_at + INTERVAL 9 HOUR)::DATE AS day FROM articles WHERE NOT date_unknown", 10))
def a18(spark, d):
    a = articles(spark, d).where("NOT date_unknown").select(F.explode("categories").alias("category"), dates.seoul_date(F.col("published_at")).alias("day"))
    return _shown(reports.trend_matrix(a, "category", F.lit("2024-01-29").cast("date")))


@query("a19_source_trend", "WITH x AS (SELECT 1)" + _trend("source", "SELECT 'u' || user_id AS source, ts::DATE AS day FROM events", 8))
def a19(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("u"), "user_id").alias("source"), F.to_date("ts").alias("day"))
    return _shown(reports.trend_matrix(e, "source", F.lit("2024-01-29").cast("date"), k=8))


_MARKED = ARTICLES + ", m AS (SELECT a.* FROM articles a JOIN labels ON doc_id = ord)"


def _marked(spark, d):
    return articles(spark, d).join(table(spark, d, "labels").select(F.col("doc_id").alias("ord"), "quality"), "ord")


@query("a20_bookmark_quartiles", _MARKED + ", s AS (SELECT list(score ORDER BY score) AS s, count(*) AS n FROM m) SELECT s[n // 4 + 1] AS q1, s[n // 2 + 1] AS q2, s[3 * n // 4 + 1] AS q3, s[1] AS least, s[n] AS most, round(list_sum(s) / n, 6)::DOUBLE AS mean, round(len(list_filter(s, lambda x: x < 35)) / n, 6)::DOUBLE AS below_35 FROM s")
def a20(spark, d):
    q = reports.quartiles(_marked(spark, d), "score")
    return q.withColumn("mean", F.round("mean", 6)).withColumn("below_35", F.round("below_35", 6))


@query("a21_bookmark_categories", _MARKED + "SELECT c AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM m), 6)::DOUBLE AS share FROM (SELECT unnest(categories) AS c FROM m) GROUP BY c")
def a21(spark, d):
    m = _marked(spark, d)
    total = m.agg(F.count("*").alias("total"))
    return reports.facet_counts(m).crossJoin(F.broadcast(total)).select("value", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


_STRENGTHS = ", x AS (SELECT ord, score, categories, lower(title || ' ' || summary) AS x, lower(title) AS h FROM m)"


@query("a21b_bookmark_profile", _MARKED + _STRENGTHS + ", t AS (SELECT c, count(*) AS n FROM (SELECT unnest(categories) AS c FROM m) GROUP BY c ORDER BY n DESC, c LIMIT 3) SELECT " + ", ".join(f"round(avg(round(1 - pow(0.78, {_hits('x', n)}), 3)), 6)::DOUBLE AS {n}" for n in ("law", "global", "policy")) + f", round(avg(CASE WHEN {_any('h', 'promo')} THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS promo, count_if(score < 35) / count(*) > 0.2 AS lower_cut, (SELECT string_agg(c, ',' ORDER BY n DESC, c) FROM t) AS top_categories FROM x")
def a21b(spark, d):
    out = reports.bookmark_profile(_marked(spark, d), classify.bucket_strengths(F.col("title"), F.col("summary"), DEMO))
    return out.select(*(F.round(c, 6).alias(c) for c in ("law", "global", "policy", "promo")), "lower_cut", F.array_join("top_categories", ",").alias("top_categories"))


@query("a22_build_stats", ARTICLES + "SELECT count(*) AS total, count_if(llm_enriched)::BIGINT AS enriched, count_if(related_count > 0)::BIGINT AS with_related FROM articles")
def a22(spark, d):
    return reports.build_stats(articles(spark, d))


@query("a27_persona_histogram", ARTICLES + "SELECT persona_score, count(*) AS n, round(avg(list_has_any(categories, ['legaltech', 'policy'])::INT), 6)::DOUBLE AS agenda FROM articles GROUP BY persona_score")
def a27(spark, d):
    hit = F.arrays_overlap("categories", F.array(F.lit("legaltech"), F.lit("policy")))
    return reports.persona_histogram(articles(spark, d), hit).withColumn("agenda", F.round("agenda", 6))


@query("j03_bookmark_match", ARTICLES + "SELECT ord IS NOT NULL AS matched, count(*) AS n FROM (SELECT doc_id * 2 AS k FROM labels) LEFT JOIN articles ON ord = k GROUP BY ALL")
def j03(spark, d):
    marks = table(spark, d, "labels").select((F.col("doc_id") * 2).alias("ord"))
    return history.match_bookmarks(marks, articles(spark, d), "ord")


@query("j15_saved_items", ARTICLES + "SELECT ord, quality AS saved_at FROM articles JOIN labels ON doc_id = ord")
def j15(spark, d):
    marks = table(spark, d, "labels").select(F.col("doc_id").alias("ord"), F.col("quality").alias("saved_at"))
    return reports.saved_items(articles(spark, d), marks).select("ord", "saved_at")


@query("j16_source_status", ARTICLES + "SELECT source, count(*) AS n, arg_min(source_type, ord) AS source_type, max(score) AS best FROM articles GROUP BY source")
def j16(spark, d):
    return articles(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.min_by("source_type", "ord").alias("source_type"), F.max("score").alias("best"))


@query("j19_expand_selection", ARTICLES + "SELECT url, min(ord) AS ord FROM (SELECT url, ord FROM articles WHERE persona_score >= 10 UNION ALL SELECT url, ord FROM articles WHERE source IN (SELECT max(source) FROM articles)) WHERE url <> '' GROUP BY url")
def j19(spark, d):
    a = articles(spark, d)
    cited = a.join(a.agg(F.max("source").alias("source")), "source", "left_semi")
    return history.expand_selection(a.where("persona_score >= 10"), cited)


_SEARCH = "len(list_filter(['leaux', 'inger'], lambda k: contains(lower(concat_ws(' ', title, summary, source, array_to_string(categories, ' '))), k))) > 0"


@query("p15_feed_filters", ARTICLES + "SELECT ord FROM articles WHERE lang = 'en' AND (published_at + INTERVAL 9 HOUR)::DATE = DATE '2024-01-12' ORDER BY coalesce(persona_score, -1) DESC, score DESC, published_at DESC, ord LIMIT 60")
def p15(spark, d):
    return reports.feed_query(articles(spark, d), reports.FeedSpec(lang="en", day="2024-01-12"), run_ts()).select("ord")


@query("p16_category_filter", ARTICLES + "SELECT ord FROM articles WHERE list_has_any(categories, ['policy', 'funding']) AND published_at >= TIMESTAMP '2024-01-24' ORDER BY score DESC, date_raw DESC, ord LIMIT 120")
def p16(spark, d):
    return reports.feed_query(articles(spark, d), reports.FeedSpec(within_days=7, categories=("policy", "funding"), order="snapshot", page=2), run_ts()).select("ord")


@query("p17_search", ARTICLES + f"SELECT ord FROM articles WHERE {_SEARCH} ORDER BY published_at DESC, ord LIMIT 60")
def p17(spark, d):
    terms = reports.expand_search(("inger",), {"leaux": ("inger",)})
    return reports.feed_query(articles(spark, d), reports.FeedSpec(search=terms, order="latest"), run_ts()).select("ord")


@query("o02_importance_order", ARTICLES + "SELECT ord FROM articles ORDER BY coalesce(persona_score, -1) DESC, score DESC, published_at DESC, ord LIMIT 180")
def o02(spark, d):
    return reports.feed_query(articles(spark, d), reports.FeedSpec(page=3), run_ts()).select("ord")


@query("o03_latest_order", ARTICLES + "SELECT ord FROM articles ORDER BY published_at DESC, ord LIMIT 60")
def o03(spark, d):
    return reports.feed_query(articles(spark, d), reports.FeedSpec(order="latest"), run_ts()).select("ord")


@query("o04_second_page", ARTICLES + "SELECT ord FROM articles ORDER BY published_at DESC, ord LIMIT 60 OFFSET 60")
def o04(spark, d):
    return reports.feed_page(articles(spark, d), reports.FeedSpec(order="latest", page=2), run_ts()).select("ord")


@query("o05_saved_order", _MARKED.replace("a.*", "a.*, quality") + "SELECT ord FROM m ORDER BY coalesce(quality, 1) DESC, ord LIMIT 60")
def o05(spark, d):
    return reports.saved_order(_marked(spark, d).withColumnRenamed("quality", "saved_at"), 60).select("ord")


_CLEAN = "trim(regexp_replace(regexp_replace({0}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("s03_feed_articles", ARTICLES + f", e AS (SELECT ord, {_CLEAN.format('title')} AS title, 'https://f.example/' || ord AS url, ord % 3 = 0 AS date_unknown, CASE WHEN ord % 3 = 0 THEN TIMESTAMP '2024-01-31' ELSE published_at END AS tm FROM articles) SELECT url, title, date_unknown, strftime(tm, '%Y-%m-%d %H:%M') AS published FROM e WHERE title <> ''")
def s03(spark, d):
    i = F.col("ord")
    e = articles(spark, d).select("title", F.concat(F.lit(" https://f.example/"), i, F.lit("?utm_source=a")).alias("link"), F.lit("x").alias("summary"), F.when(i % 3 != 0, F.concat(F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))).alias("pubDate"))
    return payloads.normalise_feed(e, F.lit("f"), F.lit("rss"), F.lit("en"), run_ts()).select("url", "title", "date_unknown", F.date_format("published_at", "yyyy-MM-dd HH:mm").alias("published"))


def _landed(spark, d):
    """Pages as feed documents of one entry: RSS, Atom and RDF, some broken, some empty, some without a summary."""
    p, i = table(spark, d, "pages"), F.col("page_id")
    title = F.replace(F.replace(payloads.raw_title(F.col("html")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    url = F.replace("url", F.lit("&"), F.lit("&amp;"))
    day = F.format_string("2024-01-%02d", i % 28 + 1)
    rss = F.concat(F.lit("<rss><channel><title>c</title><item><title>"), title, F.lit("</title><link>"), url, F.lit("</link><summary></summary><description>told "), i, F.lit("</description><pubDate>"), day, F.lit("T01:02:03Z</pubDate></item></channel></rss>"))
    atom = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="text">'), title, F.lit('</title><link rel="self" href="http://self"/><link rel="alternate" href="'), url, F.lit('"/><content>c '), i, F.lit("</content><updated>"), day, F.lit("T01:02:03+09:00</updated></entry></feed>"))
    rdf = F.concat(F.lit('<rdf:RDF xmlns:rdf="r" xmlns:dc="d" xmlns:content="c"><item><title>'), title, F.lit("</title><link>"), url, F.lit("</link><content:encoded>&lt;b&gt;e&lt;/b&gt; "), i, F.lit("</content:encoded><dc:date>"), day, F.lit("T01:02:03.5Z</dc:date></item></rdf:RDF>"))
    body = F.when(i % 7 == 0, F.substring(rss, F.lit(1), F.length(rss) - 25)).when(i % 7 == 1, "<rss><channel><title>c</title></channel></rss>").when(i % 3 == 0, rss).when(i % 3 == 1, atom).otherwise(rdf)
    return p.select(i.alias("source"), body.alias("body"))


_ENTRIES = "WITH p AS (SELECT page_id AS i, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, page_id % 7 AS k FROM pages), e AS (SELECT *, k = 0 AS broken, k = 1 AS nothing FROM p)"


@query("s03b_feeds_from_bytes", _ENTRIES + ", t AS (SELECT i, regexp_replace(regexp_replace(url, '[?&](utm_[^=]+|fbclid|gclid|mc_cid|mc_eid)=[^&]*', '', 'g'), '\\?$', '') AS url, " + clean_sql("title") + " AS title, CASE i % 3 WHEN 0 THEN 'told ' WHEN 1 THEN 'c ' ELSE 'e ' END || i AS summary, strftime(DATE '2024-01-01' + (i % 28)::INT + INTERVAL 1 HOUR + INTERVAL 2 MINUTE + INTERVAL 3 SECOND - CASE WHEN i % 3 = 1 THEN INTERVAL 9 HOUR ELSE INTERVAL 0 HOUR END, '%Y-%m-%d %H:%M:%S') AS published FROM e WHERE NOT broken AND NOT nothing AND NOT regexp_matches(title || url, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{FFFE}\\x{FFFF}]')) SELECT i AS source, url, title, summary, published FROM t WHERE title <> ''")
def s03b(spark, d):
    entries = payloads.feed_entries(_landed(spark, d)).where("NOT broken")
    out = payloads.normalise_feed(entries, F.col("source"), F.lit("rss"), F.lit("en"), run_ts())
    return out.select("source", "url", "title", "summary", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published"))


@query("s03c_feed_status", _ENTRIES + " SELECT i AS source, CASE WHEN broken THEN 'error' WHEN nothing OR trim(title) = '' THEN 'idle' ELSE 'active' END AS status, CASE WHEN broken OR nothing OR trim(title) = '' THEN 0 ELSE 1 END::BIGINT AS count FROM e")
def s03c(spark, d):
    landed = _landed(spark, d)
    return payloads.feed_status(landed, payloads.feed_entries(landed))


@query("s05_sitemap_pages", "SELECT url FROM (SELECT rtrim(url, '/') AS url, TIMESTAMP '2024-01-26' + to_hours((page_id % 120)::INT) AS tm FROM pages) WHERE contains(url, '/en/') AND tm >= TIMESTAMP '2024-01-27' ORDER BY tm DESC, url LIMIT 12")
def s05(spark, d):
    at = F.expr("timestampadd(HOUR, page_id % 120, timestamp'2024-01-26 00:00:00')")
    urls = table(spark, d, "pages").select(F.col("url").alias("loc"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("lastmod"))
    return payloads.sitemap_pages(urls, "/en/", run_ts()).select("url")


@query("s07_news_search", ARTICLES + f", e AS (SELECT {_CLEAN.format('title')} AS title, CASE WHEN ord % 2 = 0 THEN 'http://o.example/' || ord ELSE 'http://l.example/' || ord END AS url, published_at - INTERVAL 9 HOUR AS tm FROM articles) SELECT title, url, strftime(tm, '%Y-%m-%d %H:%M') AS published FROM e WHERE title <> ''")
def s07(spark, d):
    i = F.col("ord")
    items = articles(spark, d).select("title", F.when(i % 2 == 0, F.concat(F.lit("http://o.example/"), i)).otherwise("").alias("originallink"), F.concat(F.lit("http://l.example/"), i).alias("link"), F.lit("d").alias("description"), F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("pubDate"))
    out = payloads.news_search(items, F.array(F.lit("market")), run_ts(), F.lit("o"))
    return out.select("title", "url", F.date_format("published_at", "yyyy-MM-dd HH:mm").alias("published"))


@query("s08_scholarly_works", ARTICLES + f", e AS (SELECT ord, {_CLEAN.format('title')} AS title, published_at::DATE AS day, score FROM articles) SELECT 'https://w.example/' || ord AS url, title, 'A, B, C · V' AS source, strftime(day, '%Y-%m-%d') AS day, (CASE WHEN score >= 100 THEN 12 WHEN score >= 30 THEN 8 WHEN score >= 10 THEN 4 ELSE 0 END)::INT AS boost FROM e WHERE day >= DATE '2024-01-11'")
def s08(spark, d):
    person = lambda n: F.struct(F.struct(F.lit(n).alias("display_name")).alias("author"))
    none = F.lit(None).cast("string")
    works = articles(spark, d).select(F.concat(F.lit("w"), "ord").alias("id"), "title", none.alias("display_name"), F.date_format("published_at", "yyyy-MM-dd").alias("publication_date"), none.alias("doi"), F.col("score").alias("cited_by_count"), F.struct(none.alias("oa_url")).alias("open_access"), F.struct(F.concat(F.lit("https://w.example/"), "ord").alias("landing_page_url"), F.struct(F.lit("V").alias("display_name")).alias("source")).alias("primary_location"), F.array(*map(person, "ABCD")).alias("authorships"), F.lit(None).cast("map<string,array<int>>").alias("abstract_inverted_index"))
    return payloads.scholarly_works(works, run_ts(), days_back=20).select("url", "title", "source", F.date_format("published_at", "yyyy-MM-dd").alias("day"), "boost")


@query("s09_semantic_works", ARTICLES + f", e AS (SELECT ord, {_CLEAN.format('title')} AS title, published_at, score FROM articles) SELECT CASE WHEN ord % 3 = 0 THEN 'https://arxiv.org/abs/' || ord ELSE 'https://p.example/' || ord END AS url, title, CASE WHEN ord % 2 = 0 THEN strftime(published_at, '%Y-%m-%d') ELSE '2024-01-01' END AS day, ord % 2 <> 0 AS date_unknown, (CASE WHEN score >= 50 THEN 8 WHEN score >= 10 THEN 4 ELSE 0 END)::INT AS boost FROM e")
def s09(spark, d):
    i, none = F.col("ord"), F.lit(None).cast("string")
    works = articles(spark, d).select("title", F.struct(F.when(i % 3 == 0, i.cast("string")).alias("ArXiv"), none.alias("DOI")).alias("externalIds"), F.concat(F.lit("https://p.example/"), i).alias("url"), none.alias("paperId"), F.when(i % 2 == 0, F.date_format("published_at", "yyyy-MM-dd")).alias("publicationDate"), F.lit(2024).alias("year"), F.col("score").alias("citationCount"))
    return payloads.semantic_works(works).select("url", "title", F.date_format("published_at", "yyyy-MM-dd").alias("day"), "date_unknown", "boost")


@query("s10_manual_first", ARTICLES + "SELECT url, arg_min(ord, (p, ord)) AS ord FROM (SELECT url, ord, CASE WHEN ord % 10 = 0 THEN 0 ELSE 1 END AS p FROM articles) GROUP BY url")
def s10(spark, d):
    a = articles(spark, d)
    both = history.union_sources(payloads.manual_articles(a.where("ord % 10 = 0")), a.where("ord % 10 <> 0").withColumn("priority", F.lit(1)))
    return history.first_per_key(both, ["url"], F.col("priority"), F.col("ord")).select("url", "ord")


def _meta(key: str) -> str:
    q = "[\"'']"
    a = f"regexp_extract(html, '(?is)<meta[^>]+(?:property|name)={q}{key}{q}[^>]*content={q}([^\"'']*){q}', 1)"
    b = f"regexp_extract(html, '(?is)<meta[^>]+content={q}([^\"'']*){q}[^>]*(?:property|name)={q}{key}{q}', 1)"
    return f"coalesce(nullif({a}, ''), nullif({b}, ''))"


_OG_TITLE = stripped_sql(unescaped_sql(f"coalesce({_meta('og:title')}, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), ''))"))
_OG_TEXT = "substring(" + stripped_sql(unescaped_sql(f"coalesce({_meta('og:description')}, {_meta('description')}, '')")) + ", 1, 400)"


@query("s06_open_graph", f"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, {_OG_TITLE} AS og_title, {_OG_TEXT} AS og_description FROM pages")
def s06(spark, d):
    return payloads.open_graph(table(spark, d, "pages")).select("page_id", payloads.raw_title(F.col("html")).alias("title"), "og_title", "og_description")


@query("s06t_open_graph_tags", f"SELECT page_id, {_OG_TITLE} AS og_title, {_OG_TEXT} AS og_description FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '<meta property=\"og:title\" content=\"A &amp; B\"><META name=\"description\" content=\"d\">' WHEN 1 THEN '<meta content=''told'' property=''og:description''>' ELSE '' END || html AS html FROM pages)")
def s06t(spark, d):
    k = F.col("page_id") % 3
    tags = F.when(k == 0, '<meta property="og:title" content="A &amp; B"><META name="description" content="d">').when(k == 1, "<meta content='told' property='og:description'>").otherwise("")
    return payloads.open_graph(table(spark, d, "pages").withColumn("html", F.concat(tags, "html"))).select("page_id", "og_title", "og_description")


@query("s01_read_envelope", ARTICLES + "SELECT url, title, score FROM articles")
def s01(spark, d):
    path = new_folder(spark, "envelopes")
    envelope = F.struct(F.lit("2024-01-31").alias("generated"), F.array(F.struct("url", "title", "score")).alias("items"))
    articles(spark, d).select(F.to_json(envelope)).write.text(path)
    return payloads.read_envelope(spark, path, "url string, title string, score int", lines=True)


@query("s02_first_existing", ARTICLES + "SELECT ord, score FROM articles")
def s02(spark, d):
    path = new_folder(spark, "deduped")
    articles(spark, d).select("ord", "score").write.parquet(path)
    return payloads.read_first_existing(spark, [f"{path}-enriched.json", f"{path}-enriched", path], "ord long, score int")


@query("s04_arxiv_entries", ARTICLES + """SELECT ord, array_to_string(list_filter(string_split(title, ' '), lambda x: trim(x) <> '')[1:10], '|') AS authors, array_to_string(list_filter(['cs.AI', source, lang || '.' || upper(lang), 'math.a'], lambda t: regexp_full_match(t, '[a-z\\-]+\\.[A-Z]{2,}')), '|') AS tags,
CASE WHEN ord % 2 = 0 THEN '2401.' || ord END AS arxiv_id, strftime(published_at, '%Y-%m-%d %H:%M') AS published FROM articles WHERE title <> ''""")
def s04(spark, d):
    i, a = F.col("ord"), articles(spark, d).where("title <> ''")
    link = F.concat(F.when(i % 2 == 0, "http://arxiv.org/abs/2401.").otherwise("http://arxiv.org/list/"), i, F.lit("v2"))
    tags = F.array_compact(F.array(F.lit("cs.AI"), "source", F.concat("lang", F.lit("."), F.upper("lang")), F.lit("math.a")))
    meta = payloads.arxiv_meta(link, F.split("title", " "), tags)
    e = a.select("title", link.alias("link"), meta.alias("meta"), "ord", F.lit("x").alias("summary"), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated"), F.lit("2020-01-01").alias("published"))
    dated = payloads.normalise_feed(e.select("title", F.concat(F.lit("u"), "ord").alias("link"), "summary", "updated", "published"), F.lit("arXiv"), F.lit("arxiv"), F.lit("en"), run_ts()).select("url", F.date_format("published_at", "yyyy-MM-dd HH:mm").alias("published"))
    return e.drop("published").withColumn("url", F.concat(F.lit("u"), "ord")).join(dated, "url").select("ord", F.array_join("meta.authors", "|").alias("authors"), F.array_join("meta.arxiv_tags", "|").alias("tags"), F.col("meta.arxiv_id").alias("arxiv_id"), "published")


@query("s11_active_sources", "SELECT source, 'https://' || source || '.example/feed' AS url, 'rss' AS source_type, coalesce(lang, 'en') AS lang FROM documents WHERE coalesce(n_chars > 500, true) QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1")
def s11(spark, d):
    none = F.lit(None).cast("string")
    catalog = table(spark, d, "documents").select("source", F.concat(F.lit("https://"), "source", F.lit(".example/feed")).alias("url"), none.alias("source_type"), "lang", none.alias("categories"), (F.col("n_chars") > 500).alias("active"), F.col("doc_id").alias("ord"))
    return payloads.active_sources(catalog).drop("categories")


@query("s11b_search_queries", "SELECT query, array_to_string(list_sort(list(DISTINCT role)), ',') AS categories FROM (SELECT split_part(text, ' ', 1) AS query, role FROM conversations) WHERE query <> '' GROUP BY query")
def s11b(spark, d):
    c = table(spark, d, "conversations").select(F.substring_index("text", " ", 1).alias("query"), F.col("role").alias("category"))
    return payloads.search_queries(c).withColumn("categories", F.array_join("categories", ","))


@query("s13c_snapshot_counters", ARTICLES + "SELECT '2024-01-31 00:00' AS built_at, count(*) AS n_items, count(DISTINCT source) AS n_sources, count_if(llm_enriched)::BIGINT AS n_enriched, count_if(related_count > 0)::BIGINT AS n_related FROM articles")
def s13c(spark, d):
    return tables.snapshot_counters(tables.write_snapshot(articles(spark, d), "news", new_folder(spark, "tables")), run_ts()).withColumn("built_at", F.date_format("built_at", "yyyy-MM-dd HH:mm"))


@query("s15b_digest_partitions", ARTICLES + "SELECT source_type AS kind, strftime(published_at, '%Y') AS yyyy, strftime(published_at, '%m') AS mm, count(*) AS n FROM articles GROUP BY ALL")
def s15b(spark, d):
    cards = articles(spark, d).select(F.col("source_type").alias("kind"), dates.day_key(F.col("published_at")).alias("day"), "ord", "title")
    return tables.write_digests(cards).groupBy("kind", "yyyy", "mm").agg(F.count("*").alias("n"))


@query("s16_rewrite_snapshot", ARTICLES + "SELECT ord, date_raw AS before, CASE WHEN lang = 'fr' AND NOT date_unknown THEN regexp_replace(date_raw, '(\\+00:00|Z)$', '+09:00') ELSE date_raw END AS after FROM articles")
def s16(spark, d):
    table = SnapshotTable(spark, "news", new_folder(spark, "tables"))
    table.write(articles(spark, d).withColumn("lang", F.when(F.col("lang") == "fr", "ko").otherwise(F.col("lang"))))
    new = tables.rewrite_snapshot(table)
    old = table.read(table.backup_of(new))
    return old.select("ord", F.col("date_raw").alias("before")).join(table.read().select("ord", F.col("date_raw").alias("after")), "ord")


@query("s16b_restore_snapshot", ARTICLES + "SELECT ord, date_raw, 4 AS version, 2 AS restored FROM articles")
def s16b(spark, d):
    """Two versions, a rewriting of the dates, and the version before it restored."""
    table = SnapshotTable(spark, "news", new_folder(spark, "tables"))
    table.write(articles(spark, d).where("false"))
    table.write(articles(spark, d))
    new = tables.rewrite_snapshot(table)
    version = table.restore(table.backup_of(new))
    return table.read().select("ord", "date_raw", F.lit(version).alias("version"), F.lit(table.entry(version)["restores"]).alias("restored"))


@query("s13b_read_as_of", ARTICLES + "SELECT ord, score, '2024-01-30T00:00:00' AS built_at FROM articles WHERE lang = 'en'")
def s13b(spark, d):
    """Three versions built on three days, read as they were on the second."""
    table = SnapshotTable(spark, "news", new_folder(spark, "tables"))
    for day, lang in ((29, "de"), (30, "en"), (31, "fr")):
        table.write(articles(spark, d).where(F.col("lang") == lang), built_at=f"2024-01-{day}T00:00:00")
    entry = table.entry(as_of="2024-01-30T12:00:00")
    return table.read(entry["version"]).select("ord", "score", F.lit(entry["built_at"]).alias("built_at"))


@query("s17_run_log", ARTICLES + "SELECT name, '2024-01-31 00:00' AS built_at, n_in, n_out FROM (SELECT 'news' AS name, count(*) AS n_in, count_if(score >= 20)::BIGINT AS n_out FROM articles)")
def s17(spark, d):
    a, log = articles(spark, d), f"{new_folder(spark, 'runs')}/log"
    record = tables.run_record(a.where("score >= 20"), "news", run_ts(), a.count())
    tables.append_run(record, log)
    return tables.append_run(record, log).withColumn("built_at", F.date_format("built_at", "yyyy-MM-dd HH:mm"))  # a rerun adds nothing


@query("s12_bookmark_rows", "SELECT 'i' || doc_id AS key, quality::BIGINT AS saved_at FROM labels")
def s12(spark, d):
    line = F.concat(F.lit('{"items":{"i'), "doc_id", F.lit('":{"savedAt":'), "quality", F.lit("}}}"))
    return payloads.bookmarks(table(spark, d, "labels").select(line.alias("value"))).select("key", "saved_at")


@query("s13_snapshot_roundtrip", ARTICLES + "SELECT ord, url, score FROM articles")
def s13(spark, d):
    return tables.write_snapshot(articles(spark, d), "news", new_folder(spark, "tables")).select("ord", "url", "score")


@query("s14_upsert_history", "WITH n AS (SELECT event_type AS source, strftime(ts, '%Y-%m-%d') AS key, count(*) AS n FROM events GROUP BY ALL) SELECT source, key, CASE WHEN key = '2024-01-10' THEN n * 2 ELSE n END AS n FROM n")
def s14(spark, d):
    n = table(spark, d, "events").groupBy(F.col("event_type").alias("source"), F.date_format("ts", "yyyy-MM-dd").alias("key")).agg(F.count("*").alias("n"))
    return history.upsert_history(n, n.where("key = '2024-01-10'").withColumn("n", F.col("n") * 2), ["source", "key"])


@query("s15_digest", ARTICLES + "SELECT strftime(published_at, '%Y-%m-%d') AS day, string_agg(ord::VARCHAR, ',' ORDER BY rank) AS top FROM (SELECT *, row_number() OVER (PARTITION BY published_at::DATE ORDER BY score DESC, ord) AS rank FROM articles) WHERE rank <= 10 GROUP BY ALL")
def s15(spark, d):
    a = articles(spark, d).withColumn("day", dates.day_key(F.col("published_at")))
    top = history.top_n_per(a, ["day"], 10, F.desc("score"), F.col("ord"))
    return top.groupBy("day").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "ord"))), lambda x: x["ord"].cast("string")), ",").alias("top"))


@query("s15c_daily_digest", ARTICLES + """, c AS (SELECT o_orderdate::DATE - DATE '1992-01-01' AS n, o_orderkey, o_orderpriority FROM orders), cards AS (SELECT strftime(DATE '2024-01-01' + (n % 31)::INT, '%Y-%m-%d') AS day, o_orderkey AS ord, o_orderpriority || ' ' || o_orderkey AS title FROM c),
k AS (SELECT day, count(*) AS n_cards, string_agg(title, '|' ORDER BY ord) FILTER (r <= 100) AS cards FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY ord) AS r FROM cards) GROUP BY day),
a AS (SELECT *, strftime(published_at, '%Y-%m-%d') AS day FROM articles), t AS (SELECT day, string_agg(ord::VARCHAR || ':' || score, '|' ORDER BY r) AS top FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY score DESC, ord) AS r FROM a) WHERE r <= 10 GROUP BY day),
s AS (SELECT day, string_agg(source_type || ':' || n, '|' ORDER BY source_type) AS kinds FROM (SELECT day, source_type, count(*) AS n FROM a GROUP BY ALL) GROUP BY day)
SELECT day, coalesce(n_cards, 0) AS n_cards, cards, top, kinds FROM k FULL JOIN t USING (day) FULL JOIN s USING (day)""")
def s15c(spark, d):
    n = F.date_diff(F.to_date("o_orderdate"), F.lit("1992-01-01")) % 31
    cards = table(spark, d, "orders").select(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), n), "yyyy-MM-dd").alias("day"), F.col("o_orderkey").alias("ord"), F.concat_ws(" ", "o_orderpriority", "o_orderkey").alias("title"))
    a = articles(spark, d).select(dates.day_key(F.col("published_at")).alias("day"), "ord", "title", "url", "score", F.col("source_type").alias("kind"))
    told = lambda x: F.concat_ws(":", x[0].cast("string"), x[1].cast("string"))
    top = F.array_join(F.transform("top", lambda x: told((x["ord"], x["score"]))), "|")
    kinds = F.array_join(F.transform(F.array_sort(F.map_entries("kinds")), lambda x: told((x["key"], x["value"]))), "|")
    return daily_digest(cards, a).select("day", "n_cards", F.array_join("cards", "|").alias("cards"), top.alias("top"), kinds.alias("kinds"))


@query("s02b_first_envelope", ARTICLES + "SELECT ord, score FROM articles")
def s02b(spark, d):
    path = f"{new_folder(spark, 'snapshots')}/news.json"
    articles(spark, d).select(F.to_json(F.struct(F.array(F.struct("ord", "score")).alias("items")))).write.text(path)
    return payloads.read_first_existing(spark, [f"{path}.missing.json", path, f"{path}.later"], "ord long, score int", lines=True)


@query("f25_lenient_json", "SELECT event_id, json_extract_string(props, '$.k') IS NOT NULL AS has_k, true AS parsed, CASE WHEN event_id % 5 IN (3, 4) THEN 2 ELSE NULL END::INT AS n FROM events")
def f25(spark, d):
    e, k = table(spark, d, "events"), F.col("event_id") % 5
    fenced, inline = F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```")), F.concat(F.lit("Here "), "props", F.lit(" it is"))
    listed = F.concat(F.lit("So: ["), "props", F.lit(","), "props", F.lit("] done"))
    broken = F.concat(F.lit("["), "props", F.lit(", "), "props", F.lit(', {"k": "a } b", "l'))
    out = payloads.lenient_object(F.when(k == 0, fenced).when(k == 1, inline).when(k == 2, F.col("props")).when(k == 3, listed).otherwise(broken))
    has = F.coalesce(F.get_json_object(out, "$.k"), F.get_json_object(out, "$[0].k")).isNotNull()
    return e.select("event_id", has.alias("has_k"), out.isNotNull().alias("parsed"), F.json_array_length(out).alias("n"))


@query("u06_history_formats", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END::INT AS n_cards, CASE WHEN doc_id % 2 = 0 THEN lang END AS summary FROM documents")
def u06(spark, d):
    card = '{"tag":"a","title":"b","body":"c","action":"d"}'
    i = F.col("doc_id")
    raw = F.when(i % 2 == 0, F.concat(F.lit('{"summary":"'), "lang", F.lit(f'","cards":[{card},{card}]}}'))).otherwise(F.lit(f"[{card}]"))
    h = payloads.history_entry(raw)
    return table(spark, d, "documents").select("doc_id", h.alias("h")).select("doc_id", F.size("h.cards").alias("n_cards"), "h.summary")


# ------------------------------------------------------------ streams over the stored tables


@query("t02_stream_dedup", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, ts::DATE AS day FROM events) GROUP BY ALL")
def t02(spark, d):
    e = streams.read_stream(spark, f"{d}/events.parquet")
    e = e.withColumn("key", F.concat_ws("|", "user_id", "event_type", F.to_date("ts")))
    return streams.run_to_table(streams.stream_dedup(e, "ts", ["key"], "400 days"), "append").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("t04_stream_source_daily", "SELECT event_type AS source, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS day, count(*) AS fetched FROM events GROUP BY ALL")
def t04(spark, d):
    e = streams.read_stream(spark, f"{d}/events.parquet").withColumn("source", F.col("event_type"))
    out = streams.run_to_table(streams.stream_source_daily(e, "ts", "source"), "update", ["source", "day"])
    return out.select("source", "day", "fetched")


@query("t05_stream_trend", "SELECT event_type AS source, strftime(s, '%Y-%m-%d') AS start, count(*) AS n FROM (SELECT event_type, unnest(list_transform(range(7), lambda i: ts::DATE - i::INT)) AS s FROM events) GROUP BY ALL")
def t05(spark, d):
    e = streams.read_stream(spark, f"{d}/events.parquet").withColumn("source", F.col("event_type"))
    out = streams.run_to_table(streams.stream_trend(e, "ts", "source"), "update", ["source", "start"])
    return out.select("source", F.date_format("start", "yyyy-MM-dd").alias("start"), "n")


@query("t07_stream_quota", "SELECT user_id AS ip, strftime(ts, '%Y-%m-%d') AS day, least(count(*), 5) AS admitted FROM events GROUP BY ALL")
def t07(spark, d):
    e = streams.read_stream(spark, f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("ip"), "ts")
    out = streams.run_to_table(streams.stream_quota(e, 5), "append", store=streams.STATE_STORE)
    return out.groupBy(F.col("ip").cast("bigint").alias("ip"), "day").agg(F.sum("admitted").cast("bigint").alias("admitted"))


@query("t03_stream_merge", ARTICLES + "SELECT url, max(ord) AS ord FROM articles GROUP BY url")
def t03(spark, d):
    return streams.stream_merge_last(spark, f"{d}/documents.parquet", lambda docs: docs.select(F.concat(F.lit("https://"), "source", F.lit(".example/"), F.col("doc_id") % 9973).alias("url"), F.col("doc_id").alias("ord")), ["url"], -F.col("ord"))


@query("t01_stream_read", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def t01(spark, d):
    docs = streams.read_stream(spark, f"{d}/documents.parquet").select("doc_id", "lang")
    return streams.run_to_table(docs, "append").groupBy("lang").agg(F.count("*").alias("n"))


@query("t03b_stream_merge_articles", article_queries.SQL["j01_merge_articles"])
def t03b(spark, d):
    prev, _ = article_queries._split(spark, d)
    arrived = shape_articles(streams.read_stream(spark, f"{d}/documents.parquet")).where(~F.col("lang").eqNullSafe("fr"))
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm").alias(c)
    return streams.stream_merge_articles(arrived, history.first_per_key(prev, ["url"], F.col("ord")), run_ts()).select("url", "ord", show("published_at"), "date_unknown", show("first_seen"), "is_new")


@query("t06_late_corrections", ARTICLES + """, b AS (SELECT url, arg_min(published_at, ord) - INTERVAL 3 DAY AS moved FROM articles WHERE lang = 'en' AND NOT date_unknown GROUP BY url),
j AS (SELECT ord, date_unknown, published_at, moved, moved IS NOT NULL AND (date_unknown OR abs(epoch(published_at) - epoch(first_seen)) < 120) AS corrected FROM articles LEFT JOIN b USING (url))
SELECT ord, corrected, strftime(CASE WHEN corrected THEN moved ELSE published_at END, '%Y-%m-%d %H:%M') AS published, date_unknown AND NOT corrected AS date_unknown FROM j""")
def t06(spark, d):
    late = shape_articles(streams.read_stream(spark, f"{d}/documents.parquet")).where("lang = 'en'").withColumn("published_at", F.col("published_at") - F.expr("interval 3 days")).select("ord", "url", "published_at", "date_unknown")
    out = streams.stream_late_corrections(late, articles(spark, d))
    return out.select("ord", "corrected", F.date_format("published_at", "yyyy-MM-dd HH:mm").alias("published"), "date_unknown")

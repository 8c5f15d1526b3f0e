"""Landed payloads as tables: feeds, sitemaps, pages, search results, scholarly works, bookmarks, model responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newswell.functions.dates import parse_date
from newswell.functions.text import clean_text, normalize_url, rebuild_abstract, strip, truncate, unescape
from newswell.storage import exists

ARTICLE = "title string, url string, source string, source_type string, lang string, summary string, date_raw string, published_at timestamp, date_unknown boolean, categories array<string>, score int"


def read_envelope(spark: SparkSession, path: str, schema: str, items: str = "items", lines: bool = False) -> DataFrame:
    """Rows of JSON envelopes ``{..., items: [...]}``, one a file or one a line; an empty table where nothing is stored."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{items} array<struct<{schema}>>").option("multiLine", not lines).json(path).select(F.inline(items))


def read_first_existing(spark: SparkSession, paths: list[str], schema: str, lines: bool = False) -> DataFrame:
    """The first snapshot that exists, an envelope if its name ends in ``.json`` and Parquet else; an empty table where none does."""
    for p in paths:
        if exists(spark, p):
            return read_envelope(spark, p, schema, lines=lines) if p.endswith(".json") else spark.read.schema(schema).parquet(p)
    return spark.createDataFrame([], schema)


def normalise_feed(entries: DataFrame, source: Column, source_type: Column, lang: Column, run_ts: Column) -> DataFrame:
    """Feed entries as articles. Entries without title or link are dropped; a missing date is the run's, and marked. What is empty counts as missing.

    Papers take ``updated`` before ``published`` and a longer abstract.
    """
    for c in ("title", "link", "summary", "description", "content", "published", "pubDate", "updated", "date"):
        if c not in entries.columns:
            entries = entries.withColumn(c, F.lit(None).cast("string"))
    paper = source_type == "arxiv"
    first = lambda *names: F.coalesce(*(F.nullif(F.trim(n), F.lit("")) for n in names))  # noqa: E731  (what is empty is not there)
    raw = F.when(paper, first("updated", "published", "pubDate", "date")).otherwise(first("published", "pubDate", "updated", "date"))
    text = clean_text(F.coalesce(first("summary", "description", "content"), F.lit("")))
    at = parse_date(raw, lang)
    out = entries.select(clean_text(F.col("title")).alias("title"), normalize_url(F.trim("link")).alias("url"), source.alias("source"), source_type.alias("source_type"), lang.alias("lang"), F.when(paper, truncate(text, 1800)).otherwise(truncate(text, 400)).alias("summary"), F.coalesce(raw, F.date_format(run_ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).alias("date_raw"), F.coalesce(at, run_ts).alias("published_at"), at.isNull().alias("date_unknown"))
    return out.where((F.col("title") != "") & (F.col("url") != ""))


def arxiv_meta(link: Column, authors: Column, tags: Column, primary: Column | None = None) -> Column:
    """``struct(authors, arxiv_tags, primary_category, arxiv_id)`` of a paper's entry: ten authors at most, tags of the form ``cs.AI``, the id in its address."""
    named = F.filter(F.transform(authors, lambda a: F.trim(a)), lambda a: a != "")
    subjects = F.filter(tags, lambda t: t.rlike(r"^[a-z\-]+\.[A-Z]{2,}$"))
    found = F.nullif(F.regexp_extract(link, r"arxiv\.org/abs/([0-9.]+)", 1), F.lit(""))
    none = F.array().cast("array<string>")
    return F.struct(F.slice(F.coalesce(named, none), 1, 10).alias("authors"), F.coalesce(subjects, none).alias("arxiv_tags"), (primary if primary is not None else F.lit(None).cast("string")).alias("primary_category"), found.alias("arxiv_id"))


def read_feed(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """Entries of landed RSS (``item``) or Atom (``entry``) files."""
    return spark.read.format("xml").option("rowTag", row_tag).load(path)


_TEXT = "struct<_VALUE:string,_href:string,_rel:string>"
_ENTRY = f"title:string,link:array<{_TEXT}>,guid:string,id:string,summary:string,description:string,content:string,`content:encoded`:string,published:string,pubDate:string,updated:string,`dc:date`:string,author:array<struct<name:string>>,category:array<struct<_VALUE:string,_term:string>>"
_FEED = f"channel struct<item:array<struct<{_ENTRY}>>>, item array<struct<{_ENTRY}>>, entry array<struct<{_ENTRY}>>, _broken string"


def feed_entries(landed: DataFrame) -> DataFrame:
    """``source, n, broken`` and the columns of an entry: entries of landed feed documents (``source, body``), RSS, RDF or Atom.

    Elements of other namespaces count where feeds use them (``dc:date``, ``content:encoded``); of several links that of the page
    is taken: a link's text, else the address of one that is ``alternate`` or of no kind, else the first. A document
    without entries, and one that is not well formed or null, gives one row without title and link, ``n`` null and, if it is
    ``broken``, so marked.
    """
    doc = F.from_xml("body", _FEED, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    none = F.array().cast(f"array<struct<{_ENTRY}>>")
    read = landed.select("source", "body", doc.alias("d"))
    listed = F.concat(*(F.coalesce(F.col(c), none) for c in ("d.channel.item", "d.item", "d.entry")))
    rows = read.select("source", (F.col("body").isNull() | F.col("d").isNull() | F.col("d._broken").isNotNull()).alias("broken"), F.posexplode_outer(listed).alias("n", "e"))
    text = lambda x: F.nullif(F.trim(x["_VALUE"]), F.lit(""))
    link = F.coalesce(
        F.get(F.filter(F.transform("e.link", text), lambda x: x.isNotNull()), F.lit(0)),
        F.get(F.filter("e.link", lambda x: x["_href"].isNotNull() & F.coalesce(x["_rel"] == "alternate", F.lit(True))), F.lit(0))["_href"],
        F.get("e.link", F.lit(0))["_href"],
    )
    date = F.coalesce("e.`dc:date`", "e.pubDate")
    return rows.select("source", "n", "broken", F.col("e.title").alias("title"), link.alias("link"), F.col("e.summary").alias("summary"), F.col("e.description").alias("description"), F.coalesce("e.`content:encoded`", "e.content").alias("content"), F.col("e.published").alias("published"), F.col("e.pubDate").alias("pubDate"), F.col("e.updated").alias("updated"), date.alias("date"), F.transform("e.author", lambda x: x["name"]).alias("authors"), F.transform("e.category", lambda x: F.coalesce(x["_term"], x["_VALUE"])).alias("tags"))


def feed_status(landed: DataFrame, entries: DataFrame) -> DataFrame:
    """``source, status, count``: ``error`` for sources of which a document is broken and nothing came, ``idle`` for those without entries, else ``active``."""
    good = F.col("title").isNotNull() & (F.trim("title") != "") & F.col("link").isNotNull()
    found = entries.groupBy("source").agg(F.count_if(good).alias("count"), F.max("broken").alias("broken"))
    state = F.when(F.col("count") > 0, "active").when(F.coalesce("broken", F.lit(False)), "error").otherwise("idle")
    return landed.select("source").distinct().join(found, "source", "left").select("source", state.alias("status"), F.coalesce("count", F.lit(0)).alias("count"))


def active_sources(catalog: DataFrame) -> DataFrame:
    """The source dimension ``source, url, source_type, lang, categories``: active sources of a catalog, the first of each name, with defaults."""
    from newswell.operators.history import first_per_key

    filled = catalog.where(F.coalesce("active", F.lit(True))).withColumns({"source_type": F.coalesce("source_type", F.lit("rss")), "lang": F.coalesce("lang", F.lit("en"))})
    return first_per_key(filled, ["source"], F.col("ord")).select("source", "url", "source_type", "lang", "categories")


def search_queries(catalog: DataFrame) -> DataFrame:
    """``query, categories``: the different queries of a search catalog (``query, category``) with all their categories."""
    return catalog.where("query <> ''").groupBy(F.trim("query").alias("query")).agg(F.array_sort(F.collect_set("category")).alias("categories"))


def sitemap_pages(urls: DataFrame, part: str, run_ts: Column, days: int = 4, newest: int = 12) -> DataFrame:
    """The newest pages of a sitemap (``loc, lastmod``) whose address holds ``part``."""
    at = parse_date(F.col("lastmod"), F.lit("en"))
    fresh = urls.select(F.rtrim(F.trim("loc"), F.lit("/")).alias("url"), at.alias("published_at")).where(F.contains("url", F.lit(part)) & (F.col("published_at") >= run_ts - F.expr(f"interval {days} days")))
    return fresh.orderBy(F.desc("published_at"), "url").limit(newest)


def raw_title(html: Column) -> Column:
    return F.regexp_extract(html, r"<title>([^<]*)</title>", 1)


def open_graph(pages: DataFrame) -> DataFrame:
    """Adds ``og_title`` and ``og_description`` of pages, attributes in either order, else the title and description tags."""
    def meta(key: str) -> Column:
        a = F.regexp_extract("html", rf"(?is)<meta[^>]+(?:property|name)=[\"']{key}[\"'][^>]*content=[\"']([^\"']*)[\"']", 1)
        b = F.regexp_extract("html", rf"(?is)<meta[^>]+content=[\"']([^\"']*)[\"'][^>]*(?:property|name)=[\"']{key}[\"']", 1)
        return F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))

    title = F.coalesce(meta("og:title"), F.nullif(raw_title(F.col("html")), F.lit("")))
    return pages.withColumn("og_title", strip(unescape(title))).withColumn("og_description", F.substring(strip(unescape(F.coalesce(meta("og:description"), meta("description"), F.lit("")))), 1, 400))


def news_search(items: DataFrame, categories: Column, run_ts: Column, outlet: Column) -> DataFrame:
    """Search results (``title, originallink, link, description, pubDate``) as articles, dated in Seoul time where no zone is given."""
    url = F.coalesce(F.nullif("originallink", F.lit("")), F.col("link"))
    at = parse_date(F.col("pubDate"), F.lit("ko"))
    return items.select(clean_text(F.col("title")).alias("title"), normalize_url(url).alias("url"), outlet.alias("source"), F.lit("naver").alias("source_type"), F.lit("ko").alias("lang"), truncate(clean_text(F.col("description")), 400).alias("summary"), F.col("pubDate").alias("date_raw"), F.coalesce(at, run_ts).alias("published_at"), categories.alias("categories")).where((F.col("title") != "") & (F.col("url") != ""))


def scholarly_works(works: DataFrame, run_ts: Column, days_back: int = 30, boosts=((100, 12), (30, 8), (10, 4))) -> DataFrame:
    """Scholarly works as articles: one row an id (that with most citations, then the first by title and content), dated within ``days_back``, with the boost for citations in ``boost``."""
    day = F.to_date("publication_date")
    url = F.coalesce("open_access.oa_url", "primary_location.landing_page_url", "doi", "id")
    names = F.array_join(F.slice(F.transform("authorships", lambda a: a["author"]["display_name"]), 1, 3), ", ")
    venue = F.coalesce("primary_location.source.display_name", F.lit(""))
    boost = F.lit(0)
    for least, plus in reversed(boosts):
        boost = F.when(F.col("cited_by_count") >= least, plus).otherwise(boost)
    fresh = works.where(day.isNotNull() & (day >= F.date_sub(run_ts, days_back)) & (day <= F.date_add(run_ts, 1)))
    order = F.struct((-F.coalesce("cited_by_count", F.lit(0))).alias("c"), F.coalesce("title", "display_name").alias("t"), F.to_json(F.struct(*works.columns)).alias("r"))
    fresh = fresh.groupBy("id").agg(F.min_by(F.struct(*works.columns), order).alias("w")).select("w.*")
    return fresh.select(clean_text(F.coalesce("title", "display_name")).alias("title"), url.alias("url"), F.concat_ws(" · ", F.nullif(names, F.lit("")), F.nullif(venue, F.lit(""))).alias("source"), F.lit("openalex").alias("source_type"), truncate(F.coalesce(rebuild_abstract(F.col("abstract_inverted_index")), F.lit("")), 1800).alias("summary"), day.cast("timestamp").alias("published_at"), F.col("cited_by_count"), boost.alias("boost"))


def semantic_works(works: DataFrame, boosts=((50, 8), (10, 4))) -> DataFrame:
    """Works of a second index: a date of a year alone is its first day, and marked."""
    url = F.coalesce(F.concat(F.lit("https://arxiv.org/abs/"), "externalIds.ArXiv"), F.col("url"), F.concat(F.lit("https://doi.org/"), "externalIds.DOI"), F.col("paperId"))
    day = F.coalesce(F.to_date("publicationDate"), F.make_date(F.col("year"), F.lit(1), F.lit(1)))
    boost = F.lit(0)
    for least, plus in reversed(boosts):
        boost = F.when(F.col("citationCount") >= least, plus).otherwise(boost)
    return works.select(clean_text(F.col("title")).alias("title"), url.alias("url"), F.lit("semantic_scholar").alias("source_type"), day.cast("timestamp").alias("published_at"), F.col("publicationDate").isNull().alias("date_unknown"), boost.alias("boost"))


def manual_articles(df: DataFrame) -> DataFrame:
    """Hand-kept articles with defaults; they come before all others."""
    return df.select("*").withColumns({"source_type": F.coalesce("source_type", F.lit("rss")), "lang": F.coalesce("lang", F.lit("en")), "date_unknown": F.coalesce("date_unknown", F.lit(False)), "priority": F.lit(0)})


def bookmarks(lines: DataFrame) -> DataFrame:
    """``kind, key, saved_at`` of exported bookmark maps; an old plain ``true`` counts as saved at 1."""
    j = lines.select(F.from_json("value", "items map<string,string>, strategy map<string,string>").alias("j"))
    both = j.select(F.lit("item").alias("kind"), F.explode("j.items").alias("key", "v")).unionByName(j.select(F.lit("card").alias("kind"), F.explode("j.strategy").alias("key", "v")))
    return both.where("v <> 'false'").select("kind", "key", F.coalesce(F.get_json_object("v", "$.savedAt").cast("bigint"), F.lit(1).cast("bigint")).alias("saved_at"))


def _ends(c: Column, opening: str, closing: str) -> Column:
    """``struct(first, last)``: how many characters of a text go up to the first, and the last, place where all brackets are closed. Those in strings don't count."""
    none = F.struct(F.lit(0).alias("i"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("first"), F.lit(0).alias("last"))

    def step(s: Column, x: Column) -> Column:
        plain = ~s["escaped"] & ~s["quoted"]
        closes = plain & x.isin(*closing)
        depth = s["depth"] + F.when(plain & x.isin(*opening), 1).when(closes, -1).otherwise(0)
        end = closes & (depth == 0)
        quoted = F.when(~s["escaped"] & (x == '"'), ~s["quoted"]).otherwise(s["quoted"])
        first = F.when(end & (s["first"] == 0), s["i"] + 1).otherwise(s["first"])
        return F.struct((s["i"] + 1).alias("i"), depth.alias("depth"), quoted.alias("quoted"), (~s["escaped"] & (x == "\\")).alias("escaped"), first.alias("first"), F.when(end, s["i"] + 1).otherwise(s["last"]).alias("last"))

    return F.aggregate(F.split(c, ""), none, step)


def _salvaged(c: Column) -> Column:
    """A list cut off in the middle, up to its last whole object."""
    start = F.locate("[", c)
    rest = F.substring(c, start, F.length(c))
    last = _ends(rest, "{", "}")["last"]
    return F.when((start > 0) & (last > 0), F.concat(F.substring(rest, F.lit(1), last), F.lit("]")))


def lenient_object(c: Column) -> Column:
    """The JSON object or list in a model's answer; null if none parses.

    Tried in turn: a fenced block, or else the whole; the outermost list, if it opens before any object; the
    outermost object; a list that was cut off, up to its last whole object.
    """
    body = F.regexp_replace(F.when(c.rlike(r"(?s)```.*```"), F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)).otherwise(c), r"^\s+|\s+$", "")
    # Spark's parser stops after the first value; what follows it must not be there.
    good = lambda x: F.when(x.rlike(r"^[\[{]") & F.try_parse_json(x).isNotNull() & (_ends(x, "[{", "]}")["first"] == F.length(x)), x)
    listed = F.nullif(F.regexp_extract(body, r"(?s)^[^{\[]*(\[.*\])", 1), F.lit(""))
    single = F.nullif(F.regexp_extract(body, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.coalesce(good(body), good(listed), good(single), good(_salvaged(body)))


_CARD = "array<struct<tag:string,title:string,body:string,action:string>>"


def history_entry(c: Column) -> Column:
    """A stored period, an object with cards or an old plain list of them, as ``struct(summary, cards)``."""
    new = F.from_json(c, f"summary string, cards {_CARD}")
    return F.when(F.startswith(F.trim(c), F.lit("[")), F.struct(F.lit(None).cast("string").alias("summary"), F.from_json(c, _CARD).alias("cards"))).otherwise(F.struct(new["summary"].alias("summary"), new["cards"].alias("cards")))

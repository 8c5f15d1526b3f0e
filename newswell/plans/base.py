"""Adapters from the given tables to the article schema, in Spark and in SQL."""

from __future__ import annotations

import html
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = "2024-01-31 00:00:00"
TYPES = ("rss", "google_news", "arxiv", "openalex", "blog")
KINDS = ("legaltech", "policy", "ai-industry", "papers", "models", "funding", "market")


class Registry:
    """Queries of a module by name, with their SQL where there is one."""

    def __init__(self):
        self.QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.SQL: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def add(f):
            self.QUERIES[name] = f
            if sql:
                self.SQL[name] = sql
            return f

        return add


def run_ts() -> Column:
    return F.lit(RUN).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as articles."""
    return shape_articles(table(spark, sf_dir, "documents"))


def shape_articles(docs: DataFrame) -> DataFrame:
    """The first line of a document is the title, the rest the summary; dates, kinds and annotations follow from the id."""
    i, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", "text", "lang", "source", "n_chars")
    title = F.substring_index(text, "\n", 1)
    d = d.withColumn("title", title).withColumn("published_at", F.expr("timestampadd(HOUR, doc_id % 24, timestampadd(DAY, doc_id % 30, timestamp'2024-01-01 00:00:00'))"))
    return d.select(
        i.alias("ord"),
        F.concat(F.lit("https://"), "source", F.lit(".example/"), i % 9973).alias("url"),
        "title",
        F.expr("substring(coalesce(text, ''), length(title) + 2)").alias("summary"),
        "lang",
        "source",
        _pick(TYPES, i % 5).alias("source_type"),
        "published_at",
        F.concat(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")).alias("date_raw"),
        (i % 17 == 0).alias("date_unknown"),
        F.expr("timestampadd(MINUTE, cast(doc_id % 7 as int), published_at)").alias("first_seen"),
        F.array_distinct(F.array(_pick(KINDS, i % 7), _pick(KINDS, i % 3))).alias("categories"),
        (F.col("n_chars") % 121).cast("int").alias("score"),
        F.when(i % 7 != 0, (i % 11).cast("int")).alias("persona_score"),
        F.array_sort(F.array_distinct(F.filter(F.split(F.lower("title"), " "), lambda w: F.length(w) >= 6))).alias("entities"),
        (i % 3 == 0).alias("llm_enriched"),
        (i % 4).cast("int").alias("related_count"),
    )


#: The same in SQL; queries follow as further tables of the WITH clause.
ARTICLES = """WITH articles AS (
SELECT doc_id AS ord, 'https://' || source || '.example/' || (doc_id % 9973) AS url, title, substring(t, length(title) + 2) AS summary, lang, source,
  ['rss', 'google_news', 'arxiv', 'openalex', 'blog'][doc_id % 5 + 1] AS source_type, published_at, strftime(published_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS date_raw, doc_id % 17 = 0 AS date_unknown,
  published_at + to_minutes(doc_id % 7) AS first_seen,
  CASE WHEN k1 = k2 THEN [k1] ELSE [k1, k2] END AS categories, (n_chars % 121)::INT AS score, CASE WHEN doc_id % 7 <> 0 THEN (doc_id % 11)::INT END AS persona_score,
  list_sort(list_distinct(list_filter(string_split(lower(title), ' '), lambda w: length(w) >= 6))) AS entities, doc_id % 3 = 0 AS llm_enriched, (doc_id % 4)::INT AS related_count
FROM (SELECT *, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10))[1] AS title, TIMESTAMP '2024-01-01' + to_days((doc_id % 30)::INT) + to_hours((doc_id % 24)::INT) AS published_at,
  ['legaltech', 'policy', 'ai-industry', 'papers', 'models', 'funding', 'market'][doc_id % 7 + 1] AS k1, ['legaltech', 'policy', 'ai-industry', 'papers', 'models', 'funding', 'market'][doc_id % 3 + 1] AS k2 FROM documents))
"""

#: White space of Unicode, as a class of a pattern in SQL.
WHITE = "[\\s\\x0B\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def _literal(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _let(value: str, name: str, then: str) -> str:
    return f"list_transform([{value}], lambda {name}: {then})[1]"


def unescaped_sql(x: str) -> str:
    """SQL of ``x`` with HTML character references as characters, by the rules of :func:`newswell.functions.text.unescape`.

    No reference holds an ampersand within, so each part after one is judged alone: a number, a name of the standard's table, or
    the longest name without a semicolon (six characters at most) that opens it.
    """
    names = "MAP {" + ", ".join(f"{_literal(k)}: {_literal(v)}" for k, v in html5.items()) + "}"
    odd = "MAP {" + ", ".join(f"{k}: {_literal(v)}" for k, v in html._invalid_charrefs.items()) + "}"
    dropped = ", ".join(map(str, sorted(html._invalid_codepoints)))
    bounded = lambda digits, most, one: _let(f"ltrim({digits}, '0')", "g", f"CASE WHEN length(g) > {most} THEN 1114112 WHEN g = '' THEN 0 ELSE {one} END")
    number = f"CASE WHEN r[2] IN ('x', 'X') THEN {bounded('rtrim(r[3:], chr(59))', 6, '(chr(48) || chr(120) || g)::INT')} ELSE {bounded('rtrim(r[2:], chr(59))', 7, 'g::INT')} END"
    char = f"CASE WHEN {odd}[n] IS NOT NULL THEN {odd}[n] WHEN n > 1114111 OR n BETWEEN 55296 AND 57343 THEN chr(65533) WHEN n IN ({dropped}) THEN '' ELSE chr(n) END"
    opened = ", ".join(f"{names}[left(r, {k})] || substring(r, {k + 1})" for k in (6, 5, 4, 3, 2))
    common = "CASE r WHEN 'amp;' THEN '&' WHEN 'lt;' THEN '<' WHEN 'gt;' THEN '>' WHEN 'quot;' THEN '\"' WHEN 'copy;' THEN '©' WHEN 'middot;' THEN '·'"  # of the table too
    char_of = f"CASE WHEN r = '' THEN '&' WHEN starts_with(r, '#') THEN {_let(number, 'n', char)} ELSE {common} ELSE coalesce({names}[r], {opened}, '&' || r) END END"
    part = _let(r"regexp_extract(p, '^(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)')", "r", f"({char_of}) || substring(p, length(r) + 1)")
    return _let(f"string_split({x}, '&')", "s", f"s[1] || coalesce(array_to_string(list_transform(s[2:], lambda p: {part}), ''), '')")


def clean_sql(x: str) -> str:
    """SQL of :func:`newswell.functions.text.clean_text`."""
    return f"trim(regexp_replace(regexp_replace({unescaped_sql(x)}, '<[^>]+>', ' ', 'g'), '{WHITE}+', ' ', 'g'), ' ')"


def stripped_sql(x: str) -> str:
    """SQL of :func:`newswell.functions.text.strip`."""
    return f"regexp_replace({x}, '^{WHITE}+|{WHITE}+$', '', 'g')"

"""Queries of the scalar functions (F, D, M) over documents, pages, orders and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from newswell.functions import dates, text
from newswell.functions.lexicon import DEMO, Lexicon
from newswell.functions.terms import term_hits
from newswell.operators import classify
from newswell.operators.reports import joined_head
from newswell.plans.base import ARTICLES, Registry, articles, clean_sql, run_ts, table, unescaped_sql
from newswell.storage import stored

_R = Registry()
QUERIES, SQL, query = _R.QUERIES, _R.SQL, _R.query

@query("f01_clean_text", f"SELECT page_id, {clean_sql('html')} AS clean FROM pages")
def f01(spark, d):
    return table(spark, d, "pages").select("page_id", text.clean_text(F.col("html")).alias("clean"))


@query("f02_truncate", "SELECT doc_id, CASE WHEN length(text) <= 120 THEN text ELSE regexp_replace(substring(text, 1, 120), ' [^ ]*$', '') || '…' END AS short FROM documents")
def f02(spark, d):
    return table(spark, d, "documents").select("doc_id", text.truncate(F.col("text"), 120).alias("short"))


@query("f03_unescape", f"SELECT page_id, md5({unescaped_sql('html')}) AS plain FROM pages")
def f03(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(text.unescape(F.col("html"))).alias("plain"))


def matched_sql(x: str) -> str:
    """SQL of a text as terms are looked for in it."""
    marks = text.MARKS.replace("'", "''")
    return f"lower(regexp_replace(regexp_replace({x}, '[{marks}]+', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("f04_match_normalise", ARTICLES + f"SELECT ord, {matched_sql('title')} AS norm FROM articles")
def f04(spark, d):
    return articles(spark, d).select("ord", text.match_normalise(F.col("title")).alias("norm"))


@query("f05_normalize_url", "SELECT page_id, regexp_replace(regexp_replace(url, '[?&](utm_[^=]+|fbclid|gclid|mc_cid|mc_eid)=[^&]*', '', 'g'), '\\?$', '') AS url FROM (SELECT page_id, url || CASE page_id % 4 WHEN 0 THEN '?utm_source=a&x=1#top' WHEN 1 THEN '?fbclid=9' WHEN 2 THEN '?utm_&y=2&gclid=z#k' ELSE '?q=1' END AS url FROM pages)")
def f05(spark, d):
    k = F.col("page_id") % 4
    more = F.when(k == 0, "?utm_source=a&x=1#top").when(k == 1, "?fbclid=9").when(k == 2, "?utm_&y=2&gclid=z#k").otherwise("?q=1")
    return table(spark, d, "pages").select("page_id", text.normalize_url(F.concat("url", more)).alias("url"))


_TOK = "list_filter(string_split(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+', ' ', 'g'), ' '), lambda w: length(w) > 1)"


@query("f06_tokenize", ARTICLES + f"SELECT ord, array_to_string(list_sort(list_distinct({_TOK.format('title')})), ' ') AS tokens FROM articles")
def f06(spark, d):
    return articles(spark, d).select("ord", F.array_join(F.array_sort(text.tokens(F.col("title"))), " ").alias("tokens"))


@query("f08_head_token", ARTICLES + "SELECT ord, CASE WHEN length(trim(regexp_extract(title, '^([^,:\\[\\]()·…]*)', 1))) >= 3 THEN lower(trim(regexp_extract(title, '^([^,:\\[\\]()·…]*)', 1))) ELSE '' END AS head FROM articles")
def f08(spark, d):
    return articles(spark, d).select("ord", text.head_token(F.col("title")).alias("head"))


_TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


@query("f07_strip_particle", ARTICLES + ", w AS (SELECT ord, split_part(title, ' ', 1) || ['로', '은', '는', '이', '가', '의', '을', '를', '에', '에서', '도', '와', '과', '랑', ''][ord % 15 + 1] AS w FROM articles), p AS (SELECT *, list_filter(['로', '은', '는', '이', '가', '의', '을', '를', '에', '에서', '도', '와', '과', '랑'], lambda p: ends_with(w, p) AND length(w) > length(p) + 1)[1] AS p FROM w) SELECT ord, CASE WHEN p IS NULL THEN w ELSE left(w, length(w) - length(p)) END AS word FROM p")
def f07(spark, d):
    endings = F.array(*map(F.lit, (*text.PARTICLES, "")))
    word = F.concat(F.substring_index("title", " ", 1), F.element_at(endings, (F.col("ord") % 15 + 1).cast("int")))
    return articles(spark, d).select("ord", text.strip_particle(word).alias("word"))


@query("f09_strip_phrases", ARTICLES + "SELECT ord, " + _TRIM.format("regexp_replace(regexp_replace(regexp_replace(regexp_replace(c, '(?i)\\bof the\\b', '', 'g'), '(?i)\\bto be\\b', '', 'g'), '[ \\t]{2,}', ' ', 'g'), '[ \\t]+([.,!?])', '\\1', 'g')") + " AS body FROM (SELECT ord, replace(title, ' ', CASE ord % 3 WHEN 0 THEN ' ' WHEN 1 THEN ' of the ' ELSE chr(9) || ' to be !' END) || ' !' || chr(10) AS c FROM articles)")
def f09(spark, d):
    between = F.when(F.col("ord") % 3 == 0, " ").when(F.col("ord") % 3 == 1, " of the ").otherwise("\t to be !")
    body = F.concat(F.replace("title", F.lit(" "), between), F.lit(" !\n"))
    return articles(spark, d).select("ord", text.strip_phrases(body, [r"\bof the\b", r"\bto be\b"]).alias("body"))


_CARD = "regexp_replace(title, '^(\\S+) (\\S+)', '**\\1** **the \\2 word**')"
_UNBOLD = "regexp_replace(regexp_replace({0}, '\\*\\*([^*\\n]{{0,40}}?thinger[^*\\n]{{0,15}}?)\\*\\*', '\\1', 'g'), '\\*\\*([^*\\n]{{1,6}})\\*\\*', '\\1', 'g')"


def card_text():
    """A title with two bold spans, of which every third holds a name."""
    return F.regexp_replace(F.when(F.col("ord") % 3 == 0, F.regexp_replace("title", r"^(\S+) (\S+)", "$1 thinger")).otherwise(F.col("title")), r"^(\S+) (\S+)", "**$1** **the $2 word**")


CARD_SQL = _CARD.replace("title", "CASE WHEN ord % 3 = 0 THEN regexp_replace(title, '^(\\S+) (\\S+)', '\\1 thinger') ELSE title END")


@query("f10_unbold", ARTICLES + f"SELECT ord, {_UNBOLD.format(CARD_SQL)} AS body FROM articles")
def f10(spark, d):
    return articles(spark, d).select("ord", text.unbold(card_text(), ("thinger",)).alias("body"))


def emphasise_sql(c: str, frm: str) -> str:
    """SQL of ord and body from rows of ord and text ``c``."""
    return f""", e0 AS (SELECT ord, {c} AS c, {_TRIM.format(c)} AS w FROM {frm}), e1 AS (SELECT *, rtrim(w, '.!? ') AS b FROM e0), e2 AS (SELECT *, regexp_extract(b, '(?s)^(.*[.!?] )', 1) AS h, substring(w, length(b) + 1) AS tail FROM e1),
e3 AS (SELECT *, CASE WHEN h = '' THEN b ELSE {_TRIM.format('substring(b, length(h) + 1)')} END AS l FROM e2)
SELECT ord, CASE WHEN contains(c, '**') THEN c WHEN (h = '' AND length(l) BETWEEN 10 AND 150) OR (h <> '' AND length(l) BETWEEN 1 AND 150) THEN h || '**' || l || '**' || tail ELSE w END AS body FROM e3"""


@query("f11_emphasise_last", ARTICLES + ", t AS (SELECT ord, title || CASE ord % 3 WHEN 0 THEN '. Version 3.1 is out!' WHEN 1 THEN '' ELSE '? ' END AS t FROM articles)" + emphasise_sql("t", "t"))
def f11(spark, d):
    more = F.when(F.col("ord") % 3 == 0, ". Version 3.1 is out!").when(F.col("ord") % 3 == 1, "").otherwise("? ")
    return articles(spark, d).select("ord", text.emphasise_last(F.concat("title", more)).alias("body"))


@query("f12_number_breaks", ARTICLES + "SELECT ord, regexp_replace(title || ' 1) ' || lang || '. 2) ' || source || ' (3) x 4)y 3.5) z 6) w', '([^\\n.(\\d])\\s+([1-9]\\)\\s)', '\\1' || chr(10) || chr(10) || '\\2', 'g') AS body FROM articles")
def f12(spark, d):
    body = F.concat("title", F.lit(" 1) "), "lang", F.lit(". 2) "), "source", F.lit(" (3) x 4)y 3.5) z 6) w"))
    return articles(spark, d).select("ord", text.number_breaks(body).alias("body"))


@query("f15_arxiv_id", "SELECT doc_id, nullif(regexp_extract('http://arxiv.org/' || ['abs', 'pdf', 'list'][doc_id % 3 + 1] || '/' || (2000 + doc_id % 400) || '.' || lpad((doc_id % 100000)::VARCHAR, 3 + (doc_id % 4)::INT, '0') || 'v1', 'arxiv\\.org/(?:abs|pdf)/([0-9]{4}\\.[0-9]{4,5})', 1), '') AS arxiv FROM documents")
def f15(spark, d):
    i = F.col("doc_id")
    part = F.element_at(F.array(*map(F.lit, ("abs", "pdf", "list"))), (i % 3 + 1).cast("int"))
    number = F.lpad((i % 100000).cast("string"), (3 + i % 4).cast("int"), F.lit("0"))
    return table(spark, d, "documents").select("doc_id", text.arxiv_id(F.concat(F.lit("http://arxiv.org/"), part, F.lit("/"), 2000 + i % 400, F.lit("."), number, F.lit("v1"))).alias("arxiv"))


_HOST = "regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '^(www|m)\\.', '')"


@query("f16_outlet", f"SELECT page_id, CASE WHEN contains({_HOST}, 'thth') THEN 'Thth Daily' WHEN contains({_HOST}, 'example.net') THEN 'Example Net' ELSE 'Naver / ' || regexp_extract({_HOST}, '^([^.]+)', 1) END AS outlet FROM pages")
def f16(spark, d):
    return table(spark, d, "pages").select("page_id", text.outlet(F.col("url"), {"thth": "Thth Daily", "example.net": "Example Net"}).alias("outlet"))


@query("f17_rebuild_abstract", "SELECT doc_id, array_to_string(string_split(text, ' '), ' ') AS abstract FROM documents")
def f17(spark, d):
    index = table(spark, d, "documents").select("doc_id", text.inverted(F.split("text", " ")).alias("m"))
    return index.select("doc_id", text.rebuild_abstract(F.col("m")).alias("abstract"))


@query("f18_jaccard", ARTICLES + f", t AS (SELECT ord, list_distinct({_TOK.format('title')}) AS a, list_distinct({_TOK.format('summary')}) AS b FROM articles) SELECT ord, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0 END, 9) AS j FROM t")
def f18(spark, d):
    return articles(spark, d).select("ord", F.round(text.jaccard(text.tokens(F.col("title")), text.tokens(F.col("summary"))), 9).alias("j"))


@query("f20_noun_overlap", ARTICLES + "SELECT ord, len(list_filter(['inger', 'ation', 'leaux'], lambda k: contains(lower(title), k) AND contains(lower(summary), k)))::INT AS n FROM articles")
def f20(spark, d):
    nouns = F.array(*map(F.lit, ("inger", "ation", "leaux")))
    found = lambda c: text.bind(F.lower(c), lambda x: F.filter(nouns, lambda n: F.contains(x, n)))
    return articles(spark, d).select("ord", F.size(F.array_intersect(found("title"), found("summary"))).alias("n"))


@query("f23_law_terms", ARTICLES + ", t AS (SELECT ord, lower(title || ' ' || summary) AS x FROM articles) SELECT ord, contains(x, 'rerely') OR contains(x, 'license') AS core, contains(x, 'general public') AS basic, contains(x, 'license') OR contains(x, 'inthe') AS conditional, contains(x, 'apache license') OR contains(x, 'heedth') AS boosted FROM t")
def f23(spark, d):
    t = classify.text_terms(F.col("title"), F.col("summary"), DEMO)
    return articles(spark, d).select("ord", *((t[k]["hits"] > 0).alias(a) for k, a in (("core_law", "core"), ("basic_law", "basic"), ("conditional_law", "conditional"), ("super", "boosted"))))


@query("f24_occurrence_sum", "SELECT doc_id, (list_sum(list_transform([' the ', 'the ', ' the', 'ation'], lambda t: (length(lower(text)) - length(replace(lower(text), t, ''))) // length(t))))::INT AS n FROM documents")
def f24(spark, d):
    return table(spark, d, "documents").select("doc_id", text.occurrence_sum(F.lower("text"), (" the ", "the ", " the", "ation")).alias("n"))


@query("a03_hit_count", "SELECT doc_id, len(list_filter(['the', 'ation', 'leaux', 'ingly', 'zzz', 'erst', 'the'], lambda t: contains(lower(text), t)))::INT AS n FROM documents")
def a03(spark, d):
    hits = term_hits(F.lower("text"), {"x": ("the", "ation", "leaux", "ingly", "zzz", "erst", "the")})
    return table(spark, d, "documents").select("doc_id", F.when(F.col("text").isNotNull(), hits["x"]["hits"]).alias("n"))


#: Terms of three lists that are made of the corpus itself: its most frequent words, in the order of their number.
_SIZES = {"blacklist": 586, "negative": 190, "score_legal": 83}


def _bounds():
    low = 0
    for name, n in _SIZES.items():
        yield name, low + 1, low + n
        low += n


@query("a03t_hits_of_long_lists", "WITH w AS (SELECT w, row_number() OVER (ORDER BY n DESC, w) AS r FROM (SELECT w, count(*) AS n FROM (SELECT unnest(string_split(lower(text), ' ')) AS w FROM documents) WHERE length(w) >= 4 GROUP BY w) QUALIFY r <= 859) SELECT doc_id, " + ", ".join(f"coalesce(count_if(r BETWEEN {a} AND {b}), 0)::INT AS {n}" for n, a, b in _bounds()) + ", coalesce(sum(CASE WHEN r > 776 THEN (length(lower(text)) - length(replace(lower(text), w, ''))) // length(w) END), 0)::INT AS total FROM documents LEFT JOIN w ON contains(lower(text), w) GROUP BY doc_id")
def a03t(spark, d):
    docs = table(spark, d, "documents")
    words = docs.select(F.explode(F.split(F.lower("text"), " ")).alias("term")).where(F.length("term") >= 4).groupBy("term").agg(F.count("*").alias("n"))
    top = words.orderBy(F.desc("n"), "term").limit(sum(_SIZES.values())).withColumn("ord", F.row_number().over(Window.orderBy(F.desc("n"), "term")))
    name = F.lit(None).cast("string")
    for n, a, b in _bounds():
        name = F.when(F.col("ord").between(a, b), n).otherwise(name)
    lex = Lexicon.from_table(stored(top.select(name.alias("list_name"), "term", F.lit(None).cast("double").alias("weight"), "ord"), "lexicon"))
    hits = docs.select("doc_id", term_hits(F.lower("text"), lex.lists, totals=("score_legal",)).alias("t"))
    return hits.select("doc_id", *(F.col(f"t.{n}.hits").alias(n) for n in _SIZES), F.col("t.score_legal.total").alias("total"))


@query("f26_card_key", ARTICLES + "SELECT ord, 'daily|' || strftime(published_at, '%Y-%m-%d') || '|' || substring(title, 1, 80) AS k FROM articles")
def f26(spark, d):
    return articles(spark, d).select("ord", text.card_key(F.lit("daily"), dates.day_key(F.col("published_at")), F.col("title")).alias("k"))


@query("f27_compact_key", "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS day, strftime(o_orderdate, '%GW%V') AS week, strftime(o_orderdate, '%G-W%V') AS wide FROM orders")
def f27(spark, d):
    t = F.col("o_orderdate")
    week = text.compact_key(dates.week_key(t))
    return table(spark, d, "orders").select("o_orderkey", text.compact_key(dates.day_key(t)).alias("day"), week.alias("week"), text.expanded_key(week).alias("wide"))


@query("f28_projection", "SELECT conv_id, array_to_string(list(role || ':' || length(text) ORDER BY turn)[1:3], ',') AS head FROM conversations GROUP BY conv_id")
def f28(spark, d):
    return joined_head(table(spark, d, "conversations"), "conv_id", 3, "turn", F.concat("role", F.lit(":"), F.length("text")), ",")


@query("d01_parse_date", "SELECT o_orderkey, strftime(CASE o_orderkey % 3 WHEN 0 THEN o_orderdate WHEN 1 THEN o_orderdate WHEN 2 THEN o_orderdate - INTERVAL 9 HOUR END, '%Y-%m-%d %H:%M:%S') AS at FROM orders")
def d01(spark, d):
    t, k = F.col("o_orderdate"), F.col("o_orderkey") % 3
    raw = F.when(k == 0, F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).when(k == 1, F.concat(F.date_format(t, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))).otherwise(F.date_format(t, "yyyy-MM-dd HH:mm:ss"))
    return table(spark, d, "orders").select("o_orderkey", F.date_format(dates.parse_date(raw, F.when(k == 2, "ko").otherwise("en")), "yyyy-MM-dd HH:mm:ss").alias("at"))


_FORMS = ("EEE, d MMM yyyy H:mm:ss", "d MMMM yyyy HH:mm", "MMM d, yyyy h:mm a", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm", "yyyyMMdd'T'HHmmss", "MM/dd/yyyy HH:mm:ss", "EEE MMM d HH:mm:ss yyyy")
_ZONES = ("", "Z", " +0900", "-03:30", " GMT")


@query("d01b_date_forms", f"SELECT o_orderkey, strftime(CASE WHEN o_orderkey % 8 IN (1, 2, 4) THEN date_trunc('minute', t) ELSE t END - to_minutes(CASE WHEN o_orderkey % 8 IN (5, 6, 7) THEN 540 ELSE [540, 0, 540, -210, 0][o_orderkey % 5 + 1] END), '%Y-%m-%d %H:%M:%S') AS at FROM (SELECT *, o_orderdate + to_seconds(o_orderkey % 86400) AS t FROM orders)")
def d01b(spark, d):
    t, k = F.timestamp_add("SECOND", F.col("o_orderkey") % 86400, F.col("o_orderdate").cast("timestamp")), F.col("o_orderkey") % 8
    raw = F.date_format(t, _FORMS[0])
    for n, form in enumerate(_FORMS[1:], 1):
        raw = F.when(k == n, F.date_format(t, form)).otherwise(raw)
    zone = F.element_at(F.array(*map(F.lit, _ZONES)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    raw = F.concat(raw, F.when(k.isin(5, 6, 7), "").otherwise(zone))
    return table(spark, d, "orders").select("o_orderkey", F.date_format(dates.parse_date(raw, F.lit("ko")), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("d02_seoul_date", "SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS day FROM events")
def d02(spark, d):
    return table(spark, d, "events").select("event_id", dates.day_key(dates.seoul_date(F.col("ts"))).alias("day"))


@query("d03_period_keys", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%G-W%V') AS week, strftime(o_orderdate, '%Y-%m') AS month, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS monday FROM orders")
def d03(spark, d):
    t = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", dates.day_key(t).alias("day"), dates.week_key(t).alias("week"), dates.month_key(t).alias("month"), dates.day_key(F.date_trunc("week", t)).alias("monday"))


@query("d03b_period_table", "SELECT event_type, period, key, count(*) AS n FROM (SELECT event_type, unnest([{'period': 'daily', 'key': strftime(ts, '%Y-%m-%d')}, {'period': 'weekly', 'key': strftime(ts, '%G-W%V')}, {'period': 'monthly', 'key': strftime(ts, '%Y-%m')}], recursive := true) FROM events) GROUP BY ALL")
def d03b(spark, d):
    return dates.fan_out(table(spark, d, "events"), "ts").groupBy("event_type", "period", "key").agg(F.count("*").alias("n"))


@query("d04_backfill_offset", ARTICLES + "SELECT ord, CASE WHEN lang = 'fr' AND NOT date_unknown THEN regexp_replace(date_raw, '(\\+00:00|Z)$', '+09:00') ELSE date_raw END AS date_raw FROM articles")
def d04(spark, d):
    return articles(spark, d).select("ord", dates.backfill_offset(F.col("date_raw"), F.when(F.col("lang") == "fr", "ko"), F.col("date_unknown")).alias("date_raw"))


@query("d05_recency_boost", ARTICLES + ", h AS (SELECT ord, (epoch(TIMESTAMP '2024-01-31') - epoch(published_at)) / 3600 AS h FROM articles) SELECT ord, (CASE WHEN h < 24 THEN 10 WHEN h < 72 THEN 5 WHEN h < 168 THEN 2 ELSE 0 END)::INT AS boost FROM h")
def d05(spark, d):
    return articles(spark, d).select("ord", dates.recency_boost(F.col("published_at"), run_ts()).alias("boost"))


@query("d06_day_number", "SELECT event_id, datediff('day', DATE '1970-01-01', ts::DATE)::INT AS n FROM events")
def d06(spark, d):
    return table(spark, d, "events").select("event_id", dates.day_number(F.col("ts")).alias("n"))


@query("m01_strength", "SELECT doc_id, CASE WHEN n_chars % 9 = 0 THEN 0.0 ELSE round(1 - pow(0.78, n_chars % 9), 3) END::DOUBLE AS s FROM documents")
def m01(spark, d):
    return table(spark, d, "documents").select("doc_id", dates.strength((F.col("n_chars") % 9).cast("int")).alias("s"))


@query("m02_depth_bonus", "SELECT doc_id, round(CASE WHEN n_chars >= 80 THEN least(6.0, log2(n_chars / 40) * 1.2) ELSE -3.0 END, 6)::DOUBLE AS bonus FROM documents")
def m02(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(dates.depth_bonus(F.col("n_chars")), 6).alias("bonus"))


@query("m03_clamp_score", "SELECT event_id, greatest(0, least(120, round_even(value, 0)))::INT AS score FROM events")
def m03(spark, d):
    return table(spark, d, "events").select("event_id", dates.clamp_score(F.col("value")).alias("score"))


@query("w14_latest_key", "SELECT o_orderpriority, max(strftime(o_orderdate, '%G-W%V')) AS latest FROM orders GROUP BY ALL")
def w14(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.max(dates.week_key(F.col("o_orderdate"))).alias("latest"))

"""Queries of entities, relations, their graph, periods' citations and papers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from newswell.functions import dates
from newswell.functions.lexicon import RELATIONS, SYMMETRIC
from newswell.operators import graph, history, reports
from newswell.plans.base import ARTICLES, Registry, articles, table

_R = Registry()
QUERIES, SQL, query = _R.QUERIES, _R.SQL, _R.query

#: A catalog of words of the sample texts: entity, type, aliases.
CATALOG = (
    ("inger", "company", ("inger", "ingers")),
    ("ation", "agency", ("ation", "ationed")),
    ("leaux", "company", ("leaux",)),
    ("ment", "product", ("ment", "menten")),
    ("erst", "product", ("erst", "thst")),
    ("rag", "tech", ("rag",)),
    ("the", "policy", ("the", "les", "der")),
)
_ENTITIES = [(e, a) for e, _, a in CATALOG]
_ROWS = ", ".join(f"('{e}', '{t}', '{x}', {k})" for k, (e, t, x) in enumerate((e, t, x) for e, t, a in CATALOG for x in a))
_MENTIONS = ARTICLES + f""", catalog(entity_id, type, alias, ord) AS (VALUES {_ROWS}), docs AS (SELECT ord, score, strftime(published_at, '%Y-%m-%d') AS day, lower(concat_ws(' ', title, summary)) AS x FROM articles),
hits AS (SELECT docs.ord, score, day, entity_id, type, alias FROM docs JOIN catalog ON regexp_matches(x, '(^|[^a-z])' || alias || '($|[^a-z])')), mentions AS (SELECT DISTINCT ord, score, day, entity_id, type FROM hits)
"""


def _catalog(spark):
    rows = [(e, t, x) for e, t, a in CATALOG for x in a]
    return spark.createDataFrame([(e, t, x, k) for k, (e, t, x) in enumerate(rows)], "entity_id string, type string, alias string, ord int")


def _docs(spark, d):
    return articles(spark, d).withColumn("day", dates.day_key(F.col("published_at")))


def _mentions(spark, d):
    return graph.entity_mentions(_docs(spark, d), _ENTITIES, F.concat_ws(" ", "title", "summary"), "ord", "score", "day")


@query("j12_entity_mentions", _MENTIONS + "SELECT ord, entity_id FROM mentions")
def j12(spark, d):
    return _mentions(spark, d).select("ord", "entity_id")


@query("a05_entity_rollup", _MENTIONS + ", n AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY day DESC, ord) AS r FROM mentions) SELECT entity_id, count(*) AS total_mentions, round_even(avg(score), 1)::DOUBLE AS avg_score, min(day) AS first_seen, max(day) AS last_seen, string_agg(CASE WHEN r <= 30 THEN ord::VARCHAR END, ',' ORDER BY r) AS newest FROM n GROUP BY entity_id")
def a05(spark, d):
    return graph.entity_rollup(_mentions(spark, d)).withColumn("newest", F.array_join(F.transform("newest", lambda x: x.cast("string")), ","))


@query("a06_entity_context", f"WITH catalog(entity_id, type, alias, ord) AS (VALUES {_ROWS}), m AS (SELECT DISTINCT conv_id, turn, entity_id FROM conversations JOIN catalog ON regexp_matches(lower(text), '(^|[^a-z])' || alias || '($|[^a-z])')), r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY conv_id, turn) AS r FROM m) SELECT entity_id, string_agg(conv_id || ':' || turn, ',' ORDER BY r) AS cards FROM r WHERE r <= 20 GROUP BY entity_id")
def a06(spark, d):
    m = graph.entity_mentions(table(spark, d, "conversations"), _ENTITIES, F.col("text"), "conv_id", "turn")
    top = history.top_n_per(m, ["entity_id"], 20, F.col("conv_id"), F.col("turn"))
    place = F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(":", "conv_id", "turn").alias("x"))))
    return top.groupBy("entity_id").agg(F.array_join(F.transform(place, lambda x: x["x"]), ",").alias("cards"))


@query("a07_auto_entities", _MENTIONS + """, e AS (SELECT ord, title, score, unnest(entities) AS name FROM articles), al AS (SELECT ord, list(DISTINCT alias) AS aliases FROM hits GROUP BY ord),
k AS (SELECT e.*, lower(name) AS k FROM e LEFT JOIN al USING (ord) WHERE length(name) BETWEEN 2 AND 60 AND coalesce(len(list_filter(aliases, lambda a: contains(lower(name), a) OR contains(a, lower(name)))), 0) = 0)
SELECT k, arg_min(name, ord) AS name, count(*) AS n, round_even(avg(score), 1)::DOUBLE AS avg_score, array_to_string(list(ord ORDER BY ord)[1:3], ',') AS first FROM k GROUP BY k HAVING count(*) >= 2""")
def a07(spark, d):
    a = _docs(spark, d)
    text = F.lower(F.concat_ws(" ", "title", "summary"))
    aliases = [x for _, _, al in CATALOG for x in al]
    hits = graph.entity_mentions(a, [(x, (x,)) for x in aliases], text, "ord").select("ord", F.col("entity_id").alias("alias"))
    return graph.auto_entities(a.withColumn("title", F.col("ord").cast("string")), hits).withColumn("titles", F.array_join("titles", ",")).withColumnRenamed("titles", "first")


@query("a08_type_counts", _MENTIONS + "SELECT type, count(DISTINCT entity_id) AS n_entities, count(*) AS n_mentions FROM mentions GROUP BY type")
def a08(spark, d):
    return graph.type_counts(_mentions(spark, d), _catalog(spark).select("entity_id", "type").distinct())


@query("a23_effective_mentions", _MENTIONS + ", t AS (SELECT entity_id, type, count_if(source_type NOT IN ('arxiv', 'openalex')) AS n_articles, count_if(source_type NOT IN ('arxiv', 'openalex') AND m.score >= 60) AS n_trends, count_if(source_type IN ('arxiv', 'openalex')) AS n_papers FROM mentions m JOIN articles USING (ord) GROUP BY ALL), n AS (SELECT *, (n_articles + n_trends + n_papers)::BIGINT AS n FROM t) SELECT entity_id, n, (n_articles + n_trends)::BIGINT AS n_without_papers, row_number() OVER (PARTITION BY type ORDER BY n DESC, entity_id) AS place FROM n")
def a23(spark, d):
    kinds = _catalog(spark).select("entity_id", "type").distinct()
    m = graph.entity_mentions(articles(spark, d), _ENTITIES, F.concat_ws(" ", "title", "summary"), "score", "source_type")
    paper = F.col("source_type").isin("arxiv", "openalex")
    r = m.groupBy("entity_id").agg(F.count_if(~paper).alias("n_articles"), F.count_if(~paper & (F.col("score") >= 60)).alias("n_trends"), F.count_if(paper).alias("n_papers")).join(F.broadcast(kinds), "entity_id")
    r = r.withColumn("n", graph.effective_mentions(r)).withColumn("n_without_papers", graph.effective_mentions(r, papers=False))
    return r.withColumn("place", F.row_number().over(Window.partitionBy("type").orderBy(F.desc("n"), "entity_id")).cast("bigint")).select("entity_id", "n", "n_without_papers", "place")


@query("a26_entity_index", ARTICLES + ", e AS (SELECT ord, published_at, unnest(entities) AS name FROM articles), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY published_at DESC, ord) AS r FROM e) SELECT name, count(*) AS n, greatest(count(*) - 30, 0) AS overflow, string_agg(CASE WHEN r <= 30 THEN ord::VARCHAR END, ',' ORDER BY r) AS newest FROM r GROUP BY name")
def a26(spark, d):
    e = articles(spark, d).select("ord", "published_at", F.explode("entities").alias("name"))
    return graph.newest_per_name(e).withColumn("newest", F.array_join(F.transform("newest", lambda x: x.cast("string")), ","))


@query("j13_resolve_names", ARTICLES + f""", catalog(entity_id, type, alias, ord) AS (VALUES {_ROWS}), names AS (SELECT ord, entities[1] AS name FROM articles WHERE len(entities) > 0),
x AS (SELECT DISTINCT lower(name) AS k FROM names), ex AS (SELECT k, arg_min(entity_id, ord) AS e FROM x JOIN catalog ON alias = k GROUP BY k), ne AS (SELECT k, arg_min(entity_id, ord) AS e FROM x JOIN catalog ON length(alias) >= 3 AND (contains(alias, k) OR contains(k, alias)) WHERE k NOT IN (SELECT k FROM ex) GROUP BY k)
SELECT names.ord, name, coalesce(ex.e, ne.e) AS entity_id FROM names LEFT JOIN ex ON ex.k = lower(name) LEFT JOIN ne ON ne.k = lower(name)""")
def j13(spark, d):
    names = articles(spark, d).where("size(entities) > 0").select("ord", F.get("entities", F.lit(0)).alias("name"))
    return graph.resolve_names(names, _catalog(spark)).select("ord", "name", "entity_id")


@query("j13b_resolve_all_names", ARTICLES + f""", catalog(entity_id, type, alias, ord) AS (VALUES {_ROWS}), names AS (SELECT ord, unnest(entities) AS name FROM articles),
x AS (SELECT DISTINCT lower(name) AS k FROM names), ex AS (SELECT k, arg_min(entity_id, ord) AS e FROM x JOIN catalog ON alias = k GROUP BY k), ne AS (SELECT k, arg_min(entity_id, ord) AS e FROM x JOIN catalog ON length(alias) >= 3 AND (contains(alias, k) OR contains(k, alias)) WHERE k NOT IN (SELECT k FROM ex) GROUP BY k)
SELECT coalesce(ex.e, ne.e) AS entity_id, count(*) AS n, count(DISTINCT names.ord) AS n_articles FROM names LEFT JOIN ex ON ex.k = lower(name) LEFT JOIN ne ON ne.k = lower(name) GROUP BY 1""")
def j13b(spark, d):
    names = articles(spark, d).select("ord", F.explode("entities").alias("name"))
    return graph.resolve_names(names, _catalog(spark)).groupBy("entity_id").agg(F.count("*").alias("n"), F.count_distinct("ord").alias("n_articles"))


@query("j14_candidate_entities", f"WITH catalog(entity_id, type, alias, ord) AS (VALUES {_ROWS}), m AS (SELECT DISTINCT conv_id, turn, entity_id FROM conversations JOIN catalog ON contains(lower(text), alias)) SELECT conv_id, turn, string_agg(entity_id, ',' ORDER BY entity_id) AS entities FROM m GROUP BY ALL HAVING count(*) >= 2")
def j14(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", graph.candidate_entities(F.col("text"), _ENTITIES).alias("e"))
    return c.where("size(e) >= 2").select("conv_id", "turn", F.array_join("e", ",").alias("entities"))


_TYPES = "[" + ", ".join(f"'{t}'" for t in RELATIONS) + "]"
_EDGES = f"""WITH edges AS (SELECT ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS ord, 's' || (l_suppkey % 40) AS source, 's' || (l_partkey % 40) AS target, {_TYPES}[l_linenumber % 9 + 1] AS type, l_shipmode_ AS evidence, 1.0 + least(l_quantity / 50, 1.0) AS weight, CASE WHEN l_linenumber % 4 = 0 THEN 'paper' ELSE 'article' END AS source_type
FROM (SELECT *, repeat('e', (l_quantity::BIGINT % 7)::INT) || l_orderkey AS l_shipmode_ FROM lineitem WHERE l_suppkey % 40 <> l_partkey % 40))
"""


def _edges(spark, d):
    li = table(spark, d, "lineitem")
    kinds = F.element_at(F.array(*map(F.lit, RELATIONS)), (F.col("l_linenumber") % 9 + 1).cast("int"))
    ends = [F.concat(F.lit("s"), F.col(c) % 40).alias(a) for c, a in (("l_suppkey", "source"), ("l_partkey", "target"))]
    evidence = F.concat(F.expr("repeat('e', cast(cast(l_quantity as bigint) % 7 as int))"), F.col("l_orderkey"))
    return li.where("l_suppkey % 40 <> l_partkey % 40").select(F.expr("((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey").alias("ord"), *ends, kinds.alias("type"), evidence.alias("evidence"), graph.edge_weight(F.col("l_quantity")).alias("weight"), F.when(F.col("l_linenumber") % 4 == 0, "paper").otherwise("article").alias("source_type"))


_FOLD = _EDGES + f""", k AS (SELECT *, CASE WHEN type IN {SYMMETRIC} THEN least(source, target) ELSE source END AS a, CASE WHEN type IN {SYMMETRIC} THEN greatest(source, target) ELSE target END AS b FROM edges),
folded AS (SELECT arg_min(source, ord) AS source, arg_min(target, ord) AS target, type, min(ord) AS ord, arg_min(weight, ord) + 0.5 * (count(*) - 1) AS weight, arg_max(evidence, (length(evidence), -ord)) AS evidence, arg_min(source_type, ord) AS source_type FROM k GROUP BY a, b, type)
"""


@query("a09_fold_edges", _FOLD + "SELECT source, target, type, ord, round(weight, 6)::DOUBLE AS weight, evidence FROM folded")
def a09(spark, d):
    return graph.fold_edges(_edges(spark, d)).select("source", "target", "type", "ord", F.round("weight", 6).alias("weight"), "evidence")


@query("a10_edge_weight", ARTICLES + "SELECT ord, round(1 + least(score / 50, 1.0), 6)::DOUBLE AS weight FROM articles")
def a10(spark, d):
    return articles(spark, d).select("ord", F.round(graph.edge_weight(F.col("score")), 6).alias("weight"))


@query("a11_unmatched_names", ARTICLES + f", catalog(entity_id, type, alias, ord) AS (VALUES {_ROWS}) SELECT name, count(*) AS n FROM (SELECT unnest(entities) AS name FROM articles) WHERE name NOT IN (SELECT alias FROM catalog) GROUP BY name ORDER BY n DESC, name LIMIT 10")
def a11(spark, d):
    names = articles(spark, d).select(F.explode("entities").alias("name"))
    return graph.unmatched_names(names, _catalog(spark))


@query("a11b_relation_types", _EDGES + "SELECT type, count(*) AS n FROM edges GROUP BY type")
def a11b(spark, d):
    return _edges(spark, d).groupBy("type").agg(F.count("*").alias("n"))


@query("p21_valid_edges", _EDGES + "SELECT ord FROM edges WHERE substring(source, 2)::INT < 30 AND substring(target, 2)::INT < 30")
def p21(spark, d):
    ids = spark.range(30).select(F.concat(F.lit("s"), "id").alias("entity_id"))
    return graph.valid_edges(_edges(spark, d), ids).select("ord")


@query("p21b_rejected_edges", f"""WITH e AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 11 = 0 THEN '' ELSE 's' || (l_suppkey % 40) END AS source, CASE WHEN l_suppkey % 13 <> 0 THEN 's' || (l_partkey % 40) END AS target, CASE WHEN l_quantity % 7 = 0 THEN 'unheard of' WHEN l_quantity % 7 <> 1 THEN {_TYPES}[l_linenumber % 9 + 1] END AS type FROM lineitem)
SELECT l_orderkey, l_linenumber FROM e WHERE (type IS NOT NULL AND type <> 'unheard of' AND source <> '' AND target IS NOT NULL AND source <> target AND TRY_CAST(substring(source, 2) AS INT) < 30 AND TRY_CAST(substring(target, 2) AS INT) < 30) IS NOT TRUE""")
def p21b(spark, d):
    """What the rules leave out: loops, empty and missing ends, unknown types, unknown entities."""
    whole = F.col("l_quantity") % 7
    kinds = F.element_at(F.array(*map(F.lit, RELATIONS)), (F.col("l_linenumber") % 9 + 1).cast("int"))
    edges = table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_partkey") % 11 == 0, "").otherwise(F.concat(F.lit("s"), F.col("l_suppkey") % 40)).alias("source"),
        F.when(F.col("l_suppkey") % 13 != 0, F.concat(F.lit("s"), F.col("l_partkey") % 40)).alias("target"),
        F.when(whole == 0, "unheard of").when(whole != 1, kinds).alias("type"),
    )
    ids = spark.range(30).select(F.concat(F.lit("s"), "id").alias("entity_id"))
    keys = ["l_orderkey", "l_linenumber"]
    return edges.select(*keys).exceptAll(graph.valid_edges(edges, ids).select(*keys))


@query("j18_adjacency", _EDGES + "SELECT entity, count(*) AS n_out_in FROM (SELECT source AS entity FROM edges UNION ALL SELECT target FROM edges) GROUP BY entity")
def j18(spark, d):
    e = _edges(spark, d)
    return e.select(F.explode(F.array("source", "target")).alias("entity")).groupBy("entity").agg(F.count("*").alias("n_out_in"))


@query("a24_neighbours", _FOLD + """, b AS (SELECT source AS entity, target AS other, * FROM folded UNION ALL SELECT target, source, * FROM folded), t AS (SELECT entity, other, type, count(*) AS n, sum(weight) AS w, min(ord) AS o, arg_min(evidence, ord) AS evidence FROM b GROUP BY ALL),
p AS (SELECT entity, other, sum(n)::BIGINT AS n_edges, sum(w) AS weight, string_agg(type || ':' || n, ',' ORDER BY type) AS kinds, array_to_string(list(evidence ORDER BY o)[1:2], ',') AS evidences FROM t GROUP BY ALL)
SELECT entity, other, n_edges, round(weight, 6)::DOUBLE AS weight, kinds, evidences, row_number() OVER (PARTITION BY entity ORDER BY round(p.weight, 6) DESC, other) AS rank FROM p QUALIFY rank <= 40""")
def a24(spark, d):
    n = graph.neighbours(graph.fold_edges(_edges(spark, d)))
    kinds = F.array_join(F.transform("kinds", lambda x: F.concat_ws(":", x["type"], x["n"].cast("string"))), ",")
    return n.select("entity", "other", "n_edges", F.round("weight", 6).alias("weight"), kinds.alias("kinds"), F.array_join("evidences", ",").alias("evidences"), "rank")


@query("a25_core_subgraph", _FOLD + ", f AS (SELECT * FROM folded WHERE source_type <> 'paper'), g AS (SELECT n, count(*) AS degree FROM (SELECT source AS n FROM f UNION ALL SELECT target FROM f) GROUP BY n), top AS (SELECT n FROM g ORDER BY degree DESC, substring(n, 2)::INT DESC, n LIMIT 28) SELECT ord FROM f WHERE source IN (SELECT n FROM top) AND target IN (SELECT n FROM top)")
def a25(spark, d):
    nodes = spark.range(40).select(F.concat(F.lit("s"), "id").alias("entity_id"), F.col("id").alias("mentions"))
    return graph.core_subgraph(graph.fold_edges(_edges(spark, d)), nodes, 28, papers=False).select("ord")


@query("p23_edge_filters", _EDGES + "SELECT type, count(*) AS n FROM edges WHERE type IN ('acquires', 'mentions') AND source_type <> 'paper' GROUP BY type")
def p23(spark, d):
    return graph.edge_filter(_edges(spark, d), ("acquires", "mentions"), papers=False).groupBy("type").agg(F.count("*").alias("n"))


_NODES = _EDGES + """, entities AS (SELECT 's' || (o_custkey % 60) AS entity_id, 't' || min(o_custkey % 60) % 3 AS type, count_if(o_totalprice > 300000)::BIGINT AS mentions FROM orders GROUP BY o_custkey % 60),
kept AS (SELECT * FROM edges WHERE type = 'acquires' AND source_type <> 'paper')
"""


def _nodes(spark, d):
    k = F.col("o_custkey") % 60
    return table(spark, d, "orders").groupBy(k.alias("k")).agg(F.count_if(F.col("o_totalprice") > 300000).alias("mentions")).select(F.concat(F.lit("s"), "k").alias("entity_id"), F.concat(F.lit("t"), F.col("k") % 3).alias("type"), "mentions")


@query("p23b_graph_nodes", _NODES + "SELECT entity_id FROM entities WHERE entity_id IN (SELECT source FROM kept UNION ALL SELECT target FROM kept) OR mentions > 0")
def p23b(spark, d):
    return graph.graph_nodes(graph.edge_filter(_edges(spark, d), ("acquires",), papers=False), _nodes(spark, d), isolated=True)


@query("j18b_adjacency", _NODES + "SELECT a.entity_id, other, dir, e.type AS kind, ord, a.type AS entity_type, b.type AS other_type FROM (SELECT source AS entity_id, target AS other, 'out' AS dir, type, ord FROM edges UNION ALL SELECT target, source, 'in', type, ord FROM edges) e JOIN entities a ON a.entity_id = e.entity_id LEFT JOIN entities b ON b.entity_id = other")
def j18b(spark, d):
    return graph.adjacency(_edges(spark, d), _nodes(spark, d)).select("entity_id", "other", "dir", F.col("type").alias("kind"), "ord", "entity_type", "other_type")


# ------------------------------------------------------------ citations and papers

_CARDS = ARTICLES + """, ranked AS (SELECT source AS key, ord, url, title, date_raw, row_number() OVER (PARTITION BY source ORDER BY score DESC, ord) AS rank FROM articles QUALIFY rank <= 30),
cards AS (SELECT doc_id AS ord, source AS key, lang AS tag, string_split(coalesce(text, ''), chr(10))[1] AS title, text AS body, CASE WHEN doc_id % 3 = 0 THEN [] ELSE [doc_id % 40, doc_id % 7 + 1, 2] END AS sources FROM documents)
"""


def _cards(spark, d):
    a = articles(spark, d)
    ranked = history.top_n_per(a, ["source"], 30, F.desc("score"), F.col("ord")).select(F.lit("daily").alias("period"), F.col("source").alias("key"), "ord", "url", "title", "source", "date_raw", "rank")
    i = F.col("doc_id")
    cards = table(spark, d, "documents").select(F.lit("daily").alias("period"), F.col("source").alias("key"), i.alias("ord"), F.col("lang").alias("tag"), F.substring_index(F.coalesce("text", F.lit("")), "\n", 1).alias("title"), F.col("text").alias("body"), F.when(i % 3 == 0, F.array().cast("array<bigint>")).otherwise(F.array(i % 40, i % 7 + 1, F.lit(2).cast("bigint"))).alias("sources"))
    return cards, ranked


@query("j05_resolve_citations", _CARDS + ", c AS (SELECT ord, key, unnest(sources) AS rank, generate_subscripts(sources, 1) - 1 AS place FROM cards WHERE len(sources) > 0) SELECT c.ord, c.place::INT AS place, url, substring(title, 1, 140) AS title FROM c JOIN ranked r ON r.key = c.key AND r.rank = c.rank")
def j05(spark, d):
    return reports.resolve_citations(*_cards(spark, d)).select("ord", "place", "url", "title")


@query("j06_fallback_citations", _CARDS + ", w AS (SELECT key, rank, url, list_filter(regexp_split_to_array(lower(title), '\\s+'), lambda w: length(w) > 3)[1:10] AS words FROM ranked), j AS (SELECT c.ord, w.rank, w.url FROM cards c JOIN w USING (key) WHERE len(sources) = 0 AND len(list_filter(words, lambda w: contains(lower(concat_ws(' ', tag, title, body)), w))) >= 3) SELECT ord, row_number() OVER (PARTITION BY ord ORDER BY rank) AS place, url FROM j QUALIFY place <= 5")
def j06(spark, d):
    return reports.fallback_citations(*_cards(spark, d)).select("ord", "place", "url")


@query("j07_attach_papers", _CARDS + ", c AS (SELECT ord, key, unnest(sources[1:8]) AS rank FROM cards WHERE len(sources) > 0) SELECT c.ord, count(DISTINCT (c.rank)) AS paper_count FROM c JOIN ranked r ON r.key = c.key AND r.rank = c.rank GROUP BY c.ord")
def j07(spark, d):
    return reports.resolve_citations(*_cards(spark, d), most=8).groupBy("ord").agg(F.count_distinct("rank").alias("paper_count"))


@query("j07b_papers_of_cards", _CARDS + ", c AS (SELECT ord, key, unnest(sources[1:8]) AS rank, generate_subscripts(sources[1:8], 1) AS place FROM cards WHERE len(sources) > 0), p AS (SELECT c.ord, string_agg(url || '|' || substring(title, 1, 160) || '|' || key || '|' || substring(date_raw, 1, 10), chr(10) ORDER BY place) AS papers, count(*) AS n FROM c JOIN ranked r USING (key, rank) GROUP BY c.ord) SELECT ord, coalesce(papers, '') AS papers, coalesce(CASE WHEN cards.tag = 'en' THEN 99 END, n, 0)::INT AS paper_count FROM cards LEFT JOIN p USING (ord)")
def j07b(spark, d):
    cards, ranked = _cards(spark, d)
    out = reports.attach_papers(cards.withColumn("paper_count", F.when(F.col("tag") == "en", 99)), ranked)
    shown = F.transform("papers", lambda p: F.concat_ws("|", p["url"], p["title"], p["source"], p["date"]))
    return out.select("ord", F.array_join(shown, "\n").alias("papers"), "paper_count")


@query("j08_uncited_items", _CARDS + ", c AS (SELECT key, unnest(sources) AS rank FROM cards WHERE len(sources) > 0) SELECT ord FROM ranked WHERE url NOT IN (SELECT url FROM c JOIN ranked r ON r.key = c.key AND r.rank = c.rank)")
def j08(spark, d):
    cards, ranked = _cards(spark, d)
    return reports.uncited_items(ranked, cards).select("ord")


@query("j20_persona_coverage", _CARDS + ", c AS (SELECT key, unnest(sources) AS rank FROM cards WHERE len(sources) > 0), cited AS (SELECT DISTINCT url FROM c JOIN ranked r ON r.key = c.key AND r.rank = c.rank) SELECT source, count(*) AS n_high, count_if(url IN (SELECT url FROM cited))::BIGINT AS n_cited FROM articles WHERE persona_score >= 8 GROUP BY source")
def j20(spark, d):
    return reports.persona_coverage(articles(spark, d), *_cards(spark, d))


@query("a28_fallback_summary", "WITH t AS (SELECT conv_id, turn, regexp_replace('TREND 0' || turn || ' · ' || role, '^TREND [0-9]+ · ', '') AS tag FROM conversations) SELECT conv_id, array_to_string(list(tag ORDER BY turn)[1:5], ', ') AS summary FROM t GROUP BY conv_id")
def a28(spark, d):
    cards = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("ord"), F.format_string("TREND 0%d · %s", "turn", "role").alias("tag"))
    return reports.fallback_summary(cards, "conv_id")


INSTITUTIONS = ("Inger", "Theration", "Leaux", "Menten", "Erst", "Thnt")
_INST = "[" + ", ".join(f"'{n}'" for n in INSTITUTIONS) + "]"


@query("a12_institution_counts", ARTICLES + f", n AS (SELECT unnest(list_filter({_INST}, lambda k: contains(lower(concat_ws(' ', title, summary)), lower(k)))) AS name FROM articles WHERE source_type IN ('arxiv', 'openalex')) SELECT name, count(*) AS n FROM n GROUP BY name ORDER BY n DESC, name LIMIT 15")
def a12(spark, d):
    return reports.institution_counts(articles(spark, d).where(F.col("source_type").isin("arxiv", "openalex")), INSTITUTIONS)


@query("a13_title_keywords", ARTICLES + """, w AS (SELECT ord, regexp_extract_all(lower(title), '([a-z]{4,})', 1) AS ws FROM articles), u AS (SELECT ord, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w), b AS (SELECT w AS a, lead(w) OVER (PARTITION BY ord ORDER BY i) AS b FROM u),
k AS (SELECT w AS keyword FROM u WHERE w NOT IN ('with', 'that', 'from') UNION ALL SELECT a || ' ' || b FROM b WHERE b IS NOT NULL AND a NOT IN ('with', 'that', 'from') AND b NOT IN ('with', 'that', 'from')) SELECT keyword, count(*) AS n FROM k GROUP BY keyword ORDER BY n DESC, keyword LIMIT 20""")
def a13(spark, d):
    return reports.title_keywords(articles(spark, d), ("with", "that", "from"))


@query("w11_paper_ranking", ARTICLES + ", p AS (SELECT ord, strftime(published_at, '%G-W%V') AS key, score FROM articles WHERE source_type IN ('arxiv', 'openalex')) SELECT key, ord, row_number() OVER (PARTITION BY key ORDER BY score DESC, ord) AS rank FROM p QUALIFY rank <= 30 AND count(*) OVER (PARTITION BY key) >= 3")
def w11(spark, d):
    p = articles(spark, d).where(F.col("source_type").isin("arxiv", "openalex")).withColumn("key", dates.week_key(F.col("published_at")))
    return history.best_of_enough(p, ["key"], 30, 3, F.desc("score"), F.col("ord")).select("key", "ord", "rank")

"""Entities and their relations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newswell.functions.lexicon import RELATIONS, SYMMETRIC
from newswell.functions.text import any_term
from newswell.session import ship
from newswell.storage import stored


def mention_pattern(alias: str) -> str:
    """A literal alias that no ASCII letter adjoins."""
    import re

    return rf"(?<![a-z]){re.escape(alias)}(?![a-z])"


#: Aliases up to which a catalog becomes part of the plan; a larger one is an automaton in the tasks.
UNROLLED = 64


def _mentions_by_automaton(docs: DataFrame, catalog, text: Column, keep: tuple[str, ...]) -> DataFrame:
    """One pass over each text by an Aho-Corasick automaton of all aliases, however many there are."""
    aliases: dict[str, list[str]] = {}
    for entity, names in catalog:
        for a in names:
            aliases.setdefault(a, []).append(entity)
    ship(docs.sparkSession)
    kind = docs.select(*keep, F.lit("").alias("entity_id")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        auto = ahocorasick.Automaton()
        for a, entities in aliases.items():
            auto.add_word(a, (len(a), entities))
        auto.make_automaton()
        letter = frozenset("abcdefghijklmnopqrstuvwxyz")
        for batch in batches:
            rows, found = [], []
            for row, t in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                own = set()
                for end, (n, entities) in auto.iter(t or ""):
                    if t[end - n : end - n + 1] not in letter or end < n:
                        if t[end + 1 : end + 2] not in letter:
                            own.update(entities)
                rows += [row] * len(own)
                found += sorted(own)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows, pa.int32())) for c in batch.columns[:-1]), pa.array(found, pa.string())], names=[*keep, "entity_id"])

    return docs.select(*keep, F.lower(text).alias("__text")).mapInArrow(run, kind)


def entity_mentions(docs: DataFrame, catalog: list[tuple[str, tuple[str, ...]]], text: Column, *keep: str) -> DataFrame:
    """A row for each document and entity of which an alias occurs; ``catalog`` lists (entity_id, aliases), aliases in lower case."""
    if sum(len(a) for _, a in catalog) > UNROLLED:
        return _mentions_by_automaton(docs, catalog, text, keep)
    low = F.lower(text)
    found = F.transform(F.array(low), lambda t: F.array_compact(F.array(*(F.when(t.rlike("|".join(mention_pattern(a) for a in aliases)), F.lit(e)) for e, aliases in catalog))))[0]
    return docs.select(*keep, F.explode(found).alias("entity_id"))


def candidate_entities(text: Column, catalog: list[tuple[str, tuple[str, ...]]]) -> Column:
    """Entities of which an alias stands anywhere in a text, in order."""
    return F.array_sort(F.transform(F.array(F.lower(text)), lambda t: F.array_compact(F.array(*(F.when(any_term(t, a), F.lit(e)) for e, a in catalog))))[0])


def type_counts(mentions: DataFrame, kinds: DataFrame) -> DataFrame:
    """Entities and mentions of each type; ``kinds`` (``entity_id, type``) is a dimension."""
    return mentions.join(kinds, "entity_id").groupBy("type").agg(F.count_distinct("entity_id").alias("n_entities"), F.count("*").alias("n_mentions"))


def unmatched_names(names: DataFrame, catalog: DataFrame, top: int = 10) -> DataFrame:
    """The most frequent annotated names that no alias equals."""
    known = catalog.select(F.col("alias").alias("name")).distinct()
    return names.join(known, "name", "left_anti").groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(top)


def newest_per_name(named: DataFrame, top: int = 30) -> DataFrame:
    """``name, n, overflow, newest``: an index of names with their newest ``top`` articles and how many more there are."""
    totals = named.groupBy("name").agg(F.count("*").alias("n"))
    ranked = named.withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("published_at"), "ord"))).where(F.col("r") <= top)
    newest = ranked.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "ord"))), lambda x: x["ord"]).alias("newest"))
    return totals.join(newest, "name").select("name", "n", F.greatest(F.col("n") - top, F.lit(0)).alias("overflow"), "newest")


def entity_rollup(mentions: DataFrame, top: int = 30) -> DataFrame:
    """Mentions of each entity: how many, mean score, first and last day, and its newest ``top`` articles."""
    newest = mentions.withColumn("r", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("day"), "ord"))).where(F.col("r") <= top).withColumn("r", F.col("r").cast("bigint"))
    newest = newest.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "ord"))), lambda x: x["ord"]).alias("newest"))
    totals = mentions.groupBy("entity_id").agg(F.count("*").alias("total_mentions"), F.bround(F.avg("score"), 1).alias("avg_score"), F.min("day").alias("first_seen"), F.max("day").alias("last_seen"))
    return totals.join(newest, "entity_id")


def auto_entities(items: DataFrame, mentions: DataFrame, least: int = 2) -> DataFrame:
    """Annotated names outside the catalog: ``name, n, avg_score, titles`` of those in ``least`` articles or more.

    ``mentions`` holds ``ord, alias`` of what the catalog matched; a name that overlaps such an alias in its article is left out.
    """
    names = items.select("ord", "title", "score", F.explode("entities").alias("name")).where(F.length("name").between(2, 60)).withColumn("k", F.lower("name"))
    aliases = mentions.groupBy("ord").agg(F.collect_set("alias").alias("aliases"))
    names = names.join(aliases, "ord", "left").where(~F.coalesce(F.exists("aliases", lambda a: F.contains(F.col("k"), a) | F.contains(a, F.col("k"))), F.lit(False)))
    totals = names.groupBy("k").agg(F.min_by("name", "ord").alias("name"), F.count("*").alias("n"), F.bround(F.avg("score"), 1).alias("avg_score")).where(F.col("n") >= least)
    first = names.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("ord"))).where("r <= 3")
    return totals.join(first.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "title"))), lambda x: x["title"]).alias("titles")), "k")


#: Aliases that are looked for together; a larger catalog is gone through in blocks of this many.
BLOCK_ALIASES = 50_000


def _containing(misses: DataFrame, block: list[tuple[str, int, str]]) -> DataFrame:
    """``k, ord, entity_id``: of each name the first alias of a block that it contains or that contains it, by two automata."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        aliases = ahocorasick.Automaton()
        for alias, place, entity in block:
            aliases.add_word(alias, min(aliases.get(alias, (place, entity)), (place, entity)))
        aliases.make_automaton()
        for batch in batches:
            names = batch.column(0).to_pylist()
            found = {k: min((x for _, x in aliases.iter(k)), default=None) for k in names}
            # The other way round the batch's names are the automaton, which reads every alias once.
            own = ahocorasick.Automaton()
            for k in names:
                own.add_word(k, k)
            if len(own):
                own.make_automaton()
                for alias, place, entity in block:
                    for _, k in own.iter(alias):
                        found[k] = min(found[k], (place, entity)) if found[k] else (place, entity)
            hits = [(k, *x) for k, x in found.items() if x]
            yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in hits], pa.string()), pa.array([h[1] for h in hits], pa.int64()), pa.array([h[2] for h in hits], pa.string())], names=["k", "ord", "entity_id"])

    return misses.mapInArrow(run, "k string, ord long, entity_id string")


def resolve_names(names: DataFrame, catalog: DataFrame) -> DataFrame:
    """``name, entity_id``: equal to an alias, else the first alias of three letters or more that contains it or is contained.

    Containment is looked for in one pass over each different name and, a batch of names at a time, one over the aliases. Only the
    names that no alias equals take part. ``catalog`` has ``entity_id, alias, ord``; ``ord`` orders aliases, ties go to the lesser id.
    """
    ship(names.sparkSession)
    distinct = names.select(F.lower("name").alias("k")).distinct()
    order = F.struct(F.col("ord").cast("bigint"), "entity_id")
    exact = distinct.join(catalog.select(F.lower("alias").alias("k"), "entity_id", "ord"), "k").groupBy("k").agg(F.min_by("entity_id", order).alias("entity_id"))
    misses = stored(distinct.join(exact.select("k"), "k", "left_anti").where("k <> ''"), "names")
    long_ = stored(catalog.where(F.length("alias") >= 3).select(F.lower("alias").alias("alias"), F.col("ord").cast("bigint").alias("ord"), "entity_id"), "aliases")
    blocks = -(-long_.count() // BLOCK_ALIASES)
    near = None
    for b in range(blocks):
        own = long_ if blocks == 1 else long_.where(F.pmod(F.xxhash64("alias", "ord", "entity_id"), F.lit(blocks)) == b)
        part = _containing(misses, [tuple(r) for r in own.collect()])
        near = part if near is None else near.unionByName(part)
    found = exact if near is None else exact.unionByName(near.groupBy("k").agg(F.min_by("entity_id", F.struct("ord", "entity_id")).alias("entity_id")))
    return names.withColumn("k", F.lower("name")).join(found, "k", "left").drop("k")


def valid_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges of a known type between two different known entities."""
    ids = entities.select("entity_id").distinct()
    good = edges.where(F.col("type").isin(*RELATIONS) & (F.col("source") != "") & (F.col("target") != "") & (F.col("source") != F.col("target")))
    return good.join(ids.withColumnRenamed("entity_id", "source"), "source", "left_semi").join(ids.withColumnRenamed("entity_id", "target"), "target", "left_semi")


def edge_weight(score: Column) -> Column:
    return 1 + F.least(score / 50, F.lit(1.0))


def fold_edges(edges: DataFrame, symmetric=SYMMETRIC) -> DataFrame:
    """One edge of each kind between two entities: columns of the first, half a point of weight for each further one, the longest evidence."""
    sym = F.col("type").isin(*symmetric)
    keyed = edges.withColumns({"__a": F.when(sym, F.least("source", "target")).otherwise(F.col("source")), "__b": F.when(sym, F.greatest("source", "target")).otherwise(F.col("target"))})
    rest = F.struct(*(c for c in edges.columns if c not in ("weight", "evidence")))
    out = keyed.groupBy("__a", "__b", F.col("type").alias("__t")).agg(F.min_by(rest, "ord").alias("r"), (F.min_by("weight", "ord") + 0.5 * (F.count("*") - 1)).alias("weight"), F.max_by("evidence", F.struct(F.length("evidence"), -F.col("ord"))).alias("evidence"))
    return out.select("r.*", "weight", "evidence")


def neighbours(edges: DataFrame, top: int = 40) -> DataFrame:
    """For each entity its neighbours: edges, weight, kinds and up to two evidences of different kinds; the heaviest ``top``."""
    both = edges.select(F.col("source").alias("entity"), F.col("target").alias("other"), "type", "weight", "evidence", "ord").unionByName(edges.select(F.col("target").alias("entity"), F.col("source").alias("other"), "type", "weight", "evidence", "ord"))
    by_type = both.groupBy("entity", "other", "type").agg(F.count("*").alias("n"), F.sum("weight").alias("w"), F.min("ord").alias("o"), F.min_by("evidence", "ord").alias("evidence"))
    pair = by_type.groupBy("entity", "other").agg(F.sum("n").alias("n_edges"), F.sum("w").alias("weight"), F.array_sort(F.collect_list(F.struct("type", "n"))).alias("kinds"), F.slice(F.transform(F.array_sort(F.collect_list(F.struct("o", "evidence"))), lambda x: x["evidence"]), 1, 2).alias("evidences"))
    return pair.withColumn("rank", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc(F.round("weight", 6)), "other"))).where(F.col("rank") <= top).withColumn("rank", F.col("rank").cast("bigint"))


def core_subgraph(edges: DataFrame, nodes: DataFrame, k: int = 28, types=None, papers: bool = True) -> DataFrame:
    """Edges among the ``k`` entities of highest degree; ``nodes`` gives ``entity_id, mentions`` for ties."""
    kept = edges.where(F.col("type").isin(*types)) if types else edges
    kept = kept if papers else kept.where("source_type <> 'paper'")
    degree = kept.select(F.explode(F.array("source", "target")).alias("entity_id")).groupBy("entity_id").agg(F.count("*").alias("degree"))
    top = degree.join(nodes, "entity_id", "left").orderBy(F.desc("degree"), F.desc(F.coalesce("mentions", F.lit(0))), "entity_id").limit(k).select("entity_id")
    return kept.join(top.withColumnRenamed("entity_id", "source"), "source", "left_semi").join(top.withColumnRenamed("entity_id", "target"), "target", "left_semi")


def effective_mentions(rollup: DataFrame, papers: bool = True) -> Column:
    n = F.coalesce("n_articles", F.lit(0)) + F.coalesce("n_trends", F.lit(0))
    return n + F.coalesce("n_papers", F.lit(0)) if papers else n


def edge_filter(edges: DataFrame, types=None, papers: bool = True) -> DataFrame:
    """Edges of the wanted types, with or without those that papers gave."""
    kept = edges.where(F.col("type").isin(*types)) if types else edges
    return kept if papers else kept.where(F.coalesce("source_type", F.lit("trend")) != "paper")


def graph_nodes(edges: DataFrame, entities: DataFrame, isolated: bool = False) -> DataFrame:
    """``entity_id`` of the edges' ends, and, if wanted, entities without an edge that are mentioned (``mentions`` > 0)."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("entity_id"))
    if isolated:
        ends = ends.unionByName(entities.where("mentions > 0").select("entity_id"))
    return ends.distinct().join(entities.select("entity_id").distinct(), "entity_id", "left_semi")


def adjacency(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """For each known entity its edges in both directions: the other end with its type, ``dir``, kind, evidence and weight."""
    own = ["type", "evidence", "weight", F.coalesce("source_type", F.lit("trend")).alias("source_type"), "ord"]
    out = edges.select(F.col("source").alias("entity_id"), F.col("target").alias("other"), F.lit("out").alias("dir"), *own)
    into = edges.select(F.col("target").alias("entity_id"), F.col("source").alias("other"), F.lit("in").alias("dir"), *own)
    known = entities.select("entity_id", F.col("type").alias("entity_type"))
    both = out.unionByName(into).join(known, "entity_id")
    return both.join(known.select(F.col("entity_id").alias("other"), F.col("entity_type").alias("other_type")), "other", "left")

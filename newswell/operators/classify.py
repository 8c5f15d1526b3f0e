"""Gates, categories and the importance score of articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newswell.functions import dates
from newswell.functions.lexicon import CATEGORIES, CATEGORY_BONUS, Lexicon
from newswell.functions.text import match_normalise, opening, strip

#: Categories that lie within the subject by themselves.
INTRINSIC = ("papers", "legaltech", "models", "coding", "infra")
#: Categories in which a conditional law counts without a mention of the subject.
LAW_RELATED = ("legaltech", "policy", "governance", "gov_policy", "papers", "models", "coding", "infra")


def _joined(title: Column, summary: Column) -> Column:
    """Title and summary as one text; what is null is empty."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(summary, F.lit("")))


def _starts(c: Column, prefixes) -> Column:
    return F.coalesce(c.rlike("(?iu)" + opening(prefixes)), F.lit(False)) if prefixes else F.lit(False)


def text_terms(title: Column, summary: Column, lex: Lexicon) -> Column:
    """Terms of all lists of gates and categories in a text, found in one pass; functions that use it share the pass within a projection."""
    return lex.terms("text")(F.lower(_joined(title, summary)))


def pr_verdict(title: Column, summary: Column, lex: Lexicon) -> Column:
    """``struct(verdict, cap)``: whether a headline looks like press-release material, and the score cap that follows."""
    t = text_terms(title, summary, lex)
    core, verbs = t["ai_core"]["hits"], t["pr_verbs"]["hits"]
    out = lambda verdict, cap=None: F.struct(F.lit(verdict).alias("verdict"), F.lit(cap).cast("int").alias("cap"))
    return (
        F.when(_starts(title, lex["pr_block"]), out("block"))
        .when(_starts(title, lex["pr_cap"]), out("cap", 25))
        .when(_starts(title, lex["pr_opinion"]), F.when(core >= 3, out("pass")).otherwise(out("cap", 28)))
        .when(_starts(title, lex["pr_series"]), F.when(core >= 3, out("pass")).otherwise(out("block")))
        .when(verbs >= 2, F.when(core >= 3, out("cap", 45)).otherwise(out("cap", 30)))
        .otherwise(out("pass"))
    )


def is_relevant(title: Column, summary: Column, source_type: Column, lex: Lexicon) -> Column:
    """The ordered relevance gate. Names of politicians count in titles only, and a guard term excuses them."""
    t = text_terms(title, summary, lex)
    has = lambda name: t[name]["hits"] > 0
    political = (lex.terms("title")(F.lower(F.coalesce(title, F.lit(""))))["political"]["hits"] > 0) & ~has("guard")
    open_source = ~F.coalesce(source_type.isin("naver", "google_news"), F.lit(False))
    return (
        F.when(has("boilerplate"), False)
        .when(pr_verdict(title, summary, lex)["verdict"] == "block", False)
        .when(political | has("blacklist"), False)
        .when(open_source, True)
        .when(has("strong"), True)
        .otherwise((has("ai") & has("legal")) | (t["ai"]["hits"] >= 2) | (t["ai_counts"]["total"] >= 2))
    )


def order_categories(c: Column, most: int = 3) -> Column:
    """Distinct categories by priority, unknown ones last, at most ``most``."""
    rank = F.create_map(*(x for k, v in enumerate(CATEGORIES) for x in (F.lit(v), F.lit(k))))
    keyed = F.transform(F.array_distinct(c), lambda x: F.struct(F.coalesce(F.try_element_at(rank, x), F.lit(99)).alias("r"), x.alias("c")))
    return F.slice(F.transform(F.array_sort(keyed), lambda x: x["c"]), 1, most)


def categorise(title: Column, summary: Column, defaults: Column, source_type: Column, lex: Lexicon) -> Column:
    """Categories of an article: defaults of its source, and those of which a keyword occurs, as a whole word or, in Hangul, anywhere."""
    t = text_terms(title, summary, lex)
    has = lambda name: t[name]["hits"] > 0
    word = lambda c: t[f"cat_{c}"]["words"] > 0 if lex[f"cat_{c}"] else F.lit(False)
    named = [F.when(word(c), F.lit(c)) for c in CATEGORIES if c != "papers"]
    more = [F.when((has("ai") & has("legal")) | has("super"), F.lit("legaltech")), F.when(has("core_law"), F.lit("policy"))]
    paper = F.coalesce(source_type == "arxiv", F.lit(False)) | word("papers")
    both = F.concat(F.coalesce(defaults, F.array().cast("array<string>")), F.array_compact(F.array(*named, *more)))
    return order_categories(F.when(paper, both).otherwise(F.array_remove(both, "papers")))


def merge_primary(categories: Column, primary: Column) -> Column:
    """The annotated category joined to an article's own; a specific one replaces the fallback."""
    joined = F.array_union(F.coalesce(categories, F.array().cast("array<string>")), F.array(primary))
    out = F.when(primary == "ai-industry", joined).otherwise(F.array_remove(joined, "ai-industry"))
    return F.when(primary.isin(*CATEGORIES), order_categories(out)).otherwise(categories)


def bucket_strengths(title: Column, summary: Column, lex: Lexicon) -> Column:
    """How strongly a text speaks of law, the world market and policy, and whether its title is advertising; in plain lower case."""
    t = text_terms(title, summary, lex)
    promo = lex.terms("title")(F.lower(F.coalesce(title, F.lit(""))))["promo"]["hits"] > 0
    return F.struct(*(dates.strength(t[n]["hits"]).alias(n) for n in ("law", "global", "policy")), F.when(promo, 1.0).otherwise(0.0).alias("promo"))


def agenda(title: Column, summary: Column, categories: Column, lex: Lexicon) -> Column:
    t = text_terms(title, summary, lex)
    return (t["super"]["hits"] > 0) | (t["core_law"]["hits"] > 0) | F.coalesce(F.arrays_overlap(categories, F.array(*map(F.lit, ("legaltech", "policy", "gov_policy")))), F.lit(False))


def _measured(df: DataFrame, lex: Lexicon) -> DataFrame:
    """What both scores are made of: terms of each list, strengths, subject, verdict."""
    cats = F.coalesce("categories", F.array().cast("array<string>"))
    text = match_normalise(_joined(F.col("title"), F.col("summary")))
    head = lex.terms("headline")(match_normalise(F.coalesce("title", F.lit(""))))
    work = df.withColumns({"__t": lex.terms("matched")(text), "__h": head, "__c": cats, "__pr": pr_verdict(F.col("title"), F.col("summary"), lex)})
    hits = lambda name: F.col(f"__t.{name}.hits")
    strength = lambda name: dates.strength(hits(name))
    return work.withColumns({
        "__m": F.col("__t.ai_mentions.total"), "__d": strength("decision"), "__r": strength("regulatory"), "__k": strength("market"), "__l": strength("score_legal"), "__neg": hits("negative"), "__promo": F.col("__h.promo.hits") > 0,
        "__core": F.arrays_overlap(F.col("__c"), F.array(*map(F.lit, INTRINSIC))), "__super": hits("super") > 0, "__cond": hits("conditional_law") > 0, "__basic": hits("basic_law") > 0,
    })


def _liked(lex: Lexicon) -> Column:
    """Bonus of names, words and sources that readers kept."""
    by_source = F.lit(0)
    for k, v in reversed(lex.weight("bookmark_sources").items()):
        by_source = F.when(F.contains(F.lower("source"), F.lit(k)), v).otherwise(by_source)
    return F.least(F.lit(12), F.col("__t.bookmark_entities.weight") + F.col("__t.bookmark_keywords.weight") + by_source)


def score_staged(df: DataFrame, lex: Lexicon, run_ts: Column, name: str = "score") -> DataFrame:
    """The alternative score in three stages: a filter, ten times the rating, floors and bonuses.

    Articles without a rating get one of 6 at most from the strength of their terms.
    """
    work = _measured(df, lex)
    total = F.col("__d") + F.col("__r") + F.col("__k") + F.col("__l")
    out = (F.col("__pr.verdict") == "block") | ((F.col("__m") == 0) & ~F.col("__core") & ~F.col("__super")) | ((F.col("__neg") >= 1) & (total < 0.3))
    rating = F.when(F.col("persona_score").between(0, 10), F.col("persona_score")).otherwise(F.least(F.lit(6), F.floor(total * 3)))
    s = rating * 10 + F.coalesce(_liked(lex), F.lit(0))
    s = F.when(F.col("__super"), F.greatest(s, F.lit(85))).otherwise(s)
    s = F.when(F.col("__basic") | F.col("__cond"), F.greatest(s, F.lit(78))).otherwise(s)
    s = s + F.when(F.col("published_at") > run_ts - F.expr("interval 24 hours"), 5).otherwise(0)
    return work.withColumn(name, F.when(out, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(120), s))).cast("int")).select(*[x for x in df.columns if x != name], name)


def score(df: DataFrame, lex: Lexicon, run_ts: Column, name: str = "score") -> DataFrame:
    """Adds the importance score 0 to 120 of ``title, summary, published_at, categories, persona_score, source``.

    Terms add to a base in the measure of the text's context; caps and floors follow in fixed order.
    """
    title, summary = F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))
    work, c = _measured(df, lex), F.col("__c")
    has = lambda *names: F.arrays_overlap(c, F.array(*map(F.lit, names)))
    m, core, neg, cap = F.col("__m"), F.col("__core"), F.col("__neg"), F.col("__pr.cap")
    capped = F.col("__pr.verdict") == "cap"
    total = F.col("__d") + F.col("__r") + F.col("__k") + F.col("__l")
    mult = F.when(m >= 3, 1.0).when(m >= 1, 0.7).otherwise(0.5)
    mult = F.when(core, F.greatest(mult, F.lit(0.85))).otherwise(mult)
    domain = has("legaltech", "papers", "funding")
    least = lambda s, cond, most: F.when(cond, F.least(s, F.lit(float(most)))).otherwise(s)

    def negative(s: Column, minus: bool) -> Column:
        own = F.when(total < 0.5, F.least(s, F.lit(38.0))).when(total < 1.0, F.least(s, F.lit(50.0))).otherwise(F.least(s, F.lit(65.0)))
        other = F.when(total < 0.5, F.least(s, F.lit(18.0))).when(total < 1.0, F.least(s, F.lit(28.0))).otherwise(F.least(s - 25.0 if minus else s, F.lit(45.0)))
        return F.when(neg >= 1, F.when(domain, own).otherwise(other)).otherwise(s)

    steps = [
        lambda _: F.lit(30.0) + F.col("__d") * 28 * mult + F.col("__r") * 28 * mult + F.col("__k") * 18 * mult + F.col("__l") * 12 * mult,
        lambda s: least(s, (F.col("__k") >= 0.5) & (F.col("__d") + F.col("__r") + F.col("__l") < 0.4), 55),
        lambda s: negative(s, True),
        lambda s: least(s, (m <= 2) & (total < 0.3), 22),
        lambda s: least(s, total < 0.1, 25),
        lambda s: least(s, (m >= 3) & (total < 0.4), 33),
        lambda s: s + F.least(F.lit(16), sum((F.when(F.array_contains(c, k), v).otherwise(0) for k, v in CATEGORY_BONUS.items()), F.lit(0))),
        lambda s: s + dates.depth_bonus(F.length(summary)) + F.when(F.length(strip(title)).between(20, 80), 1).when(F.length(strip(title)) > 120, -1).otherwise(0) + dates.recency_boost(F.col("published_at"), run_ts),
        lambda s: least(s, F.col("__promo") & (total < 0.5), 25),
        lambda s: negative(s, False),
        lambda s: F.when(capped, F.least(s, cap.cast("double"))).otherwise(s),
        lambda s: s + F.when(F.col("persona_score").between(0, 10) & ~capped, 8 * F.col("persona_score")).otherwise(0),
    ]
    law = F.least(F.lit(18), F.when(F.col("__basic"), 12).otherwise(0) + F.when(F.col("__cond") & ((m >= 1) | has(*LAW_RELATED)), 12).otherwise(0))
    protect = core | (F.col("__cond") & (m >= 1))
    steps += [
        lambda s: F.when(law > 0, F.greatest(s + law, F.lit(78.0))).otherwise(s),
        lambda s: F.when(F.col("__super"), F.greatest(s + 18, F.lit(70.0))).otherwise(s),
        lambda s: F.when(protect, F.greatest(s, F.lit(35.0))).otherwise(s),
    ]
    floor = F.greatest(F.when(law > 0, 78).otherwise(0), F.when(F.col("__super"), 70).otherwise(0), F.when(protect, 35).otherwise(0))
    steps += [
        lambda s: s + F.when(capped, 0).otherwise(F.coalesce(_liked(lex), F.lit(0))),
        lambda s: F.when(F.col("persona_score").between(0, 10) & ~capped, F.least(s, F.greatest(30 + 10 * F.col("persona_score"), floor).cast("double"))).otherwise(s),
    ]
    for k, step in enumerate(steps):  # a column a step keeps each expression small
        work = work.withColumn("__s", step(F.col("__s") if k else None))
    dropped = (F.col("__pr.verdict") == "block") | ((m == 0) & ~core & ~F.col("__super"))
    return work.withColumn(name, F.when(dropped, 0).otherwise(dates.clamp_score(F.col("__s")))).select(*[x for x in df.columns if x != name], name)


def band(c: Column) -> Column:
    return F.when(c < 35, "0-34").when(c < 50, "35-49").when(c < 70, "50-69").when(c < 90, "70-89").otherwise("90+")


def needs_annotation(lang: Column, source_type: Column, score_: Column, agenda_: Column, summary_ko: Column, insight: Column, entities: Column, primary: Column) -> Column:
    """Whether an article still lacks annotations that its language and weight call for."""
    paper = source_type.isin("arxiv", "openalex")
    no_entities = F.coalesce(F.size(entities), F.lit(0)) <= 0
    empty = lambda x: F.coalesce(x, F.lit("")) == ""
    no_primary = empty(primary) & ~paper
    en = empty(summary_ko) | empty(insight) | no_entities | no_primary
    ko = (((score_ >= 70) | agenda_) & empty(insight)) | no_entities | no_primary
    return F.when(lang == "en", en).when(lang == "ko", ko).otherwise(False)


def annotation_route(lang: Column, source_type: Column, score_: Column, agenda_: Column) -> Column:
    return F.when(source_type.isin("arxiv", "openalex"), "paper").when(lang == "en", "en-full").when((score_ >= 70) | agenda_, "ko-insight").otherwise("ko-ner-only")


def suspicious_date(unknown: Column, published_at: Column, first_seen: Column) -> Column:
    """A date within two minutes of collection is taken for the time of collection."""
    return F.coalesce(unknown, F.lit(False)) | (F.abs(F.unix_timestamp(published_at) - F.unix_timestamp(first_seen)) < 120)


def absorb_annotations(entities: Column, relations: Column, persona: Column, reason: Column) -> Column:
    """What of a model's annotations is sound: trimmed entity names, relations of known types between two names, a rating of 0 to 10."""
    from newswell.functions.lexicon import RELATIONS

    names = F.slice(F.filter(F.transform(entities, lambda x: F.trim(x)), lambda x: (F.length(x) > 1) & (F.length(x) < 60)), 1, 12)
    clean = F.transform(relations, lambda r: F.struct(F.trim(r["src"]).alias("src"), F.trim(r["tgt"]).alias("tgt"), r["type"].alias("type"), F.substring(r["evidence"], 1, 200).alias("evidence")))
    good = F.slice(F.filter(clean, lambda r: r["type"].isin(*RELATIONS) & (r["src"] != "") & (r["tgt"] != "") & (r["src"] != r["tgt"])), 1, 6)
    number = persona.cast("string").try_cast("int")
    return F.struct(names.alias("entities"), good.alias("relations"), F.when(number.between(0, 10), number).alias("persona_score"), F.substring(reason, 1, 200).alias("persona_reason"))


def postprocess_card(body: Column, names=(), phrases=()) -> Column:
    """Names without bold marks, timing phrases taken out, and a bold last sentence where nothing is bold."""
    from newswell.functions.text import emphasise_last, strip_phrases, unbold

    return emphasise_last(strip_phrases(unbold(body, names), phrases))


def revalidate(df: DataFrame, lex: Lexicon, run_ts: Column, legacy: str = "domestic", least: int = 20) -> DataFrame:
    """Stored articles under the present rules: a flag ``kept``, the category that is no longer in use taken out, and a new score.

    An article goes if the gate refuses it or its new score is below ``least``; ``rescored`` marks changes of five points or more.
    """
    gate = is_relevant(F.col("title"), F.col("summary"), F.col("source_type"), lex)
    work = df.withColumns({"categories": F.array_remove("categories", legacy), "__gate": gate}).withColumnRenamed("score", "old_score")
    work = score(work, lex, run_ts)
    kept = F.col("__gate") & (F.col("score") >= least)
    return work.withColumns({"rescored": F.col("__gate") & (F.abs(F.col("score") - F.col("old_score")) >= 5), "kept": kept}).drop("__gate")


def revalidation_counts(df: DataFrame) -> DataFrame:
    """How many articles a revalidation dropped and rescored."""
    return df.agg(F.count_if(~F.col("kept")).alias("dropped"), F.count_if("rescored").alias("rescored"))


def valid_cards(df: DataFrame) -> DataFrame:
    """Cards that have a tag, a title, a body and an action."""
    return df.where(" AND ".join(f"{c} IS NOT NULL AND {c} <> ''" for c in ("tag", "title", "body", "action")))


def score_cut(df: DataFrame, least: int = 20) -> DataFrame:
    return df.where(F.col("score") >= least)


def score_bands(df: DataFrame) -> DataFrame:
    """Articles of each band of the score."""
    return df.groupBy(band(F.col("score")).alias("band")).agg(F.count("*").alias("n"))


def request_rows(top: DataFrame, by: str, line: Column) -> DataFrame:
    """The ranked articles of each group as the numbered lines of a request."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"])
    return top.groupBy(by).agg(F.array_join(rows, "\n").alias("request"))

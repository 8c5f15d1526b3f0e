"""Mixing sources to target weights by Pareto order sampling.

A source's target over its size gives whole copies, which every document gets for
certain, and a rest. For the rest each document has an inclusion probability of
its own, in proportion to its words; documents that would reach 1 are taken for
certain, and the others share what is left (so the expected words are the rest).
Documents of about one size, an eighth of an octave, form a stratum, from which a
number fixed beforehand is taken: expected words, rounded to whole documents from
the longest stratum to the shortest, what rounding leaves open being handed on.

Within a stratum documents are ranked by random odds divided by inclusion odds
(Pareto order sampling, Rosen 1997) and the first of the order are taken. At last
one document of a source is added, left out or changed for another if that brings
the source nearer its target.

The order is never sorted as a whole: one histogram of the ranking statistic finds
the bin in which a stratum's cut lies, and only that bin's documents are ordered.
Decisions depend on ids, texts and sizes alone, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newswell.llm.shared import small_side, stored

WEIGHTS = (3, 1, 2)
#: Words of the mix as a share of all words, and the most copies of a source or document.
SHARE, MOST = 1.5, 2
SEED = 20240131
#: Bins of the ranking statistic of one stratum, and strata in a doubling of the size.
BINS, PER_OCTAVE = 1 << 14, 8
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null. Counted as the ends of words: a word's last character and its following space or end."""
    squeezed = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(squeezed, " "), lambda x: x != "")).cast("bigint")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, source_size, target`` for rows of ``source, size``.

    Sources by code point, null last, take the weights in turn. Targets share
    ``share`` of all words by weight but stop at ``most`` times their source; the
    excess goes to the others by weight until none is above. Runs on one row a source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int")))
    per = per.withColumn("full_at", most * F.col("source_size") / F.col("weight")).withColumn("total", F.sum("source_size").over(Window.partitionBy()) * float(share)).withColumn("all_weight", F.sum("weight").over(Window.partitionBy()))
    before = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    gone = F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0.0))
    left = F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", (F.col("total") - gone) / left)
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(Window.partitionBy())["level"]
    target = F.least(F.col("weight") * F.coalesce(level, F.lit(float("inf"))), most * F.col("source_size").cast("double"))
    return per.select("source", "source_size", target.cast("double").alias("target"))


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, key``: words, and a hash of id and text by which rows are ranked."""
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64(F.lit(SEED), "doc_id", F.col("doc_id").isNull(), "text").alias("key"))


def _stratum(size: Column) -> Column:
    return F.floor(F.log2(size) * PER_OCTAVE).cast("int")


def _statistic(key: Column, p: Column, seed: int) -> Column:
    """Pareto's ranking statistic q, odds of a random number over inclusion odds, as q / (1 + q), from 0 to 1."""
    u = (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    odds = u / (1 - u)
    return F.when(p < 1, odds / (odds + F.try_divide(p, 1 - p))).otherwise(0.0)


def strata_plan(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """A row a source and stratum: target, certain ``copies``, ``rate`` (inclusion probability a word) and ``take``, the number of documents to sample.

    Runs on sums: a source has at most as many strata as eighths of octaves in its sizes. Sizes of 0 have a null stratum and are never sampled.
    """
    per = sizes.groupBy("source", F.when(F.col("size") > 0, _stratum(F.col("size"))).alias("stratum")).agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.sum(F.col("size").cast("double") * F.col("size")).alias("squares"))
    per = stored(per, "mix-strata")
    targets = source_targets(per.select("source", F.col("words").alias("size")), weights, share, most)
    ratio = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    targets = targets.withColumn("copies", F.floor(ratio).cast("int")).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")).withColumnRenamed("source", "__s")
    per = per.join(targets, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    # From the longest stratum on: those of which the mean probability would reach 1 are certain.
    longer = Window.partitionBy("source").orderBy(F.desc_nulls_last("stratum")).rowsBetween(Window.unboundedPreceding, -1)
    others = Window.partitionBy("source").orderBy(F.desc_nulls_last("stratum")).rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumns({"certain_words": F.coalesce(F.sum("words").over(longer), F.lit(0)), "open_squares": F.sum("squares").over(others)})
    rate = F.try_divide(F.col("rest") - F.col("certain_words"), F.col("open_squares"))
    per = per.withColumn("rate", rate).withColumn("certain", (F.col("words") > 0) & (F.col("rate") * F.col("squares") >= F.col("words")))
    # A stratum is certain if all longer ones are; the first that is not sets the rate of all that follow.
    per = per.withColumn("certain", ~F.max(~F.col("certain")).over(longer.rowsBetween(Window.unboundedPreceding, 0)))
    per = per.withColumn("rate", F.coalesce(F.max(F.when(~F.col("certain"), F.struct("stratum", "rate"))).over(Window.partitionBy("source"))["rate"], F.lit(0.0)))
    # Whole documents, the longest stratum first; the words that rounding leaves open go to the next.
    row = F.struct(F.when(F.col("stratum").isNull(), 1).otherwise(0).alias("last"), (-F.col("stratum")).alias("order"), "stratum", "n", "words", "squares", "certain")
    listed = per.groupBy("source", "source_size", "target", "copies", "rest", "rate").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    none = F.struct(F.lit(0.0).alias("open"), F.array().cast("array<struct<stratum:int,take:bigint>>").alias("out"))

    def deal(state: Column, x: Column) -> Column:
        want = F.when(x["certain"], x["words"].cast("double")).otherwise(F.col("rate") * x["squares"]) + state["open"]
        mean = x["words"] / x["n"]
        take = F.when(x["stratum"].isNull(), F.lit(0)).when(x["certain"], x["n"]).otherwise(F.greatest(F.lit(0), F.least(x["n"], F.round(F.try_divide(want, mean)))))
        return F.struct((want - take * mean).alias("open"), F.concat(state["out"], F.array(F.struct(x["stratum"].alias("stratum"), take.cast("bigint").alias("take")))).alias("out"))

    return listed.select("source", "source_size", "target", "copies", "rest", "rate", F.inline(F.aggregate("rows", none, deal)["out"])).join(per.select(F.col("source").alias("__s"), F.col("stratum").alias("__t"), "n"), F.col("source").eqNullSafe(F.col("__s")) & F.col("stratum").eqNullSafe(F.col("__t"))).drop("__s", "__t")


def _planned(df: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """Rows of ``source, size, key, ...`` with their stratum's columns and their statistic ``v``. The plan is broadcast while it is small."""
    renamed = plan.withColumnsRenamed({"source": "__s", "stratum": "__t"})
    stratum = F.when(F.col("size") > 0, _stratum(F.col("size")))
    joined = df.join(small_side(renamed, 200), F.col("source").eqNullSafe(F.col("__s")) & stratum.eqNullSafe(F.col("__t")))
    return joined.withColumn("v", _statistic(F.col("key"), F.least(F.lit(1.0), F.col("rate") * F.col("size")), seed))


def mixing_plan(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """A row a source and stratum: sizes, target, certain copies, and where the Pareto order is cut; and the source's last change.

    ``sizes`` (stored rows of :func:`sized`) is read a few times.
    """
    plan = stored(strata_plan(sizes, weights, share, most), "mix-plan")
    by = ["source", "stratum"]
    ranked = _planned(sizes, plan, seed).withColumnsRenamed({"__s": "s_", "__t": "stratum"}).drop("s_")
    cut_in = ranked.where("take > 0 AND take < n")
    # The bin of the statistic in which the last document that is taken stands, and how many of the bin are.
    bin_ = F.least(F.floor(F.col("v") * BINS), F.lit(BINS - 1)).cast("int")
    counts = cut_in.groupBy(*by, "take", bin_.alias("bin")).agg(F.count("*").alias("own"))
    upto = F.sum("own").over(Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    found = counts.withColumn("upto", upto).where("upto >= take AND upto - own < take").select(F.col("source").alias("__s"), F.col("stratum").alias("__t"), F.col("bin").alias("cut_bin"), (F.col("take") - F.col("upto") + F.col("own")).alias("left"))
    found = stored(found, "mix-bins")
    same = F.col("source").eqNullSafe(F.col("__s")) & F.col("stratum").eqNullSafe(F.col("__t"))
    inside = cut_in.join(small_side(found, 40), same & (bin_ == F.col("cut_bin"))).select("source", "stratum", "v", "key", "left")
    place = F.row_number().over(Window.partitionBy(*by).orderBy("v", "key"))
    cut = inside.withColumn("place", place).where("place = left").select(F.col("source").alias("__s"), F.col("stratum").alias("__t"), F.col("v").alias("cut_v"), F.col("key").alias("cut_key"))
    plan = stored(plan.join(cut, same, "left").drop("__s", "__t"), "mix-cut")
    change = _best_change(_planned(sizes, plan, seed).where("size > 0 AND rest > 0").select("source", "size", "rest", F.struct("v", "key").alias("d"), _taken().alias("in")))
    return stored(plan.join(change, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s"), "mix-changed")


def _taken() -> Column:
    """Whether a row is sampled: all of its stratum are, or it stands before or at the cut. Rows of equal id and text fall together."""
    before = (F.col("v") < F.col("cut_v")) | ((F.col("v") == F.col("cut_v")) & (F.col("key") <= F.col("cut_key")))
    return (F.col("take") > 0) & ((F.col("take") >= F.col("n")) | F.coalesce(before, F.lit(False)))


def _best_change(docs: DataFrame) -> DataFrame:
    """The document to add and the one to leave out, if any, that bring a source nearest its target.

    One document stands for all of its size, so a group has as many rows as there are sizes.
    """
    sizes = docs.groupBy("source", "in", "size").agg(F.min("d").alias("d"), F.count("*").alias("n"), F.first("rest").alias("rest"))
    gap = F.col("rest") - F.sum(F.when(F.col("in"), F.col("size") * F.col("n")).otherwise(0)).over(Window.partitionBy("source"))
    sizes = sizes.select("source", "in", F.col("size").cast("double").alias("size"), "d", gap.alias("gap"))
    none = sizes.groupBy("source").agg(F.first("gap").alias("gap"))
    none = none.select("source", F.explode(F.array(F.lit(True), F.lit(False))).alias("in"), F.lit(0.0).alias("size"), F.lit(None).cast("struct<v:double,key:bigint>").alias("d"), "gap")
    both = sizes.unionByName(none).withColumn("at", F.col("size") + F.when(F.col("in"), F.col("gap")).otherwise(0.0))
    other = F.when(~F.col("in"), F.struct("size", "d"))
    order = Window.partitionBy("source").orderBy("at", "in", "size")
    near = both.withColumns({"low": F.last(other, True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "high": F.first(other, True).over(order.rowsBetween(0, Window.unboundedFollowing))}).where("`in`")
    near = near.select("source", "gap", "at", F.col("d").alias("out"), F.explode(F.array("low", "high")).alias("add")).where("add IS NOT NULL").withColumn("off", F.abs(F.col("add.size") - F.col("at"))).where("off < abs(gap)")
    best = near.groupBy("source").agg(F.min(F.struct("off", "add", "out")).alias("x"))
    return best.select(F.col("source").alias("__s"), F.col("x.add.d").alias("add"), F.col("x.out").alias("out"))


def with_copies(df: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds each row's number of copies, ``n_copies``, and the plan's columns to rows of ``source, size, key, ...``."""
    ranked = _planned(df, plan, seed)
    is_ = lambda c: F.coalesce((F.col("v") == F.col(c)["v"]) & (F.col("key") == F.col(c)["key"]), F.lit(False))
    more = (F.col("size") > 0) & ((_taken() & ~is_("out")) | is_("add"))
    return ranked.withColumn("n_copies", F.col("copies") + F.when(more, 1).otherwise(0))


def mix_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """The mix: each row of ``docs`` as often as it is taken, with the columns of ``docs``.

    Null texts have no words: they count for nothing and come with their source's certain
    copies only. Null sources form one source. Ties of the order, rows of equal id and text,
    fall together, so a document that a table repeats very often can leave its source off the
    target by its own words. Ids may be of any type; a text of any length counts in full. An
    empty table stays empty.
    """
    plan = mixing_plan(stored(sized(docs), "mix-sizes"), weights, share, most, seed)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    work = docs.select(row, "source", n_words(F.col("text")).alias("size"), F.xxhash64(F.lit(SEED), "doc_id", F.col("doc_id").isNull(), "text").alias("key"))
    return with_copies(work, plan, seed).where("n_copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy")).select("row.*")


def op6_source_mixing(spark, sf_dir: str) -> DataFrame:
    sizes = stored(sized(spark.read.parquet(f"{sf_dir}/documents.parquet")), "mix-sizes")
    out = with_copies(sizes, mixing_plan(sizes))
    return out.select("doc_id", "size", "source_size", "target", (F.col("n_copies") * F.col("size")).cast("bigint").alias("taken"), "source")

"""Term lists: the automaton against a loop over terms, and cases of gates, categories and scores with fixed results."""

import datetime as dt
import random
import re

import pytest
from newswell.functions import text
from newswell.functions.lexicon import MOST_TERMS, Lexicon
from newswell.functions.terms import TermIndex, term_hits
from newswell.operators import classify
from pyspark.sql import functions as F

RUN = dt.datetime(2026, 5, 28, 12)
SIZES = {"blacklist": 586, "negative": 190, "score_legal": 83, "cat_policy": 40}


def made():
    """Lists of a realistic size with shared, nested and repeated terms, Hangul and odd characters."""
    rng = random.Random(1)
    syllables = ["ab", "ra", "con", "tion", "법", "률", "ai", "-", " ", ".", "é", "원", "x1"]
    lists = {n: ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))).strip() or "q" for _ in range(size)] for n, size in SIZES.items()}
    lists["negative"] += lists["blacklist"][:5] + lists["negative"][:3]
    texts = ["".join(rng.choice(syllables) for _ in range(rng.randint(0, 80))) for _ in range(120)] + [None, "", "ai" * 200]
    return lists, texts


def by_loop(terms, t, whole=False):
    t = t or ""
    hits = sum(k in t for k in terms)
    total = sum(t.count(k) for k in terms)
    words = sum(re.search(re.escape(k) if re.search("[가-힣]", k) else r"\b" + re.escape(k) + r"\b", t) is not None for k in terms)
    return hits, total, words


def test_automaton_equals_a_loop_over_terms(spark):
    lists, texts = made()
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", term_hits(F.col("t"), lists, totals=lists, words=lists, weights={"negative": {lists["negative"][0]: 2.5}}).alias("x"))
    for r in df.collect():
        for name, terms in lists.items():
            got = r["x"][name]
            assert (got["hits"], got["total"], got["words"]) == by_loop(terms, texts[r["i"]])
        times = lists["negative"].count(lists["negative"][0]) and lists["negative"][0] in (texts[r["i"]] or "")
        assert r["x"]["negative"]["weight"] == (2.5 if times else 0.0)
    assert term_hits(F.col("t"), {}) is not None and TermIndex({"none": ()}).count(["x"])[0].tolist() == [[0]]


def test_lexicon_from_a_table(spark):
    lists, _ = made()
    rows = [(n, t, None, k) for n, terms in lists.items() for k, t in enumerate(terms)] + [("bookmark_sources", "reuters", 5.0, 0)]
    lex = Lexicon.from_table(spark.createDataFrame(rows, "list_name string, term string, weight double, ord int"))
    assert {n: list(lex[n]) for n in lists} == lists and lex.weight("bookmark_sources") == {"reuters": 5.0}
    with pytest.raises(ValueError):
        Lexicon.from_table(spark.range(MOST_TERMS + 1).selectExpr("'x' AS list_name", "string(id) AS term", "0D AS weight", "int(id) AS ord"))


def gate(spark, lex, title, summary="", source="naver"):
    df = spark.createDataFrame([(title, summary, source)], "t string, s string, k string")
    return df.select(classify.is_relevant(F.col("t"), F.col("s"), F.col("k"), lex)).first()[0]


def test_gate_has_lists_of_its_own_for_kinds_and_mentions(spark):
    lex = Lexicon({"ai": ("ai", "llm"), "ai_counts": (" ai ", "ai ", " ai"), "legal": ("court",), "political": ("smith",), "guard": ("policy",), "blacklist": ("lottery",), "boilerplate": ("as a language model",), "strong": ("legal tech",)})
    assert not gate(spark, lex, "one ai,") and gate(spark, lex, "an ai tool") and gate(spark, lex, "ai and llm") and gate(spark, lex, "llm in court") and gate(spark, lex, "legal tech")
    assert not gate(spark, lex, "Smith on ai ai") and gate(spark, lex, "Smith on ai policy") and gate(spark, lex, "ai ai", "said Smith") and not gate(spark, lex, "ai ai", "a lottery", "rss") and gate(spark, lex, "x", None, "rss") and gate(spark, lex, "x", "", None)
    assert not gate(spark, lex, "ai ai", "As a language model")


@pytest.mark.parametrize(("title", "verdict"), [("[ 게시판 ] x", "block"), ("[게시판]x", "block"), (" [ 책  소개 ] x", "block"), ("[AI&빅데이터쇼] x", "cap"), ("[ ai & 빅데이터쇼 ]", "cap"), ("게시판 x", "pass"), ("", "pass"), (None, "pass")])
def test_headline_marks_allow_blanks(spark, title, verdict):
    lex = Lexicon({"pr_block": ("[게시판]", "[책 소개]"), "pr_cap": ("[AI & 빅데이터쇼]",)})
    df = spark.createDataFrame([(title,)], "t string")
    assert df.select(classify.pr_verdict(F.col("t"), F.lit(None).cast("string"), lex)["verdict"]).first()[0] == verdict


@pytest.mark.parametrize(("title", "want"), [("리걸테크를 도입", "legaltech"), ("A Legal-Tech firm", "legaltech"), ("legal-technology", ""), ("LEGAL-TECH", "legaltech"), ("paper", "")])
def test_categories_by_words_and_hangul(spark, title, want):
    lex = Lexicon({"cat_legaltech": ("리걸테크", "Legal-tech"), "cat_papers": ("preprint",)})
    df = spark.createDataFrame([(title,)], "t string")
    got = df.select(F.array_join(classify.categorise(F.col("t"), F.lit(""), F.array(F.lit("papers")), F.lit("blog"), lex), ",")).first()[0]
    assert got == want


def test_papers_stay_with_a_word_of_theirs(spark):
    lex = Lexicon({"cat_papers": ("preprint",)})
    df = spark.createDataFrame([("a preprint", "blog"), ("x", "arxiv"), ("x", "blog")], "t string, k string")
    assert [r[0] for r in df.select(F.array_join(classify.categorise(F.col("t"), F.lit(""), F.array(F.lit("papers")), F.col("k"), lex), ",")).collect()] == ["papers", "papers", ""]


@pytest.mark.parametrize(("value", "want"), [("«A»·B", " a b"), ("x  ai ", "x ai "), ("포럼' 개최", "포럼 개최"), ("「법」 `x`", " 법 x "), ("a\t\nb", "a b")])
def test_marks_are_blanks(spark, value, want):
    assert spark.createDataFrame([(value,)], "c string").select(text.match_normalise(F.col("c"))).first()[0] == want


LEX = Lexicon({"ai": ("ai",), "ai_mentions": (" ai ", "ai ", " ai"), "conditional_law": ("privacy act",), "decision": ("Adopts",)}, {"bookmark_sources": {"reuters": 5}})


def score(spark, title, summary="", cats=(), source="s", persona=None):
    df = spark.createDataFrame([(title, summary, None, list(cats), persona, source)], "title string, summary string, published_at timestamp, categories array<string>, persona_score int, source string")
    return classify.score(df, LEX, F.lit(RUN)).first()["score"]


def test_score_cases(spark):
    long_ = "plain words " * 20
    assert score(spark, "On the privacy act", long_, ["papers"]) >= 78  # papers are among the categories in which the law counts
    assert score(spark, "On the privacy act", long_, ["ai-industry"]) == 0  # no mention, no category that stands by itself
    assert score(spark, "ai adopts", long_, ["legaltech"], "Reuters") == score(spark, "ai adopts", long_, ["legaltech"], "reuters") == score(spark, "ai adopts", long_, ["legaltech"]) + 5
    # One mention between blanks counts three times, also at the end of a text without a summary.
    assert score(spark, "he adopts ai", "") == score(spark, "he adopts ai ai ai", "")
    assert score(spark, " " * 30 + "it adopts ai", long_, ["legaltech"]) == score(spark, "it adopts ai", long_, ["legaltech"])


def test_strengths_count_a_term_as_often_as_it_is_listed(spark):
    lex = Lexicon({"policy": ("rule", "rule", "a·b"), "law": ("law",), "promo": ("sale",)})
    df = spark.createDataFrame([("Sale", "a·b rule")], "t string, s string")
    got = df.select(classify.bucket_strengths(F.col("t"), F.col("s"), lex).alias("x")).first()["x"]
    assert (got["policy"], got["law"], got["promo"]) == (round(1 - 0.78**3, 3), 0.0, 1.0)


def test_a_batch_is_turned_into_strings_in_parts(monkeypatch):
    import pyarrow as pa

    index, sizes = TermIndex({"x": ("ab",)}, totals=("x",)), []
    count = TermIndex.count
    monkeypatch.setattr(TermIndex, "count", lambda self, texts: sizes.append(len(texts)) or count(self, texts))
    got = index.struct(pa.array(["ab ab", None, "b"] * 400)).to_pylist()
    assert [r["x"]["total"] for r in got] == [2, 0, 0] * 400 and max(sizes) <= 256 and sum(sizes) == 1200
    assert index.struct(pa.array([], pa.string())).to_pylist() == []

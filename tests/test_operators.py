"""Operators on hand-made rows: edge cases, Hangul, payloads, invariants of score and clusters."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from newswell.functions import dates, text
from newswell.functions.lexicon import Lexicon
from newswell.operators import classify, cluster, graph, history, reports
from newswell import storage
from newswell.sources import payloads, tables

RUN = dt.datetime(2026, 5, 28, 12)


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (text.unescape, "&#44032;&#x1F600; a&amp;lt; &quot;b&quot; &nope;", '가😀 a&lt; "b" &nope;'),
        (text.unescape, "&#38;lt; &rsquo;&ldquo;&euro;&eacute; &#150; &copy2 &notit; &#0; &#x110000;", "&lt; ’“€é – ©2 ¬it; \ufffd \ufffd"),
        (text.clean_text, " <b>a</b>\n&nbsp;&lt;i&gt; ", "a"),
        (lambda c: text.truncate(c, 9), "one two three", "one two…"),
        (text.normalize_url, "http://a/?utm_x=1&b=2", "http://a/&b=2"),
        (text.normalize_url, "http://a/p?fbclid=9", "http://a/p"),
        (text.normalize_url, " http://a/p?gclid=1#top ", "http://a/p"),
        (text.normalize_url, "http://a/?utm_&b=1", "http://a/"),
        (text.strip_particle, "서울에서", "서울"),
        (text.strip_particle, "나는", "나는"),
        (lambda c: F.array_join(text.tokens(c), " "), "법원은 AI 판결문을 공개, 공개!", "법원 ai 판결문 공개"),
        (lambda c: text.head_token(c, ("법무법인",), ("광장",)), "[로펌] 법무법인 광장, AI 도입", "광장"),
        (text.head_token, "'AI는 막는다'…KB금융, 발표", "kb금융"),
        (text.head_token, "AI: x", ""),
        (text.arxiv_id, "https://arxiv.org/pdf/2401.01234v2", "2401.01234"),
        (text.arxiv_id, "https://arxiv.org/abs/math/0301001", None),
        (text.emphasise_last, "First one. And the last.", "First one. **And the last**."),
        (text.emphasise_last, " Version 3.1 ships now! ", "**Version 3.1 ships now**!"),
        (text.emphasise_last, "Too short.", "Too short."),
        (text.emphasise_last, "A **bold** part. And more.", "A **bold** part. And more."),
        (text.emphasise_last, "One! Two? Three", "One! Two? **Three**"),
        (lambda c: text.unbold(c, ("Acme",)), "**Acme's new office** and **short** but **a longer point**", "Acme's new office and short but **a longer point**"),
        (lambda c: text.strip_phrases(c, ["this week"]), "It grew This Week\t , then\nfell \t!", "It grew, then\nfell!"),
        (text.number_breaks, "Intro 1) one 2) two (3) x 3. 4) y 5)z", "Intro\n\n1) one\n\n2) two (3) x 3. 4) y 5)z"),
        (text.expanded_key, "2024W05", "2024-W05"),
    ],
)
def test_text(spark, f, value, want):
    assert one(spark, value, f) == want


def test_abstract_and_dates(spark):
    assert one(spark, {"b": [1, 3], "a": [0], "c": [2]}, text.rebuild_abstract, "map<string,array<int>>") == "a b c b"
    parse = lambda v, lang: one(spark, v, lambda c: F.date_format(dates.parse_date(c, F.lit(lang)), "yyyy-MM-dd HH:mm"))
    assert parse("Wed, 31 Jan 2024 09:00:00 +0900", "en") == "2024-01-31 00:00"
    assert parse("2024-01-31T09:00:00", "ko") == "2024-01-31 00:00" and parse("2024-01-31", "en") == "2024-01-31 00:00"
    assert parse("soon", "en") is None and parse(None, "en") is None
    assert [one(spark, v, dates.clamp_score, "double") for v in (2.5, 3.5, -4.0, 999.0)] == [2, 4, 0, 120]


def test_aliases_need_free_letters(spark):
    docs = spark.createDataFrame([(1, "fairness and leveraging"), (2, "fair RAG"), (3, "copilot을 llama3")], "ord int, t string")
    got = graph.entity_mentions(docs, [("fair", ("fair",)), ("rag", ("rag",)), ("copilot", ("copilot",)), ("llama", ("llama",))], F.col("t"), "ord").collect()
    assert sorted(map(tuple, got)) == [(2, "fair"), (2, "rag"), (3, "copilot"), (3, "llama")]


def test_symmetric_edges_fold(spark):
    e = spark.createDataFrame([(1, "x", "y", "competes_with", "a", 1.0), (2, "y", "x", "competes_with", "longer", 1.0), (3, "x", "y", "acquires", "b", 1.0), (4, "y", "x", "acquires", "c", 1.0)], "ord int, source string, target string, type string, evidence string, weight double")
    got = sorted((r["source"], r["type"], r["weight"], r["evidence"]) for r in graph.fold_edges(e).collect())
    assert got == [("x", "acquires", 1.0, "b"), ("x", "competes_with", 1.5, "longer"), ("y", "acquires", 1.0, "c")]


LEX = Lexicon({"ai": ("ai", "llm"), "legal": ("court",), "decision": ("adopts",), "regulatory": ("act",), "basic_law": ("basic act",), "conditional_law": ("privacy act",), "super": ("court rulings",), "negative": ("sale",), "pr_block": ("[Board]",)})


def scored(spark, rows):
    schema = "title string, summary string, published_at timestamp, categories array<string>, persona_score int, source string"
    return [r["score"] for r in classify.score(spark.createDataFrame(rows, schema), LEX, F.lit(RUN)).collect()]


def test_score_keeps_its_floors_and_bounds(spark):
    long_ = "an ai and llm and ai text about the privacy act " * 6
    got = scored(spark, [("Privacy act and AI", long_, None, [], 3, "s"), ("Court rulings opened", long_, None, [], 2, "s"), ("AI tool", "short", None, ["legaltech"], 0, "s"), ("AI start-up", "ai product", None, ["ai-industry"], 7, "s"), ("AI basic act and privacy act", long_, None, ["legaltech", "policy"], 10, "s"), ("[Board] AI", long_, None, ["legaltech"], 10, "s"), ("Garden", "flowers", None, [], None, "s"), (None, None, None, None, None, None)])
    assert got[0] >= 78 and got[1] >= 70 and got[2] >= 35 and got[3] <= 100 and got[5] == 0 and got[6] == 0 and got[7] == 0
    assert all(0 <= x <= 120 for x in got)


def test_near_duplicates_need_an_event_in_common(spark):
    day = dt.datetime(2026, 5, 28, 1)
    rows = [(1, "alpha wins big court case", "S1"), (2, "beta court opens new office", "S2"), (3, "acme ships robot lawyer to courts in europe", "S3"), (4, "acme ships a robot lawyer to courts", "S4"), (5, "acme hires chief economist", "S5")]
    df = spark.createDataFrame([(o, t, "", s, day, "2026-05-28", f"u{o}", 10 * o, ["a"]) for o, t, s in rows], "ord int, title string, summary string, source string, published_at timestamp, date_raw string, url string, score int, categories array<string>")
    pairs = cluster.duplicate_pairs(df, F.lit(RUN), ("acme",), sequence=False)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {(3, 4)}
    labels = cluster.connected_components(pairs, df.select("ord"))
    out = {r["ord"]: r for r in cluster.collapse_clusters(df, labels).collect()}
    assert set(out) == {1, 2, 4, 5} and out[4]["related_count"] == 1 and out[4]["related"][0]["url"] == "u3"
    assert cluster.duplicate_pairs(df, F.lit(RUN + dt.timedelta(days=60)), sequence=False).count() == 0


def test_merge_is_idempotent(spark):
    schema = "url string, title string, published_at timestamp, first_seen timestamp, date_unknown boolean, entities array<string>, ord int"
    t = lambda d: RUN - dt.timedelta(days=d)
    prev = spark.createDataFrame([("a", "old", t(2), t(2), False, ["E"], 1), ("b", "gone", t(40), t(40), False, None, 2), ("c", "kept", t(3), t(1), False, None, 3), ("d", "undated", None, t(1), True, None, 4)], schema)
    new = spark.createDataFrame([("a", "new", t(0), t(0), True, None, 1), ("e", "fresh", t(0), t(0), False, None, 5), ("f", "undated", None, t(0), True, None, 6)], schema)
    once = history.merge_articles(prev, new, F.lit(RUN))
    rows = {r["url"]: r for r in once.collect()}
    assert set(rows) == {"a", "c", "e", "f"} and rows["a"]["title"] == "new" and rows["a"]["entities"] == ["E"]
    assert rows["a"]["published_at"] == t(2) and rows["a"]["first_seen"] == t(2) and not rows["a"]["date_unknown"] and rows["e"]["is_new"]
    again = history.merge_articles(once.drop("is_new"), new, F.lit(RUN)).drop("is_new")
    assert sorted(map(str, again.collect())) == sorted(map(str, once.drop("is_new").select(*again.columns).collect()))


def test_payloads(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>A &amp;amp; B</title><link>http://x/?utm_a=1</link><description>&lt;p&gt;t&lt;/p&gt;</description><pubDate>Wed, 31 Jan 2024 09:00:00 +0000</pubDate></item><item><title></title><link>http://y</link><description>q</description><pubDate>none</pubDate></item></channel></rss>")
    got = payloads.normalise_feed(payloads.read_feed(spark, str(tmp_path / "f.xml")), F.lit("src"), F.lit("rss"), F.lit("en"), F.lit(RUN)).collect()
    assert [(r["title"], r["url"], r["summary"], r["date_unknown"]) for r in got] == [("A & B", "http://x/", "t", False)]
    pages = spark.createDataFrame([(1, '<meta content="T1" property="og:title"><meta name="description" content="D &amp; E">'), (2, "<title>T2</title>"), (3, "")], "page_id int, html string")
    og = {r["page_id"]: (r["og_title"], r["og_description"]) for r in payloads.open_graph(pages).collect()}
    assert og == {1: ("T1", "D & E"), 2: ("T2", ""), 3: (None, "")}
    answers = ['{"a":1}', 'Sure\n```json\n{"a":2}\n```', 'x {"a":3} y', '[{"a":4},{"a":5},{"a"', "sorry"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in answers], "c string").select(payloads.lenient_object(F.col("c"))).collect()]
    assert got == ['{"a":1}', '{"a":2}', '{"a":3}', '[{"a":4},{"a":5}]', None]
    marks = payloads.bookmarks(spark.createDataFrame([('{"items":{"u":{"savedAt":7},"v":true}}',)], "value string")).collect()
    assert sorted((r["key"], r["saved_at"]) for r in marks) == [("u", 7), ("v", 1)]
    assert payloads.read_first_existing(spark, [str(tmp_path / "none")], "a int").count() == 0


def test_snapshots_and_runs(spark):
    df = spark.range(5)
    assert tables.write_snapshot(df, "t").count() == 5
    record = tables.run_record(df, "t", F.lit(RUN), 7)
    assert tuple(record.first()) == ("t", RUN, 7, 5)
    log = f"{storage.new_folder(spark, 'runs')}/log"
    assert tables.append_run(record, log).count() == 1 and tables.append_run(record, log).count() == 1
    assert tables.append_run(tables.run_record(df, "u", F.lit(RUN)), log).count() == 2


def test_quotas_and_quartiles(spark):
    r = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, h)) for h in range(6)], "ip string, ts timestamp")
    assert history.admit(r, 5).count() == 5
    q = reports.quartiles(spark.createDataFrame([(x,) for x in (5, 1, 9, 7, 3)], "v int"), "v").first()
    assert (q["q1"], q["q2"], q["q3"], q["least"], q["most"]) == (3, 5, 7, 1, 9)


def test_operators_read_past_the_400th_character(spark, tmp_path):
    from newswell.plans import catalog

    path = str(tmp_path)
    spark.createDataFrame([(2, "Title\n" + "x " * 300 + "leaux inger", "en", "s", 616)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    q = catalog.queries()
    for name in ("j12_entity_mentions",):
        assert {r["entity_id"] for r in q[name](spark, path).collect()} == {"inger", "leaux"}
    assert [r["ord"] for r in q["p17_search"](spark, path).collect()] == [2]


def test_pairs_by_sequence_match_brute_force(spark, monkeypatch):
    import random
    from difflib import SequenceMatcher

    monkeypatch.setattr(cluster, "TILE_TITLES", 16, raising=False)
    rng = random.Random(4)
    words = ["acmecorp", "unveils", "lawyerbot", "court", "rules", "on", "model", "data", "tax", "ai"]
    titles = ["acmecorp unveils lawyerbot", "xacmecorp unveilsx lawyerbots", "ab cd ef gh", "abx cdx efx gh", "AI"]
    for _ in range(45):
        base = " ".join(rng.choice(words) for _ in range(rng.randint(1, 5)))
        titles += [base, "".join(c + rng.choice("xyz") if rng.random() < 0.15 else c for c in base)]
    rows = [(k, x, "", f"s{k}", RUN - dt.timedelta(days=rng.randint(0, 20)), "2026-05-20") for k, x in enumerate(titles)]
    df = spark.createDataFrame(rows, "ord long, title string, summary string, source string, published_at timestamp, date_raw string")
    tok = {r["ord"]: set(r["t"]) for r in df.select("ord", text.tokens(F.col("title")).alias("t")).collect()}
    head = {r["ord"]: r["h"] for r in df.select("ord", text.head_token(F.col("title")).alias("h")).collect()}
    want = set()
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if abs(rows[a][4] - rows[b][4]) <= dt.timedelta(days=7) and tok[a] and tok[b]:
                j = len(tok[a] & tok[b]) / len(tok[a] | tok[b])
                base = max(j, 0.6 * SequenceMatcher(None, titles[a].lower(), titles[b].lower()).ratio() + 0.4 * j)
                if base >= 0.5 or (base >= 0.25 and head[a] and head[a] == head[b]):
                    want.add((a, b))
    assert {(r["a"], r["b"]) for r in cluster.duplicate_pairs(df, F.lit(RUN)).collect()} == want and len(want) > 100


def test_clusters_by_sequence(spark, tmp_path):
    from newswell.plans import catalog

    rows = [(30, "acmecorp unveils lawyerbot"), (61, "xacmecorp unveilsx lawyerbots"), (91, "nothing alike here")]
    spark.createDataFrame([(i, x + "\nbody", "en", f"s{i}", len(x)) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    q = catalog.queries()
    assert {tuple(r) for r in q["a01s_components_by_sequence"](spark, str(tmp_path)).collect()} == {(30, 30), (61, 30), (91, 91)}
    assert sorted((r["ord"], r["related_count"]) for r in q["a02s_clusters_by_sequence"](spark, str(tmp_path)).collect()) in ([(30, 1), (91, 0)], [(61, 1), (91, 0)])


def test_cards_of_all_documents_are_resolved(spark, tmp_path):
    from newswell.plans import catalog

    rows = [(i, f"title {i}", "en", "s", 9) for i in (1, 2, 4, 7, 8, 11)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    q = catalog.queries()
    assert {r["ord"] for r in q["j05_resolve_citations"](spark, str(tmp_path)).collect()} == {1, 2, 4, 7, 8, 11}


def test_open_graph_query_gives_the_tags(spark, tmp_path):
    from newswell.plans import catalog

    html = '<title>plain</title><meta property="og:title" content="A &amp; B"><meta property="og:description" content="told">'
    spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert [tuple(r) for r in catalog.queries()["s06_open_graph"](spark, str(tmp_path)).collect()] == [(1, "plain", "A & B", "told")]


def test_verbs_of_the_summary_count(spark):
    """Title patterns come first; then two verbs anywhere in title and summary cap the score."""
    lex = Lexicon({"ai": ("ai", "llm", "model"), "pr_verbs": ("unveils", "signs", "hosts"), "pr_block": ("[Board]",), "pr_cap": ("Notice",), "pr_opinion": ("Column",), "pr_series": ("Firm news",)})
    rows = [("Acme signs", "and hosts", "cap", 30), ("Acme signs", "and hosts an ai llm model day", "cap", 45), ("Acme signs", "nothing more", "pass", None), ("[Board] Acme", "", "block", None), ("Notice: Acme", "", "cap", 25), ("Column: Acme", "", "cap", 28), ("Column: Acme", "ai llm model", "pass", None), ("Firm news", "", "block", None), ("Firm news", "ai llm model", "pass", None), (None, None, "pass", None)]
    df = spark.createDataFrame([r[:2] for r in rows], "title string, summary string")
    got = df.select(classify.pr_verdict(F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")), lex).alias("v")).select("v.*").collect()
    assert [tuple(r) for r in got] == [r[2:] for r in rows]


def test_large_catalogs_find_the_same(spark, monkeypatch):
    import random

    rng = random.Random(2)
    docs = spark.createDataFrame([(k, "".join(rng.choice("ab c1.") for _ in range(40)) if k else None) for k in range(200)], "ord int, t string")
    catalog = [(f"e{k}", tuple({"".join(rng.choice("ab c") for _ in range(rng.randint(1, 4))).strip() or "a" for _ in range(3)})) for k in range(20)]
    small = sorted(map(tuple, graph.entity_mentions(docs, catalog, F.col("t"), "ord").collect()))
    monkeypatch.setattr(graph, "UNROLLED", 0)
    assert sorted(map(tuple, graph.entity_mentions(docs, catalog, F.col("t"), "ord").collect())) == small and len(small) > 300


def test_names_resolve_by_containment(spark):
    catalog = spark.createDataFrame([("e1", "acme", 0), ("e2", "acme corp", 1), ("e3", "zed", 2), ("e4", "io", 3)], "entity_id string, alias string, ord int")
    names = ["Acme", "Acme Corporation", "corp", "IO", "radio", "zed ai", "none", "c", ""]
    want = {}
    for n in names:
        k = n.lower()
        exact = [e for e, a, _ in (("e1", "acme", 0), ("e2", "acme corp", 1), ("e3", "zed", 2), ("e4", "io", 3)) if a == k]
        near = [e for e, a, _ in (("e1", "acme", 0), ("e2", "acme corp", 1), ("e3", "zed", 2)) if k and (a in k or k in a)]
        want[n] = (exact or near or [None])[0]
    got = graph.resolve_names(spark.createDataFrame([(n,) for n in names], "name string"), catalog).collect()
    assert {r["name"]: r["entity_id"] for r in got} == want


def test_revalidation_drops_and_rescores(spark):
    schema = "ord int, title string, summary string, source string, source_type string, url string, published_at timestamp, categories array<string>, persona_score int, score int"
    rows = [(1, "Court rulings opened", "ai and llm " * 20, "s", "rss", "u", None, ["domestic", "legaltech"], 5, 3), (2, "[Board] AI", "ai", "s", "rss", "u", None, [], 9, 80), (3, "Garden", "flowers", "s", "rss", "u", None, [], None, 70)]
    out = {r["ord"]: r for r in classify.revalidate(spark.createDataFrame(rows, schema), LEX, F.lit(RUN)).collect()}
    assert out[1]["kept"] and out[1]["rescored"] and out[1]["categories"] == ["legaltech"] and not out[2]["kept"] and not out[3]["kept"]
    c = classify.revalidation_counts(classify.revalidate(spark.createDataFrame(rows, schema), LEX, F.lit(RUN))).first()
    assert (c["dropped"], c["rescored"]) == (2, 2)


def test_envelopes_and_salvaged_lists(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"built": "x",\n "items": [{"url": "u", "score": 3},\n {"url": "v"}]}')
    rows = payloads.read_first_existing(spark, [f"{tmp_path}/no", f"{tmp_path}/a.json"], "url string, score int").collect()
    assert [(r["url"], r["score"]) for r in rows] == [("u", 3), ("v", None)]
    assert payloads.read_envelope(spark, f"{tmp_path}/none", "url string").count() == 0
    answers = ['[{"a":"x } y"},{"b":{"c":1}},{"d', 'so [1] then {"a":1}', 'x {"a":1} [2]', "```\n{\"a\":1}\n```", None, "[1,2", '{"a":']
    got = [r[0] for r in spark.createDataFrame([(x,) for x in answers], "c string").select(payloads.lenient_object(F.col("c"))).collect()]
    assert got == ['[{"a":"x } y"},{"b":{"c":1}}]', "[1]", '{"a":1}', '{"a":1}', None, None, None]


def test_streamed_merge_keeps_annotations(spark, tmp_path):
    from newswell.streaming import streams

    schema = "url string, title string, published_at timestamp, first_seen timestamp, date_unknown boolean, entities array<string>, ord int"
    t = lambda d: RUN - dt.timedelta(days=d)
    prev = spark.createDataFrame([("a", "old", t(2), t(2), False, ["E"], 1), ("b", "gone", t(40), t(40), False, None, 2)], schema)
    for k, rows in enumerate(([("a", "new", t(1), t(1), False, None, 3)], [("c", "fresh", t(0), t(0), False, None, 4), ("a", "newest", t(0), t(0), True, None, 5)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    out = {r["url"]: r for r in streams.stream_merge_articles(stream, prev, F.lit(RUN)).collect()}
    assert set(out) == {"a", "c"} and out["a"]["entities"] == ["E"] and out["a"]["first_seen"] == t(2) and out["a"]["published_at"] in (t(0), t(1))
    stored = spark.createDataFrame([("a", None, t(0), True), ("b", t(1), t(1), False), ("c", t(5), t(1), False)], "url string, published_at timestamp, first_seen timestamp, date_unknown boolean")
    batch = spark.createDataFrame([("a", t(3), False, 1), ("b", t(4), False, 2), ("c", t(9), False, 3)], "url string, published_at timestamp, date_unknown boolean, ord int")
    fixed = {r["url"]: (r["published_at"], r["corrected"]) for r in streams.late_corrections(stored, batch).collect()}
    assert fixed == {"a": (t(3), True), "b": (t(4), True), "c": (t(5), False)}


def test_entities_equal_the_standard_decoder(spark):
    import html
    import random

    rng = random.Random(9)
    parts = ["&", "#", "x", "1", "50", "8217", "amp", ";", "lt", "gt", "nbsp", "rsquo", "copy", "not", "in", " ", "A", "é", "hellip", "&#x", "&#", "128", "9f", "quot"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(800)] + [None, "", "plain", "&;", "&&amp;&"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, c string").select("k", text.unescape(F.col("c")).alias("x")).collect()
    assert [r["x"] for r in sorted(rows)] == [None if t is None else html.unescape(t) for t in texts]


def test_an_empty_summary_or_date_is_a_missing_one(spark):
    e = spark.createDataFrame([("T", "http://x/1", "", "told", " ", "Wed, 1 Feb 2024 09:00:00 +0900"), ("U", "http://x/2", None, None, None, None)], "title string, link string, summary string, description string, published string, pubDate string")
    got = sorted(payloads.normalise_feed(e, F.lit("s"), F.lit("rss"), F.lit("en"), F.lit(RUN)).select("title", "summary", "date_unknown").collect())
    assert [tuple(r) for r in got] == [("T", "told", False), ("U", "", True)]


def test_works_of_one_id_are_chosen_by_citations(spark):
    schema = "id string, title string, display_name string, publication_date string, doi string, cited_by_count int, open_access struct<oa_url:string>, primary_location struct<landing_page_url:string,source:struct<display_name:string>>, authorships array<struct<author:struct<display_name:string>>>, abstract_inverted_index map<string,array<int>>"
    works = spark.createDataFrame([("w", t, None, "2026-05-20", None, n, None, None, None, None) for t, n in (("b", 3), ("a", 12), ("c", None), ("d", 12))], schema)
    assert [r["title"] for r in payloads.scholarly_works(works, F.lit(RUN)).collect()] == ["a"]


def test_one_of_two_writers_wins_and_versions_can_be_found(spark):
    from newswell.sources.snapshots import SnapshotConflict, SnapshotTable

    t, other = (SnapshotTable(spark, "t", f) for f in [storage.new_folder(spark, "tables")] * 2)
    assert t.latest() == 0 and t.write(spark.range(3), built_at="2024-01-01T00:00:00") == 1
    seen = other.latest()
    assert t.write(spark.range(5), expect=seen, built_at="2024-01-03T00:00:00") == 2
    with pytest.raises(SnapshotConflict):
        other.write(spark.range(9), expect=seen)
    assert other.latest() == 2 and other.read().count() == 5 and other.read(1).count() == 3 and other.backup_of() == 1
    assert other.read(as_of="2024-01-02T00:00:00").count() == 3 and other.restore(1) == 3 and t.read().count() == 3
    assert [tuple(r)[:2] + (r["restores"],) for r in t.history().orderBy("version").collect()] == [(1, 0, None), (2, 1, None), (3, 2, 1)]
    with pytest.raises(LookupError):
        t.read(as_of="2023-01-01T00:00:00")
    assert len(t.log.versions()) == 3  # the loser left no entry behind


def test_a_batch_rewrites_only_what_it_changes(spark):
    from newswell.streaming.merged import MergedTable

    t = MergedTable(spark, storage.new_folder(spark, "merged"), ["k"], buckets=16, most_layers=3)
    take = lambda present, new: new.unionByName(present.join(new, "k", "left_anti"))
    rows = lambda *ids: spark.createDataFrame([(k, v) for k, v in ids], "k long, v string")
    assert t.apply(rows(*((k, "a") for k in range(400))), take, 0)["written"] == 400
    assert t.apply(rows((7, "b"), (900, "n"), (8, "a")), take, 1) == {"buckets": 3, "written": 2, "compacted": 0}
    assert t.apply(rows((7, "z")), take, 1) == {"buckets": 0, "written": 0, "compacted": 0}  # the batch was there already
    assert t.apply(rows((7, "c")), lambda present, new: present.where("k <> 7"), 2)["written"] == 1
    got = {r["k"]: r["v"] for r in t.read().collect()}
    assert len(got) == 400 and 7 not in got and got[900] == "n" and got[8] == "a"
    out = t.apply(rows((7, "d")), take, 3)
    assert out["compacted"] == 1 and out["written"] < 60
    assert {r["k"]: r["v"] for r in t.read().collect()} == got | {7: "d"}
    assert t.apply(rows((None, "x")), take, 4)["written"] == 0 and t.read().count() == 401


def test_feeds_of_three_kinds_from_bytes(spark):
    bodies = {
        "rss": '<rss xmlns:dc="d"><channel><title>c</title><item><title>A</title><link>http://x/1</link><description/><dc:date>2024-01-31</dc:date><author>q</author></item><item><title>B</title></item></channel></rss>',
        "atom": '<feed xmlns="a"><title>f</title><entry><title type="html">C</title><link rel="edit" href="http://e"/><link href="http://x/2"/><author><name>N</name></author><author><name>M</name></author><category term="cs.AI"/><updated>2024-01-31T00:00:00Z</updated></entry></feed>',
        "empty": "<rss><channel/></rss>",
        "cut": "<rss><channel><item><title>D</title><li",
        "none": None,
        "text": "not a feed",
    }
    landed = spark.createDataFrame(list(bodies.items()), "source string, body string")
    entries = payloads.feed_entries(landed)
    got = {(r["source"], r["title"], r["link"], tuple(r["authors"] or ()), tuple(r["tags"] or ())) for r in entries.where("title IS NOT NULL AND NOT broken").collect()}
    assert {g[:3] for g in got} == {("rss", "A", "http://x/1"), ("rss", "B", None), ("atom", "C", "http://x/2")}
    assert ("atom", "C", "http://x/2", ("N", "M"), ("cs.AI",)) in got
    status = {r["source"]: (r["status"], r["count"]) for r in payloads.feed_status(landed, entries).collect()}
    assert status == {"rss": ("active", 1), "atom": ("active", 1), "empty": ("idle", 0), "cut": ("error", 0), "none": ("error", 0), "text": ("error", 0)}
    arts = payloads.normalise_feed(entries.where("source = 'rss'"), F.col("source"), F.lit("rss"), F.lit("en"), F.lit(RUN)).collect()
    assert [(r["title"], r["date_unknown"]) for r in arts] == [("A", False)]


def test_names_resolve_by_containment_in_any_block(spark, monkeypatch):
    import random

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 7)))
    catalog = [(f"e{k % 9}", word(), k) for k in range(40)] + [("x", "abc", 3), ("w", "abc", 3)]
    names = [word().upper() for _ in range(150)] + ["", None, "zzz"]
    want = {}
    for n in names:
        k = (n or "").lower()
        same = [(o, e) for e, a, o in catalog if a == k]
        near = [(o, e) for e, a, o in catalog if len(a) >= 3 and (a in k or k in a)] if k else []
        want[n] = min(same or near, default=(0, None))[1]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    table = spark.createDataFrame(catalog, "entity_id string, alias string, ord int")
    for size in (50_000, 7):
        monkeypatch.setattr(graph, "BLOCK_ALIASES", size)
        assert {r["name"]: r["entity_id"] for r in graph.resolve_names(df, table).collect()} == want


def test_period_table_function(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 12, 30, 5)), (2, None)], "k int, at timestamp")
    assert sorted((r["k"], r["period"], r["key"]) for r in dates.fan_out(df, "at").collect()) == [(1, "daily", "2024-12-30"), (1, "monthly", "2024-12"), (1, "weekly", "2025-W01")]
    assert spark.sql("SELECT key FROM period_keys(TIMESTAMP'2024-01-31 00:00:00') WHERE period = 'weekly'").first()[0] == "2024-W05"
    plan = dates.fan_out(df, "at")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Join" not in plan


def test_quota_state_survives_a_restart_and_is_freed(spark, tmp_path):
    from newswell.streaming import streams

    at = lambda day, h: dt.datetime(2024, 1, day, h)
    land = lambda name, rows: spark.createDataFrame(rows, "ip string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    def run():
        stream = spark.readStream.schema("ip string, ts timestamp").option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        with streams.state_store(spark, streams.STATE_STORE):
            streams.stream_quota(stream, 3).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
        out = {}
        for r in spark.read.schema("ip string, day string, admitted long").parquet(f"{tmp_path}/out").collect():
            out[r["ip"], r["day"]] = out.get((r["ip"], r["day"]), 0) + r["admitted"]
        return out

    land("a", [("x", at(1, 1)), ("x", at(1, 2)), ("y", at(1, 3)), (None, at(1, 3))])
    assert run() == {("x", "2024-01-01"): 2, ("y", "2024-01-01"): 1}
    land("b", [("x", at(1, 5)), ("x", at(1, 6)), ("x", at(2, 6))])
    assert run() == {("x", "2024-01-01"): 3, ("x", "2024-01-02"): 1, ("y", "2024-01-01"): 1}
    land("c", [("z", at(9, 1))])
    run()
    land("d", [("z", at(9, 2))])
    assert run()["z", "2024-01-09"] == 2
    left = spark.read.format("statestore").option("stateVarName", "used").load(f"{tmp_path}/check").collect()
    assert len(left) == 1  # the day of z; those of x and y are freed


def test_abstracts_are_inverted_without_a_shuffle(spark, tmp_path):
    from newswell.plans import catalog

    texts = ["b a b  c", "", None, "a", "x y " * 500 + "z"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = catalog.queries()["f17_rebuild_abstract"](spark, str(tmp_path))
    assert {r["doc_id"]: r["abstract"] for r in out.collect()} == dict(enumerate(texts))  # a missing text keeps its row
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert one(spark, ["b", "a", "b"], text.inverted, "array<string>") == {"a": [1], "b": [0, 2]} and one(spark, [], text.inverted, "array<string>") == {}


def test_late_corrections_keep_articles_without_an_address_and_store_no_texts(spark, tmp_path):
    from newswell.streaming import streams

    day = lambda n: dt.datetime(2024, 1, n)
    schema = "url string, ord long, published_at timestamp, date_unknown boolean, first_seen timestamp, title string"
    kept = spark.createDataFrame([("u", 1, day(9), True, day(9), "long text"), ("v", 2, day(5), False, day(9), "b"), (None, 3, day(9), True, day(9), "c")], schema)
    spark.createDataFrame([("u", 7, day(8), False), ("v", 8, day(8), False)], "url string, ord long, published_at timestamp, date_unknown boolean").write.parquet(f"{tmp_path}/in")
    stream = streams.read_stream(spark, f"{tmp_path}/in")
    made = []
    applied = streams.MergedTable.apply

    def apply(self, batch, *args, **more):
        made.append(batch.columns)
        return applied(self, batch, *args, **more)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(streams.MergedTable, "apply", apply)
        out = streams.stream_late_corrections(stream, kept)
        got = {(r["ord"], r["published_at"].day, r["date_unknown"], r["title"], r["corrected"]) for r in out.collect()}
    assert got == {(1, 8, False, "long text", True), (2, 5, False, "b", False), (3, 9, True, "c", False)}
    assert len(made) == 2 and not any("title" in c for c in made)


def test_a_sender_of_many_days_asks_the_state_a_few_times():
    import pandas as pd

    from newswell.streaming.streams import Quota

    calls = []

    class Value:
        kept = None

        def get(self):
            calls.append("get")
            return self.kept

        def update(self, x):
            calls.append("update")
            self.kept = x

    class Handle:
        def getValueState(self, *_):
            return value

        def registerTimer(self, at):
            calls.append("timer")

    class Times:
        def getCurrentWatermarkInMs(self):
            return 0

    value, quota = Value(), Quota(2)
    quota.init(Handle())
    days = [f"2024-01-{k:02d}" for k in range(1, 31)]
    (first,) = quota.handleInputRows(("x",), iter([pd.DataFrame({"day": days}), pd.DataFrame({"day": days[:3]})]), Times())
    assert first["admitted"].tolist() == [2, 2, 2] + [1] * 27 and calls == ["get", "update", "timer"]
    (second,) = quota.handleInputRows(("x",), iter([pd.DataFrame({"day": days * 2})]), Times())
    assert second["admitted"].tolist() == [0, 0, 0] + [1] * 27 and calls[3:] == ["get", "update"]

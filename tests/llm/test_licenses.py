import re

from newswell.llm import licenses
from newswell.llm.decontam import words_of
from newswell.llm.shared import steps
import pyarrow as pa

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def test_automaton_gives_matching_statistics():
    sequences = [[1, 2, 3, 1, 2], [2, 3, 4], [5, 1, 2, 3]]
    auto = licenses.Automaton(sequences, 1)
    text = [1, 2, 3, 4, 9, 2, 3, 1, 2, 5, 1, 2, 3, 4, 1]
    inside = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for at, (state, length) in enumerate(auto.stream(text), 1):
        assert length == max([n for n in range(at + 1) if n == 0 or tuple(text[at - n : at]) in inside])
        places = {(k, e) for k, s in enumerate(sequences) for e in range(length, len(s) + 1) if length and s[e - length : e] == text[at - length : at]}
        assert set(auto.where[state]) == places or not length


def test_phrases_match_brute_force_and_templates_are_found(documents, corpus):
    mit = licenses.TEMPLATES[2][1]
    broken = mit.replace("without limitation", "with no limit")
    rows = [*corpus, (70, "CC BY-NC 4.0, cc by cc, by"), (71, "x General Public\nLicense. All rights reserved"), (72, f"// start\n{broken}\nend " + "z " * 200), (73, "of the Software without restriction the rights to use"), (74, None)]
    got = licenses.scan_licenses(documents(rows)).collect()
    assert len(got) == len(rows)
    for r, (i, t) in zip(sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_words"])), sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, len(split(x[1]))))):
        w = split(t)
        want = sorted((lab, k) for p, lab in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        assert r["n_words"] == len(w) and sorted((x["label"], x["first_word"]) for x in r["phrases"]) == want
    by = {r["doc_id"]: r for r in got}
    assert {x["label"] for x in by[72]["spans"]} == {"mit"} and by[72]["spans"][0]["cover"] > 0.9
    assert not by[73]["spans"] and not by[0]["spans"] and not by[50]["phrases"]


def test_spans_hold_the_template():
    scanner = licenses.Scanner()
    text = "a b c Released under the MIT License and more"
    for _, step in steps(pa.array([text])):
        (doc, base, spans), = scanner.scan(*words_of(step))
    assert [(scanner.labels[k], a, b) for k, a, b, _ in spans] == [("mit", 3, 8)] and not base


def test_empty_and_clashing(documents, clashing, corpus):
    assert licenses.scan_licenses(documents([])).count() == 0
    assert licenses.scan_licenses(clashing).count() == len(corpus)


def test_one_word_phrases_and_all_spans_of_a_template(documents):
    words = [f"t{k}" for k in range(50)]
    near = " ".join(words[:20] + ["x"] + words[21:])
    for text in (f"{near} q q q q q q q q q q {' '.join(words)}", f"{' '.join(words)} q q q q q q q q q q {near}"):
        (r,) = licenses.scan_licenses(documents([(1, f"{text} Copyleft")]), (("tpl", " ".join(words)), ("one", "zzz")), {"copyleft": "left"}).collect()
        assert [(x["label"], x["first_word"]) for x in r["phrases"]] == [("left", 110)]
        assert [(x["first_word"], x["end_word"]) for x in r["spans"]] == [(0, 50), (60, 110)] and {x["label"] for x in r["spans"]} == {"tpl"}
    (r,) = licenses.scan_licenses(documents([(1, "a zzz b")]), (("one", "zzz"),), {"copy left": "left"}).collect()
    assert [(x["label"], x["first_word"], x["end_word"], x["cover"]) for x in r["spans"]] == [("one", 1, 2, 1.0)]


def test_spans_match_brute_force():
    """Copies of templates with changed words: found when and only when the words that still stand in order cover enough."""
    import random

    rng = random.Random(6)
    words = [f"t{k}" for k in range(30)]
    scanner = licenses.Scanner((("tpl", " ".join(words)),), {"zz top": "z"})
    for n in range(0, 16):
        changed = rng.sample(range(30), n)
        own = [f"u{k}" if k in changed else w for k, w in enumerate(words)]
        runs, gap, covered = [], 0, 0
        for w in [*own, "end"]:  # runs of two words or more count; a gap of at most MOST_GAP joins them
            if w[0] == "t":
                gap += 1
            else:
                runs.append(gap)
                gap = 0
        covered = sum(r for r in runs if r >= licenses.LEAST_MATCH)
        for _, step in steps(pa.array(["a b " + " ".join(own) + " c"])):
            got = list(scanner.scan(*words_of(step)))
        spans = got[0][2] if got else []
        if covered >= 0.8 * 30:
            assert len(spans) == 1 and abs(spans[0][3] - covered / 30) < 1e-9
        else:
            assert not spans


def test_query_columns_against_sql(spark, documents, corpus, tmp_path):
    import duckdb

    rows = [(i, t) for i, t in corpus if i not in (None, 40, 41)] + [(70, "CC BY-NC 4.0, cc by cc, by"), (71, "x General Public\nLicense. All rights reserved"), (72, licenses.TEMPLATES[2][1])]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = licenses.op4_license_scan(spark, str(tmp_path)).toPandas().sort_values("doc_id")
    sql = """WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
    p(phrase, label) AS (VALUES (['cc', 'by'], 'cc-by'), (['general', 'public', 'license'], 'gpl'), (['all', 'rights', 'reserved'], 'reserved')),
    h AS (SELECT doc_id, label, i FROM w, p, range(1, len(ws) + 1) r(i) WHERE ws[i:i + len(phrase) - 1] = phrase)
    SELECT doc_id, len(ws)::BIGINT AS n_words, count(i) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels FROM w LEFT JOIN h USING (doc_id) GROUP BY ALL ORDER BY doc_id"""
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = c.execute(sql).df()
    assert got[want.columns].fillna(-1).values.tolist() == want.fillna(-1).values.tolist()
    by = {r["doc_id"]: r for r in got.to_dict("records")}
    assert by[72]["labels"] == "mit" and by[72]["score"] == 1.0 and by[72]["n_base"] == 0 and by[0]["labels"] == "" and by[0]["score"] == 0.0
    assert by[70]["labels"] == "cc-by,cc-by-nc-4.0" or by[70]["labels"] == "cc-by"

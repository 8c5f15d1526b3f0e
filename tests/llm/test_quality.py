import re
from collections import Counter

from newswell.llm import quality
from newswell.llm.quality import MEASURES, RULES, Rule, ordered


def brute(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    covered = {i + k for i in range(len(ws) - 2) if grams[tuple(ws[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_measures_match_brute_force(documents, corpus):
    rows = [*corpus, (70, "a#b\na#b\n\n a#b\n*"), (71, "!!! NO NO NO " * 30), (72, "x y z x y z")]
    got = quality.quality_rules(documents(rows), measures=True).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], *(r[m] for m in MEASURES)) for r in got if r["doc_id"] is not None) == sorted((False, i, *brute(t)) for i, t in rows if i is not None)
    assert len(got) == len(rows)
    for r in got:
        base = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert not (base and r["kept"])
        assert r["kept"] == (r["rejected_by"] is None)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[0]["kept"] and not by_id[71]["kept"] and not by_id[51]["kept"] and not by_id[32]["kept"]


def test_order_never_changes_the_verdict(documents):
    df = documents()
    a = quality.quality_rules(df, RULES)
    b = quality.quality_rules(df, RULES[::-1], sample_rows=3)
    key = lambda rows: sorted((str(r["doc_id"]), r["text"] or "", r["kept"]) for r in rows)
    assert key(a.collect()) == key(b.collect())


def test_order_is_by_rejections_per_cost():
    rules = tuple(Rule(n, None) for n in "abc")
    figures = [{"rule": "a", "ns": 1000, "seen": 10, "rejected": 1}, {"rule": "b", "ns": 1000, "seen": 10, "rejected": 9}, {"rule": "c", "ns": 10, "seen": 10, "rejected": 1}]
    assert [r.name for r in ordered(rules, figures)] == ["c", "b", "a"]


def test_empty_and_clashing(documents, clashing):
    assert quality.quality_rules(documents([]), measures=True).count() == 0
    out = quality.quality_rules(clashing)
    assert out.columns == [c for c in clashing.columns if c != "kept"] + ["kept", "rejected_by"]
    assert out.count() == clashing.count() and dict(out.dtypes)["kept"] == "boolean"


def test_a_rule_sees_only_what_is_left():
    import numpy as np
    import pyarrow as pa
    from newswell.llm.shared import steps

    seen = []

    def rule(name, marks):
        def rejects(f):
            seen.append((name, f.step.docs, f["n_words"].tolist()))
            return np.array([w in marks for w in f["n_words"]])

        return Rule(name, rejects)

    (_, step), = steps(pa.array(["a", "b b", "c c c", "d d d d", "e e e e e"]))
    f = quality.Features(step)
    assert f["words"].counts.tolist() == [1, 2, 3, 4, 5]
    out = quality.cascade(f, (rule("x", {2}), rule("y", {1, 5}), rule("z", {3})))
    assert out.tolist() == [1, 0, 2, -1, 1]
    assert seen == [("x", 5, [1, 2, 3, 4, 5]), ("y", 4, [1, 3, 4, 5]), ("z", 2, [3, 4])]


def test_query_columns(spark, documents, corpus, tmp_path):
    rows = [(i, t) for i, t in corpus if i not in (None, 40, 41)] + [(71, "!!! NO NO NO " * 30)]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in quality.op1_quality_rules(spark, str(tmp_path)).collect()}
    for i, t in rows:
        n, chars, symbols, dup, repeat = brute(t)
        assert (got[i]["n_words"], got[i]["word_chars"], got[i]["n_symbols"], got[i]["n_dup_lines"], got[i]["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        assert got[i]["base_failed"] == (n < 50 or 100 * repeat > 50 * n) and not (got[i]["base_failed"] and got[i]["kept"])
    assert not got[71]["kept"] and got[0]["kept"]

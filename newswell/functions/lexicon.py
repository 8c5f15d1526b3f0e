"""Term lists as data: which words count for what is a parameter of every operator that looks for words."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from newswell.functions.terms import TermIndex

#: Terms of all lists of a lexicon, at most.
MOST_TERMS = 100_000
#: Categories in order of priority.
CATEGORIES = ("papers", "legaltech", "gov_policy", "funding", "adoption", "governance", "policy", "models", "market", "coding", "infra", "product", "ai-industry")
#: Bonus of each category in the importance score.
CATEGORY_BONUS = {"legaltech": 16, "papers": 8, "funding": 6, "models": 10, "coding": 7, "infra": 7}
#: Relation types, and those without a direction.
RELATIONS = ("competes_with", "partners_with", "acquires", "invests_in", "regulates", "adopts", "launches", "implements", "mentions")
SYMMETRIC = ("competes_with", "partners_with", "mentions")


#: Automata of each lexicon by kind of text, beside the lexicon itself.
_MADE: dict[int, tuple] = {}


@dataclass(frozen=True)
class Lexicon:
    """Named term lists in order; ``weights`` holds those of weighted lists."""

    lists: dict[str, tuple[str, ...]] = field(default_factory=dict)
    weights: dict[str, dict[str, float]] = field(default_factory=dict)

    def __getitem__(self, name: str) -> tuple[str, ...]:
        return self.lists.get(name, ())

    def weight(self, name: str) -> dict[str, float]:
        return self.weights.get(name, {})

    def first(self, *names: str) -> tuple[str, ...]:
        """The first of some lists that is there."""
        return next((self.lists[n] for n in names if n in self.lists), ())

    def terms(self, kind: str) -> TermIndex:
        """The lists that are looked for together in one kind of text, as one automaton that is made once."""
        made = _MADE.setdefault(id(self), (self, {}))[1]
        if kind not in made:
            low = lambda name: tuple(t.lower() for t in self[name])
            if kind == "text":  # lower case
                lists = {n: self[n] for n in ("boilerplate", "guard", "strong", "ai", "legal", "law", "global", "policy", "super", "core_law", "basic_law", "conditional_law")}
                lists["blacklist"] = tuple(t for t in self["blacklist"] if t not in self["political"])
                lists["ai_counts"] = self.first("ai_counts", "ai")
                lists["ai_core"] = tuple(t.lower() for t in self.first("ai_core", "ai"))
                lists["pr_verbs"] = low("pr_verbs")
                categories = {f"cat_{c}": low(f"cat_{c}") for c in CATEGORIES if self[f"cat_{c}"]}
                made[kind] = TermIndex(lists | categories, totals=("ai_counts",), words=categories)
            elif kind == "title":
                made[kind] = TermIndex({n: self[n] for n in ("political", "promo")})
            elif kind == "matched":  # lower case, marks as blanks
                lists = {n: low(n) for n in ("decision", "regulatory", "market", "score_legal", "negative", "bookmark_entities", "bookmark_keywords")}
                weights = {n: {t.lower(): w for t, w in self.weight(n).items()} for n in ("bookmark_entities", "bookmark_keywords")}
                lists |= {n: tuple(weights[n]) for n in weights}
                lists |= {n: self[n] for n in ("super", "basic_law", "conditional_law")}
                lists["ai_mentions"] = self.first("ai_mentions", "ai")
                made[kind] = TermIndex(lists, totals=("ai_mentions",), weights=weights)
            else:
                made[kind] = TermIndex({"promo": self["promo"]})
        return made[kind]

    @classmethod
    def from_rows(cls, rows) -> Lexicon:
        """From rows of ``list_name, term, weight, ord``."""
        lists: dict[str, list[str]] = {}
        weights: dict[str, dict[str, float]] = {}
        for r in sorted(rows, key=lambda r: (r["list_name"], r["ord"])):
            lists.setdefault(r["list_name"], []).append(r["term"])
            if r["weight"] is not None:
                weights.setdefault(r["list_name"], {})[r["term"]] = r["weight"]
        return cls({k: tuple(v) for k, v in lists.items()}, weights)

    @classmethod
    def from_table(cls, df: DataFrame) -> Lexicon:
        """From a lexicon table ``list_name, term, weight, ord``, of ``MOST_TERMS`` rows at most: it is read to the driver and sent to the workers."""
        if df.limit(MOST_TERMS + 1).count() > MOST_TERMS:
            raise ValueError(f"a lexicon has at most {MOST_TERMS} terms")
        return cls.from_rows(df.select("list_name", "term", "weight", "ord").collect())

    @classmethod
    def from_json(cls, text: str) -> Lexicon:
        return cls.from_rows([{"weight": None, **r} for r in json.loads(text)])


#: Lists of words that occur in the sample tables, for the registered queries.
DEMO = Lexicon(
    {
        "boilerplate": ("all rights reserved",),
        "blacklist": ("trash", "worthless"),
        "political": ("hation",),
        "guard": ("license",),
        "strong": ("licensed under", "inger"),
        "ai": ("thnt", "eren", "leaux"),
        "ai_counts": (" thnt ", "thnt ", "eren", "leaux."),
        "ai_mentions": (" eren", "eren ", "leaux", "thnt"),
        "ai_core": ("thnt", "eren", "leaux", "Inger"),
        "legal": ("license", "rerely", "menté"),
        "pr_block": ("Is ", "De "),
        "pr_cap": ("And ",),
        "pr_opinion": ("The ", "La "),
        "pr_series": ("Of ",),
        "pr_verbs": ("ing", "ed", "tion"),
        "decision": ("ation", "edly", "oueau", "enement"),
        "regulatory": ("reed", "tionan", "rreou", "vien"),
        "market": ("blest", "heron", "ieux", "paré"),
        "score_legal": ("inand", "thle", "laré", "oreda"),
        "negative": ("wham", "trash", "ndust"),
        "law": ("ation", "reed"),
        "global": ("thou", "blest"),
        "policy": ("there", "tions", "there"),
        "promo": ("essh", "ouon"),
        "core_law": ("rerely", "license"),
        "basic_law": ("general public",),
        "conditional_law": ("license", "inthe"),
        "super": ("apache license", "heedth"),
        "cat_legaltech": ("rely", "menti"),
        "cat_policy": ("tion", "auch"),
        "cat_funding": ("onha", "zión"),
        "cat_models": ("erst", "euxm"),
        "cat_papers": ("ndent",),
        "high": ("thera", "leaux", "ingly", "erst"),
        "medium": ("tion", "ment"),
        "stopwords": ("the", "and", "of", "les", "des", "und", "der"),
        "nouns": ("thatly", "inger", "estion", "ément", "ouons"),
        "generic": ("that", "with", "pour"),
    },
    {"bookmark_entities": {"inger": 4, "ouier": 3}, "bookmark_keywords": {"ation": 2, "menté": 3}, "bookmark_sources": {"src1": 3, "src2": 2}},
)

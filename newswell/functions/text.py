"""String functions as Column expressions."""

from __future__ import annotations

import html
import re
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from newswell.session import ship

#: Tracking parameters that are cut from addresses.
TRACKING = r"(utm_[^=]+|fbclid|gclid|mc_cid|mc_eid)"
#: Closing particles, in the order in which they are tried.
PARTICLES = ("로", "은", "는", "이", "가", "의", "을", "를", "에", "에서", "도", "와", "과", "랑")


def quoted(terms) -> str:
    """An alternation of literal terms."""
    return "|".join(re.escape(t).replace("/", "\\/") for t in terms)


def bind(value: Column, f) -> Column:
    """``f(value)`` with ``value`` computed once, however often ``f`` uses it."""
    return F.transform(F.array(value), f)[0]


@cache
def _unescaped():
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else html.unescape(t) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")


def unescape(c: Column) -> Column:
    """HTML character references as characters, each once: all names of the standard, the longest first and some without
    a semicolon, and decimal and hexadecimal numbers, of which those from 128 to 159 mean the characters of Windows-1252.

    Only texts with an ampersand go through Python.
    """
    ship()
    return F.coalesce(_unescaped()(F.when(F.contains(c, F.lit("&")), c)), c)


def clean_text(c: Column) -> Column:
    """Entities unescaped, tags as blanks, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(unescape(c), "<[^>]+>", " "), r"(?U)\s+", " "))


def truncate(c: Column, n: int) -> Column:
    """At most ``n`` characters, cut back to the last blank, with an ellipsis."""
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.regexp_replace(F.substring(c, 1, n), " [^ ]*$", ""), F.lit("…")))


#: Marks that are blanks where terms are looked for.
MARKS = "'\"`·‘’“”«»「」『』"


def match_normalise(c: Column) -> Column:
    """Lower case with quotation marks and middle dots as blanks and white space collapsed; blanks at the ends stay."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, f"[{MARKS}]+", " "), r"(?U)\s+", " "))


def opening(prefixes) -> str:
    """A pattern of headlines that open with one of some literal marks; blanks may stand between the parts of a mark."""
    parts = lambda p: r"\s*".join(re.escape(x) for x in re.findall(r"\w+|[^\w\s]", p)) + (r"\s" if p[-1:].isspace() else "")
    return rf"^\s*(?:{'|'.join(parts(p) for p in prefixes)})"


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_url(c: Column) -> Column:
    """Address without tracking parameters and a closing question mark. A cut parameter takes its ``?`` along."""
    return strip(F.regexp_replace(F.regexp_replace(c, rf"[?&]{TRACKING}=[^&]*", ""), r"\?$", ""))


def strip_particle(c: Column) -> Column:
    """Without the first closing particle that leaves more than one character."""
    out = c
    for p in reversed(PARTICLES):
        out = F.when(F.endswith(c, F.lit(p)) & (F.length(c) > len(p) + 1), F.substring(c, F.lit(1), F.length(c) - len(p))).otherwise(out)
    return out


def tokens(c: Column, stopwords=()) -> Column:
    """Distinct words of more than one character, lower-cased, without stop words and closing particles."""
    words = F.filter(F.split(F.regexp_replace(F.lower(c), r"(?U)[^\w가-힣]+", " "), " "), lambda w: F.length(w) > 1)
    if stopwords:
        words = F.filter(words, lambda w: ~w.isin(*stopwords))
    return F.array_distinct(F.transform(words, strip_particle))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common tokens; 0 where either side has none."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def head_token(c: Column, prefixes=(), brands=()) -> Column:
    """A headline up to its first punctuation, lower-cased, without a bracketed or quoted opening and a company prefix.

    Empty where fewer than three characters are left, unless they are one of ``brands``.
    """
    s = F.regexp_replace(F.regexp_replace(c, r"^\s*\[[^\]]*\]\s*", ""), "^\\s*['\"‘“][^'\"’”]*['\"’”]\\s*[….]*\\s*", "")
    head = F.trim(F.regexp_extract(s, r"^([^,:\[\]()·…]*)", 1))
    if prefixes:
        head = F.trim(F.regexp_replace(head, rf"^(?:{quoted(prefixes)})", ""))
    head = F.lower(head)
    known = head.isin(*brands) if brands else F.lit(False)
    return F.when((F.length(head) >= 3) | known, head).otherwise("")


def fold_replace(c: Column, rules) -> Column:
    """A sequence of ``(pattern, replacement)``."""
    for pattern, to in rules:
        c = F.regexp_replace(c, pattern, to)
    return c


def strip_phrases(c: Column, patterns) -> Column:
    """Without phrases that match in any case; doubled blanks and tabs, and those before punctuation, are mended. Line ends stay."""
    return strip(fold_replace(c, [*((f"(?i){p}", "") for p in patterns), (r"[ \t]{2,}", " "), (r"[ \t]+([.,!?])", "$1")]))


def unbold(c: Column, names=(), longest: int = 6, before: int = 40, after: int = 15) -> Column:
    """Bold marks taken from spans that hold a given name with few characters around it, and from spans of at most ``longest``."""
    rules = [(rf"\*\*([^*\n]{{0,{before}}}?{re.escape(n)}[^*\n]{{0,{after}}}?)\*\*", "$1") for n in names]
    return fold_replace(c, [*rules, (rf"\*\*([^*\n]{{1,{longest}}})\*\*", "$1")])


def emphasise_last(c: Column, longest: int = 150, single_least: int = 10) -> Column:
    """Bold for the last sentence where nothing is bold, its closing marks left outside.

    Sentences end at a mark and a blank. The last one must be short enough, and, if it is the only one, long enough.
    """
    whole = strip(c)
    body = F.regexp_replace(whole, r"[.!? ]+$", "")
    tail = F.substring(whole, F.length(body) + 1, F.length(whole))
    head = F.regexp_extract(body, r"(?s)^(.*[.!?] )", 1)
    last = strip(F.substring(body, F.length(head) + 1, F.length(body)))
    bold = F.concat(head, F.lit("**"), F.when(head == "", body).otherwise(last), F.lit("**"), tail)
    fits = F.when(head == "", F.length(body).between(single_least, longest)).otherwise(F.length(last).between(1, longest))
    return F.when(F.contains(c, F.lit("**")), c).when(fits, bold).otherwise(whole)


def number_breaks(c: Column) -> Column:
    """A paragraph break before ``1) `` to ``9) `` within a text, but not after a point, a bracket or a digit."""
    return F.regexp_replace(c, r"(?U)([^\n.(\d])\s+([1-9]\)\s)", "$1\n\n$2")


def arxiv_id(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"arxiv\.org/(?:abs|pdf)/([0-9]{4}\.[0-9]{4,5})", 1), F.lit(""))


def host(c: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(c, r"^[a-z]+://([^/?#:]+)", 1), r"^(www|m)\.", "")


def outlet(c: Column, lookup: dict[str, str], prefix: str = "Naver / ") -> Column:
    """Outlet of an address: the first entry that its host contains, else the prefix and the host's first label."""
    out = F.concat(F.lit(prefix), F.regexp_extract(host(c), r"^([^.]+)", 1))
    for part, name in reversed(lookup.items()):
        out = F.when(F.contains(host(c), F.lit(part)), F.lit(name)).otherwise(out)
    return out


def inverted(c: Column) -> Column:
    """A map from the words of a list to the list of their positions: equal words are neighbours once the list is sorted."""
    placed = F.sort_array(F.transform(c, lambda w, p: F.struct(w.alias("w"), p.alias("p"))))

    def runs(s: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["w"] != F.get(s, i - 1)["w"]))
        places = lambda i, end: F.transform(F.slice(s, i + 1, end - i), lambda x: x["p"])
        return bind(first, lambda f: F.map_from_entries(F.transform(f, lambda i, k: F.struct(F.get(s, i)["w"], places(i, F.coalesce(F.get(f, k + 1), F.size(s)))))))

    return F.when(F.size(c) > 0, bind(placed, runs)).when(c.isNotNull(), F.create_map().cast("map<string,array<int>>"))


def rebuild_abstract(c: Column) -> Column:
    """Text of a map from words to the list of their positions."""
    places = F.flatten(F.transform(F.map_entries(c), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.sort_array(places), lambda x: x["w"]), " ")


def any_term(c: Column, terms) -> Column:
    """Whether any literal term occurs."""
    return c.rlike(quoted(terms)) if terms else F.lit(False)


def hit_count(c: Column, terms) -> Column:
    """How many of a few terms occur; one that is listed twice counts twice. Long lists: :mod:`newswell.functions.terms`."""
    listed = F.array(*(F.lit(t) for t in terms)) if terms else F.array().cast("array<string>")
    return bind(c, lambda x: F.size(F.filter(listed, lambda t: F.contains(x, t))))


def occurrence_sum(c: Column, terms) -> Column:
    """Occurrences of all terms, each counted without overlaps; terms may share characters."""
    listed = F.array(*(F.lit(t) for t in terms))
    count = lambda x, t: ((F.length(x) - F.length(F.replace(x, t, F.lit("")))) / F.length(t)).cast("int")
    return bind(c, lambda x: F.aggregate(listed, F.lit(0), lambda acc, t: acc + count(x, t)))


def card_key(period: Column, key: Column, tag: Column) -> Column:
    return F.concat_ws("|", period, key, F.substring(tag, 1, 80))


def compact_key(key: Column) -> Column:
    """``2024-01-31``, ``2024-W05``, ``2024-01`` as ``20240131``, ``2024W05``, ``202401``."""
    return F.replace(key, F.lit("-"), F.lit(""))


def expanded_key(key: Column) -> Column:
    return F.when(F.contains(key, F.lit("W")), F.regexp_replace(key, r"^(\d{4})(W\d{2})$", "$1-$2")).when(F.length(key) == 8, F.regexp_replace(key, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")).otherwise(F.regexp_replace(key, r"^(\d{4})(\d{2})$", "$1-$2"))


def is_arxiv(source_type: Column, url: Column) -> Column:
    return (source_type == "arxiv") | F.contains(F.coalesce(url, F.lit("")), F.lit("arxiv.org"))

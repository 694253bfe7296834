"""Text normalisation, terms, stems and derived texts, as column expressions.

Everything here stays in the JVM: no Python runs per row.
"""

from __future__ import annotations

import unicodedata
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorekeep import lexicon as X

SPACES = r"(?U)[\s\x1c-\x1f\x{FEFF}\x{200B}]+"
#: White space other than blanks.
UNEVEN = r"[\x09-\x0d\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: Everything but ASCII and the alphabets up to U+167F: texts without such signs hold no white space but blanks.
UNUSUAL = r"[^\x20-\x7e\xa1-\x{167f}]"
#: What is no letter, digit, underscore or hyphen; frequent letters first, as the class is tried in its order.
_SIGN = r"[^a-z0-9_\-\p{L}\p{N}]"
#: Runs of such signs, other than a blank alone.
SIGNS = rf"[^a-z0-9_ \-\p{{L}}\p{{N}}]{_SIGN}*+| {_SIGN}++"
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
TOKEN = r"[\p{L}\p{N}_]+"
#: Latin letters with marks, and the plain letters: by decomposition, over Latin-1 to Latin Extended-B.
MARKED = [(chr(c), d[0].lower()) for c in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and d[0].isascii()]


def let(value: Column, body) -> Column:
    """``body(x)`` with x evaluated once."""
    return F.transform(F.array(value), body)[0]


def bound(f):
    """f with each of its columns evaluated once: plans grow with the number of uses of a result, not with its size."""

    @wraps(f)
    def g(*args, **more):
        def bind(k: int, done: tuple) -> Column:
            if k == len(args):
                return f(*done, **more)
            if not isinstance(args[k], Column):
                return bind(k + 1, (*done, args[k]))
            return let(args[k], lambda x: bind(k + 1, (*done, x)))

        return bind(0, ())

    return g


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def normalize_space(c: Column) -> Column:
    """White space as single blanks, none at the ends; null is empty. Most texts have nothing to replace."""
    # line ends by bytes; patterns for what is rarer
    even = F.replace(text(c), F.lit("\n"), F.lit(" "))
    rest = lambda x: F.when(x.rlike(UNUSUAL) & x.rlike(UNEVEN), F.regexp_replace(x, SPACES, " ")).when(x.contains("  "), F.regexp_replace(x, "  +", " ")).otherwise(x)
    return F.trim(let(even, rest))


def normalize_tags(c: Column) -> Column:
    """Lower-cased distinct tags in order, without empty ones."""
    clean = F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda t: F.lower(normalize_space(t)))
    return F.array_distinct(F.filter(clean, lambda t: t != ""))


def canonicalize(c: Column) -> Column:
    """Lower case, no apostrophes, other punctuation as blanks; hyphen and underscore stay."""
    return F.trim(F.regexp_replace(_no_apostrophes(F.lower(normalize_space(c))), SIGNS, " "))


def _no_apostrophes(c: Column) -> Column:
    for sign in X.APOSTROPHES:
        c = F.replace(c, F.lit(sign), F.lit(""))
    return c


def _terms(source: Column, least: int, most: int | None) -> Column:
    found = F.regexp_extract_all(source, F.lit(TOKEN), F.lit(0))
    kept = F.array_distinct(F.filter(found, lambda t: (F.length(t) >= least) & ~t.isin(X.STOP_WORDS)))
    return F.slice(kept, 1, most) if most else kept


def semantic_terms(c: Column, most: int | None = None) -> Column:
    """Distinct terms of three letters or more that are no stop words, in order."""
    # the terms of the canonical text: blanks and punctuation part terms as they are. Signs without width may decide how a
    # letter before them is lower-cased, so they become blanks first
    even = let(text(c), lambda x: F.when(x.rlike(r"[\x{FEFF}\x{200B}]"), normalize_space(x)).otherwise(x))
    return _terms(_no_apostrophes(F.lower(even)), 3, most)


def query_terms(c: Column) -> Column:
    """A query's terms: of two letters or more, eight at most; apostrophes part words."""
    return _terms(F.lower(text(c)), 2, X.QUERY_TERMS)


def light_stem(term: Column) -> Column:
    """Without the first suffix of the list that leaves three letters."""
    least = X.STEM_LEAST
    alternatives = "|".join(f"(.{{{least},}}){s}" for s in X.SUFFIXES)
    groups = "".join(f"${k + 1}" for k in range(len(X.SUFFIXES)))
    return F.regexp_replace(term, f"^(?:{alternatives})$", groups)


def strip_prefix(term: Column) -> Column:
    """Without the first fitting prefix, twice."""
    alternatives = "|".join(f"{p}(?=.{{{X.STEM_LEAST},}})" for p in X.PREFIXES)
    for _ in range(X.PREFIX_ROUNDS):
        term = F.regexp_replace(term, f"^(?:{alternatives})", "")
    return term


def deep_stem(term: Column) -> Column:
    return strip_prefix(light_stem(term))


@bound
def stems_text(title: Column, content: Column, tags: Column) -> Column:
    """Distinct deep stems of the terms of title, content and tags. Only Cyrillic terms can change."""
    whole = F.concat_ws(" ", text(title), text(content), F.when(F.size(tags) > 0, F.array_join(tags, " ")))
    cyrillic = r"[\x{0400}-\x{04FF}]"

    def stems(terms: Column) -> Column:
        each = F.transform(terms, lambda t: F.when(t.rlike(cyrillic), deep_stem(t)).otherwise(t))
        return F.array_distinct(F.filter(each, lambda t: t != ""))

    return let(whole, lambda w: let(semantic_terms(w), lambda x: F.array_join(F.when(F.lower(w).rlike(cyrillic), stems(x)).otherwise(x), " ")))


def fingerprint(scope: Column, kind: Column, title: Column, content: Column) -> Column:
    return F.sha1(F.concat_ws("\n", *[canonicalize(c) for c in (scope, kind, title, content)]).cast("binary"))


@bound
def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two term arrays; 0 if either is empty."""
    none = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(none, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


@bound
def overlap(a: Column, b: Column) -> Column:
    """Shared terms by the smaller set's; 0 if either is empty."""
    none = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(none, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)))


def information(c: Column) -> Column:
    return let(normalize_space(c), lambda x: F.length(x) + 12 * F.size(semantic_terms(x)))


@bound
def cut_at_word(c: Column, most: int) -> Column:
    """At most so many characters, up to the last blank among them."""
    head = F.substring(c, 1, most)
    before = F.regexp_extract(head, r"^(.*) [^ ]*$", 1)
    return F.when(F.length(c) <= most, c).when(before != "", before).otherwise(head)


@bound
def ellipsis(c: Column, most: int) -> Column:
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, most - 3)), F.lit("...")))


@bound
def richer(existing: Column, candidate: Column, most: int | None = None) -> Column:
    """The text that says more; the existing one of equals."""
    best = let(normalize_space(existing), lambda a: let(normalize_space(candidate), lambda b: F.when(information(a) >= information(b), a).otherwise(b)))
    return cut_at_word(best, most) if most else best


def merge_sources(existing: Column, candidate: Column, most: int = X.SOURCE_CHARS) -> Column:
    parts = F.concat(*[F.split(normalize_space(c), "; ", -1) for c in (existing, candidate)])
    return ellipsis(F.array_join(F.array_distinct(F.filter(parts, lambda p: p != "")), "; "), most)


def blank(c: Column) -> Column:
    """Whether nothing is left of a text once it is normalised; looks no further than its first sign."""
    return ~text(c).rlike(r"(?U)[^\s\x1c-\x1f\x{FEFF}\x{200B}]")


def first_words(c: Column, most: int) -> Column:
    """The first words of the normalised text; only the beginning is looked at."""
    space = r"[\s\x1c-\x1f\x{FEFF}\x{200B}]"
    return normalize_space(F.regexp_extract(text(c), rf"(?U)^{space}*+(?:[^{space[1:]}++{space}*+){{0,{most}}}", 0))


def lines(c: Column) -> Column:
    return F.split(text(c), LINE_ENDS, -1)


def derive_summary(c: Column, most: int = X.SUMMARY_CHARS) -> Column:
    """The first line that is not blank."""
    filled = F.filter(F.transform(lines(c), normalize_space), lambda x: x != "")
    return ellipsis(F.coalesce(F.get(filled, F.lit(0)), F.lit("")), most)


@bound
def derive_title(c: Column, kind: Column) -> Column:
    """The first words, without a phrase that only says the kind."""
    return let(normalize_space(c), lambda clean: _title(c, clean, kind))


def _title(c: Column, clean: Column, kind: Column) -> Column:
    bare = clean
    for name, pattern in X.TITLE_OPENINGS.items():
        bare = F.when(kind == name, normalize_space(F.regexp_replace(clean, f"(?iu){pattern}", ""))).otherwise(bare)
    bare = let(bare, lambda b: F.when(b == "", clean).otherwise(b))
    words = F.array_join(F.slice(F.split(bare, " ", -1), 1, X.TITLE_WORDS), " ")
    title = cut_at_word(F.regexp_replace(words, r"[ ,:;.\-]+$", ""), X.TITLE_CHARS)
    return let(title, lambda x: F.when(x != "", x).otherwise(derive_summary(c, X.TITLE_CHARS)))


@bound
def excerpt(summary: Column, content: Column, terms: Column, most: int = X.EXCERPT_CHARS) -> Column:
    """A window of the text that starts a little before the earliest term."""
    return let(normalize_space(F.when(text(summary) != "", summary).otherwise(content)), lambda whole: _window(whole, terms, most))


def _window(whole: Column, terms: Column, most: int) -> Column:
    places = let(F.lower(whole), lambda low: F.transform(terms, lambda t: F.call_function("instr", low, t)))
    return let(F.array_min(F.filter(places, lambda p: p > 0)) - 1, lambda at: _cut_window(whole, at, most))


def _cut_window(whole: Column, at: Column, most: int) -> Column:
    start = F.greatest(at - 40, F.lit(0))
    window = F.substring(whole, start + 1, F.lit(most))
    window = F.when(start > 0, F.concat(F.lit("..."), F.substring(window, F.lit(4), F.length(window)))).otherwise(window)
    cut = start + most < F.length(whole)
    window = F.when(cut, F.concat(F.rtrim(F.substring(window, F.lit(1), F.length(window) - 3)), F.lit("..."))).otherwise(window)
    return F.when(F.length(whole) <= most, whole).when(at.isNull(), ellipsis(whole, most)).otherwise(window)


def index_tokens(c: Column) -> Column:
    """Tokens of the full-text index: letters and digits, lower case, Latin letters without marks."""
    marked = "".join(a for a, _ in MARKED)
    plain = let(F.lower(text(c)), lambda x: F.when(x.rlike(r"[\x{C0}-\x{24F}]"), F.translate(x, marked, "".join(b for _, b in MARKED))).otherwise(x))
    return F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def search_phrases(c: Column, stemming: bool = True) -> Column:
    """Structs (text, scoped): prefix phrases over all columns, and exact stems in the column of stems."""
    return let(query_terms(c), lambda terms: _phrases(terms, stemming))


def _phrases(terms: Column, stemming: bool) -> Column:
    phrase = lambda t, scoped: F.struct(t.alias("text"), F.lit(scoped).alias("scoped"))
    if not stemming:
        return F.transform(terms, lambda t: phrase(t, False))
    stems = F.transform(terms, lambda t: let(light_stem(t), lambda x: F.struct(x.alias("light"), strip_prefix(x).alias("deep"))))
    deep = lambda s: F.array_distinct(F.transform(F.filter(s, lambda x: (x["deep"] != x["light"]) & (x["deep"] != "")), lambda x: x["deep"]))
    return let(stems, lambda s: F.concat(F.transform(s, lambda x: phrase(x["light"], False)), F.transform(deep(s), lambda t: phrase(t, True))))

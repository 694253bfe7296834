"""Classification and scores of memories, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorekeep import lexicon as X
from lorekeep.functions.text import bound, canonicalize, let, normalize_tags, semantic_terms


def _any(c: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def _pick(kind: Column, table: dict[str, float], other: float) -> Column:
    out = F.lit(other)
    for name, value in table.items():
        out = F.when(kind == name, F.lit(value)).otherwise(out)
    return out


def kind_scores(low: Column) -> dict[str, Column]:
    """Points by kind of a canonical text."""
    scores = {k: F.lit(0) for k in X.KINDS}
    for kind, hints in X.KIND_HINTS.items():
        for hint in hints:
            scores[kind] = scores[kind] + F.when(low.contains(hint), 2).otherwise(0)
    for kind, points, openings in X.KIND_OPENINGS:
        scores[kind] = scores[kind] + F.when(reduce(lambda a, b: a | b, [low.startswith(o) for o in openings]), points).otherwise(0)
    for kind, points, words in X.KIND_BONUS:
        scores[kind] = scores[kind] + F.when(_any(low, words), points).otherwise(0)
    return scores


def infer_kind(c: Column) -> Column:
    """The kind of the most points, the first of equals; note without any."""
    best = lambda low: F.array_max(F.array(*[F.struct(s.alias("s"), F.lit(-n).alias("n"), F.lit(k).alias("kind")) for n, (k, s) in enumerate(kind_scores(low).items())]))
    return let(let(canonicalize(c), best), lambda b: F.when(b["s"] <= 0, "note").otherwise(b["kind"]))


@bound
def infer_importance(c: Column, kind: Column) -> Column:
    return let(canonicalize(c), lambda low: _importance(c, low, kind))


def _importance(c: Column, low: Column, kind: Column) -> Column:
    score = _pick(kind, X.BASE_IMPORTANCE, 0.5)
    score = score + F.when(_any(low, X.STRONG_WORDS), 0.10).otherwise(0.0)
    score = score + F.when(F.size(semantic_terms(c)) >= 6, 0.05).otherwise(0.0)
    score = score - F.when((kind == "note") & (F.length(low) < 40), 0.08).otherwise(0.0)
    return F.round(F.least(F.greatest(score, F.lit(0.05)), F.lit(1.0)), 2)


@bound
def infer_certainty(c: Column, kind: Column) -> Column:
    return let(canonicalize(c), lambda low: _certainty(low, kind))


def _certainty(low: Column, kind: Column) -> Column:
    score = _pick(kind, X.BASE_CERTAINTY, 0.7)
    score = score - F.when(_any(low, X.HEDGE_WORDS), 0.18).otherwise(0.0)
    score = score + F.when(_any(low, X.STRONG_WORDS), 0.06).otherwise(0.0)
    return F.round(F.least(F.greatest(score, F.lit(0.2)), F.lit(0.99)), 2)


@bound
def candidate_tags(c: Column, base: Column, most: int = X.TAGS) -> Column:
    """Given tags, then terms up to ``most``; if the given fill it, the first term is still tried."""
    def pick(tags, terms):
        return F.when(F.size(tags) < most, F.slice(F.array_union(tags, terms), 1, most)).otherwise(F.array_union(tags, F.slice(terms, 1, 1)))

    return let(normalize_tags(base), lambda tags: let(semantic_terms(c, X.TAG_TERMS), lambda terms: pick(tags, terms)))


def age_days(at: Column, now: Column) -> Column:
    return F.greatest((F.unix_micros(now) - F.unix_micros(at)) / F.lit(86_400_000_000.0), F.lit(0.0))


def retention(importance: Column, access_count: Column, last_seen: Column, now: Column) -> Column:
    """Importance, recalls, and a half-life of 30 days since it was last seen."""
    recalls = F.least(F.greatest(access_count, F.lit(0)), F.lit(10)) / 10.0
    fresh = F.coalesce(F.pow(F.lit(0.5), age_days(last_seen, now) / X.HALF_LIFE_DAYS), F.lit(0.0))
    return F.round(F.least(F.greatest(0.5 * importance + 0.2 * recalls + 0.3 * fresh, F.lit(0.0)), F.lit(1.0)), 4)


def recency(at: Column, now: Column) -> Column:
    return F.coalesce(1.0 / (1.0 + age_days(at, now) / X.RECENCY_DAYS), F.lit(0.0))


def actionability(kind: Column) -> Column:
    return _pick(kind, X.ACTIONABILITY, 0.05)

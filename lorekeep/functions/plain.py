"""The few text functions that the sequential merge of memories needs, on Python strings.

The same results as the column expressions of ``functions.text``; tests hold
them against each other.
"""

from __future__ import annotations

import hashlib
import unicodedata
from functools import lru_cache

from lorekeep import lexicon as X

_STOPS = frozenset(X.STOP_WORDS)


class _Plain(dict):
    """Code points to what a canonical text has for them; filled as they come up."""

    def __missing__(self, code: int):
        ch = chr(code)
        kept = ch in " -_" or unicodedata.category(ch)[0] in "LN"
        self[code] = None if ch in X.APOSTROPHES else code if kept else 32
        return self[code]


_PLAIN = _Plain()


def _visible(s: str) -> str:
    return s.replace("\ufeff", " ").replace("\u200b", " ")


def squeeze(s: str) -> str:
    if s.isprintable() and "  " not in s and s == s.strip(" "):  # blanks are the only white space that is printable
        return s
    return " ".join(_visible(s).split())


@lru_cache(maxsize=256)
def _canonical_words(s: str) -> list[str]:
    s = _visible(s).lower()
    if s.isascii():
        return s.translate(_PLAIN).split()
    for ch in set(s):  # few of a text's distinct signs go; a look-up for each sign of the text costs more
        if (code := _PLAIN[ord(ch)]) != ord(ch):
            s = s.replace(ch, "" if code is None else " ")
    return s.split()


def canonical(s: str) -> str:
    return " ".join(_canonical_words(s))


@lru_cache(maxsize=256)
def terms(s: str) -> tuple[str, ...]:
    words = dict.fromkeys(_canonical_words(s))
    if "-" in s:
        words = dict.fromkeys(" ".join(words).replace("-", " ").split())
    for w in _STOPS.intersection(words):
        del words[w]
    return tuple([w for w in words if len(w) >= 3])


def _first_cut(term: str, endings, fits, cut) -> str:
    for e in endings:
        if fits(term, e) and len(term) - len(e) >= X.STEM_LEAST:
            return cut(term, e)
    return term


def stem(term: str) -> str:
    term = _first_cut(term, X.SUFFIXES, str.endswith, lambda t, e: t[: len(t) - len(e)])
    for _ in range(X.PREFIX_ROUNDS):
        term = _first_cut(term, X.PREFIXES, str.startswith, lambda t, e: t[len(e) :])
    return term


def stems(title: str, content: str, tags) -> str:
    whole = " ".join([title, content, *([" ".join(tags)] if len(tags) else [])])
    return " ".join(dict.fromkeys(stem(t) for t in terms(whole)))


def fingerprint(*parts: str) -> str:
    return hashlib.sha1("\n".join(map(canonical, parts)).encode()).hexdigest()


def overlap(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    return len(set(a).intersection(b)) / min(len(a), len(b)) if a and b else 0.0


def richer(old: str, new: str, most: int | None = None) -> str:
    def worth(s):
        return len(s) + 12 * len(terms(s))

    old, new = squeeze(old), squeeze(new)
    best = new if worth(new) > worth(old) else old
    if most is None or len(best) <= most:
        return best
    head = best[:most]
    return head[: head.rfind(" ")] if head.rfind(" ") > 0 else head


def dots(s: str, most: int) -> str:
    return s if len(s) <= most else s[: most - 3].rstrip(" ") + "..."


def sources(old: str, new: str) -> str:
    parts = squeeze(old).split("; ") + squeeze(new).split("; ")
    return dots("; ".join(dict.fromkeys(p for p in parts if p)), X.SOURCE_CHARS)

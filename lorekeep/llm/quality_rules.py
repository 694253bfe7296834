"""Quality rules [native]: a threshold table compiled into one projection.

Words are runs without ASCII white space. The base counts are exact: code
points in words, symbols, repeated lines, words inside repeated 3-word windows.
``compile_rules`` turns a table of bounds into one Boolean expression, so that
a document is read, judged and written in a single narrow stage: no shuffle, no
user function.

The stop-word rule asks for two function words of English, French, German or
Spanish; texts in other languages need a list of their own in ``STOP_WORDS``, or
``RULES`` without that rule. No length is too long.

Defined results: null or empty text has no words and is rejected by the base
rule; very long texts are judged whole; repeated rows are judged each on its
own; a null doc_id stays null; an empty table gives an empty table; extra columns
are kept, whatever their names, but a column named like a result is replaced by
the result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import let, set_aside, split_words

SYMBOLS = "#*$%&|<>"
#: Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in is that for it with as on are be this was by from or an a at not have "
    "de la le les et des en un une du que est pour dans qui sur pas avec au ce il "
    "der die das und ist von zu den mit sich des auf ein eine dem nicht im als auch es "
    "el los las y se del por con una su para al lo como más o sus pero son"
)


@dataclass(frozen=True)
class Rule:
    """``low * den <= den' * value`` style bound: low <= numerator / denominator <= high, in whole numbers.

    ``low`` and ``high`` are (p, q) for p / q; None leaves a side open. A zero
    denominator passes: a ratio of nothing says nothing.
    """

    name: str
    numerator: str
    denominator: str | None
    low: tuple[int, int] | None = None
    high: tuple[int, int] | None = None


#: Thresholds after published web-corpus filters.
RULES = (
    Rule("length", "n_words", None, (50, 1), None),
    Rule("word_length", "word_chars", "n_words", (2, 1), (20, 1)),
    Rule("symbols", "n_symbols", "n_words", None, (1, 10)),
    Rule("stop_words", "n_stop_words", None, (2, 1), None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, (1, 2)),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, (9, 10)),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, (3, 10)),
)


#: What ``quality_rules`` adds.
RESULTS = (
    "word_chars", "n_symbols", "n_words", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_bullet_lines", "n_ellipsis_lines",
    "base_failed", "kept",
)


def compile_rules(rules: tuple[Rule, ...], value=F.col) -> Column:
    """One Boolean expression that is true if every rule of the table holds."""
    ok = F.lit(True)
    for r in rules:
        num = value(r.numerator)
        den = value(r.denominator) if r.denominator else F.lit(1)
        if r.low:
            ok = ok & ((num * r.low[1] >= den * r.low[0]) | (den == 0))
        if r.high:
            ok = ok & ((num * r.high[1] <= den * r.high[0]) | (den == 0))
    return ok


def repeated_words(words: Column, width: int = 3) -> Column:
    """Words inside windows of ``width`` words that the text holds twice or more.

    Hashes show texts without any repeat quickly (windows of different hashes
    differ); the others are settled on the windows themselves, by sorting, in
    O(n log n) for a text of n words.
    """

    def settle(w):
        windows = F.transform(
            F.sequence(F.lit(0), F.size(w) - width),
            lambda i: F.struct(F.array_join(F.slice(w, i + 1, width), " ").alias("k"), i.alias("i")),
        )
        starts = let(
            F.sort_array(windows),
            lambda s: F.filter(
                F.transform(
                    s,
                    lambda e, j: F.when(
                        F.coalesce(F.get(s, j - 1)["k"] == e["k"], F.lit(False))
                        | F.coalesce(F.get(s, j + 1)["k"] == e["k"], F.lit(False)),
                        e["i"],
                    ),
                ),
                lambda p: p.isNotNull(),
            ),
        )
        gaps = let(
            F.sort_array(starts),
            lambda p: F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.lit(width), F.coalesce(b - a, F.lit(width)))),
        )
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, g: acc + g)

    def body(w):
        hashes = F.transform(
            F.sequence(F.lit(0), F.size(w) - width),
            lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]),
        )
        return F.when(F.size(w) <= width, F.lit(0).cast("long")).otherwise(
            F.when(F.size(F.array_distinct(hashes)) == F.size(w) - (width - 1), F.lit(0).cast("long")).otherwise(settle(w))
        )

    return let(words, body)


def measures(text: Column) -> dict[str, Column]:
    """The counts of a text by name; ``_words`` and ``_lines`` are what they are made of."""
    text = F.coalesce(text, F.lit(""))
    bare = F.translate(text, " \t\n\x0b\x0c\r", "")
    return {
        "word_chars": F.length(bare).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "_words": split_words(text),
        "_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    }


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Adds the counts, ``base_failed`` and ``kept`` to every document."""
    docs, back = set_aside(docs, RESULTS, (text_col,))
    stop = STOP_WORDS.split()
    w, lines = F.col("_words"), F.col("_lines")
    df = docs.withColumns(measures(F.col(text_col)))
    df = df.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": repeated_words(w),
            "n_stop_words": F.size(F.filter(w, lambda x: x.isin(stop))).cast("long"),
            "n_bullet_lines": F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09]*[-*•]"))).cast("long"),
            "n_ellipsis_lines": F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09\x0D]*$"))).cast("long"),
        }
    )
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return back(df.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compile_rules(rules)), *RESULTS)


def rules_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same table as SQL."""
    parts = ["true"]
    for r in rules:
        den = r.denominator or "1"
        if r.low:
            parts.append(f"({r.numerator} * {r.low[1]} >= {den} * {r.low[0]} or {den} = 0)")
        if r.high:
            parts.append(f"({r.numerator} * {r.high[1]} <= {den} * {r.high[0]} or {den} = 0)")
    return " and ".join(parts)


def query(spark, sf_dir: str) -> DataFrame:
    from lorekeep.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


SQL = rf"""
with t as (
  select doc_id, coalesce(text, '') as text from documents
), s as (
  select doc_id, text,
         regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from t
), win as (
  select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as k
  from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from s)
), dup as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, k) as n from win) where n > 1
), rep as (
  select doc_id, count(distinct p) as n_repeat_words
  from (select doc_id, unnest([i, i + 1, i + 2]) as p from dup) group by doc_id
), m as (
  select s.doc_id, len(w)::bigint as n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
         coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
         len(l) as n_lines,
         len(list_filter(w, lambda x: x in ({", ".join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS.split()))}))) as n_stop_words,
         len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]'))) as n_bullet_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09\x0D]*$'))) as n_ellipsis_lines
  from s left join rep using (doc_id)
), b as (
  select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed from m
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (not base_failed and {rules_sql()}) as kept
from b
"""

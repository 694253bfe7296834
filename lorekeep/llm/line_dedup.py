"""Line dedup [native]: a deletion-neighbourhood join over lines.

A line's words are what single blanks part in the trimmed line. Two lines are
near copies if their word edit distance (insert, delete, replace) is within the
bound: 0 for lines of fewer than ``MIN_WORDS`` words, else 1. A line goes if an
earlier line (by doc_id, then line number) of the corpus is a near copy of it;
the earliest stays. Lines without words are layout and always stay.

1. Equal lines: one aggregate over 128 bits of hash keeps the first place of each
   distinct line. Partial aggregation takes hot lines off the shuffle.
2. A lossless screen. One edit leaves the head or the tail of a line whole (40 %
   of its words or more), so only lines that share an end with another distinct
   line can have a near copy, with the edit outside of that end.
3. Lines that pass emit all variants within the bound as 64-bit keys: the line
   itself and the line without each of its words outside of shared ends. A key is the XOR of hashes of
   (word, place), so all n variants of a line of n words cost O(n) to make, up to
   the block-wise running XOR in O(n sqrt n) cheap steps.
4. Equal variants join. Lines that lack the word at the same place of the same
   variant differ in that word; a variant that equals a whole line lacks one
   word of it. These are all the pairs within one edit, so an aggregate of the
   earliest line by key stands for the group: no pairs within groups are made,
   and a hot key is pre-aggregated.
5. Each line with an earlier candidate meets that candidate's words and the edit
   distance is verified on the words.

Defined results: null text stays null and has no lines; rows of one doc_id are one
document and lose the same lines (if their texts differ, a line stays if its
number stays for one of them); without a doc_id a line has no place, stays, and
no other goes for it; very long texts and lines are treated whole; an empty table
gives an empty table. Extra columns stay, whatever their names; ``n_lines`` and
``n_removed`` replace columns so named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import cut, let, set_aside

MIN_WORDS = 8
BLANK = " \t\r"


def lines_of(text: Column) -> Column:
    """Trimmed lines of a text."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(BLANK)))


def n_words(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def end_words(n: Column) -> Column:
    """Words of a line's head or tail in the screen: 40 to 50 % of n; lengths of one class have the same."""
    low = F.pow(F.lit(1.25), F.floor(F.log(n) / F.log(F.lit(1.25))))
    return F.least(F.floor(low / 2), F.floor(n / 2)).cast("int")


def ends(line: Column, n: Column) -> dict[str, Column]:
    """The screen's keys: ``head``, ``tail``, and ``more`` for a pair with a longer line.

    Of two lines within one edit, the longer of n words, either both heads or
    both tails of ``end_words(n)`` words are equal. A line whose length begins no
    new class as the shorter one needs no further keys.
    """

    def key(m, end):
        words = F.call_function("substring_index", line, F.lit(" "), -m if end else m)
        return F.xxhash64(F.lit(end), m, words)

    m, longer = end_words(n), end_words(n + 1)
    more = (n >= MIN_WORDS - 1) & ((m != longer) | (n < MIN_WORDS))
    return {
        "head": F.when(n >= MIN_WORDS, key(m, 0)),
        "tail": F.when(n >= MIN_WORDS, key(m, 1)),
        "more": F.when(more, F.array(key(longer, 0), key(longer, 1))),
    }


def running_xor(values: Column) -> Column:
    """[0, v0, v0^v1, ...]: blocks of about sqrt(n) keep the appends cheap."""

    def scan(a):
        zero = F.array(F.lit(0).cast("long"))
        return F.aggregate(a, zero, lambda acc, x: F.array_append(acc, F.element_at(acc, -1).bitwiseXOR(x)))

    def blocks(v):
        b = F.ceil(F.sqrt(F.size(v))).cast("int")
        cut_up = F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / b).cast("int") - 1), lambda k: F.slice(v, k * b + 1, b))

        def join(parts):
            scans = F.transform(parts, scan)
            offsets = scan(F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(x))))
            return let(
                offsets,
                lambda o: F.concat(
                    F.flatten(F.transform(scans, lambda s, k: F.transform(F.slice(s, 1, F.size(s) - 1), lambda x: x.bitwiseXOR(F.get(o, k))))),
                    F.array(F.element_at(o, -1)),
                ),
            )

        return let(cut_up, join)

    return F.when(F.size(values) == 0, F.array(F.lit(0).cast("long"))).otherwise(let(values, blocks))


def variants(words: Column, ends: Column) -> Column:
    """Structs (key, role): 0 lacks a word at a place, 1 is a whole line, 2 lacks a word anywhere.

    With a_j = hash(word j, j) and b_j = hash(word j, j - 1), the variant without
    word i is a_0 ^ .. ^ a_(i-1) ^ b_(i+1) ^ .. ; neighbouring variants differ by
    a_i ^ b_(i+1). A line that shares only its head with others lacks words of
    the rest alone, and the like for its tail.
    """

    def body(w):
        n = F.size(w)
        whole = F.aggregate(F.transform(w, lambda x, j: F.xxhash64(x, j)), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(x))
        first = F.aggregate(
            F.transform(w, lambda x, j: F.when(j > 0, F.xxhash64(x, j - 1)).otherwise(F.lit(0).cast("long"))),
            F.lit(0).cast("long"),
            lambda acc, x: acc.bitwiseXOR(x),
        )
        steps = F.zip_with(
            F.transform(F.slice(w, 1, n - 1), lambda x, j: F.xxhash64(x, j)),
            F.transform(F.slice(w, 2, n - 1), lambda x, j: F.xxhash64(x, j)),
            lambda a, b: a.bitwiseXOR(b),
        )
        open_at = lambda i: (F.array_contains(ends, 0) & (i >= end_words(n))) | (F.array_contains(ends, 1) & (i < n - end_words(n)))
        lacking = F.when(
            F.array_contains(ends, 0) | F.array_contains(ends, 1),
            let(
                first,
                lambda f: F.filter(
                    F.transform(running_xor(steps), lambda x, i: F.struct(x.bitwiseXOR(f).alias("x"), i.alias("i"))), lambda v: open_at(v["i"])
                ),
            ),
        ).otherwise(F.array().cast("array<struct<x:bigint,i:int>>"))
        key = lambda k, role: F.struct(k.alias("key"), F.lit(role).alias("role"))
        return let(
            lacking,
            lambda v: F.concat(
                F.array(key(F.xxhash64(whole, n, F.lit(1)), 1)),
                F.transform(v, lambda x: key(F.xxhash64(x["x"], n, x["i"], F.lit(0)), 0)),
                F.array_distinct(F.transform(v, lambda x: key(F.xxhash64(x["x"], n - 1, F.lit(1)), 2))),
            ),
        )

    return let(words, body)


def within_one(a: Column, b: Column) -> Column:
    """Word edit distance of at most 1, in time linear in the words."""

    def body(p):  # p: index of the first difference, from 0
        la, lb = F.size(a), F.size(b)
        rest = lambda x, k: F.slice(x, p + 1 + k, F.greatest(F.size(x) - p - k, F.lit(0)))
        return (
            F.when(la == lb, rest(a, 1) == rest(b, 1))
            .when(la == lb + 1, rest(a, 1) == rest(b, 0))
            .when(la + 1 == lb, rest(a, 0) == rest(b, 1))
            .otherwise(F.lit(False))
        )

    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    at = F.array_position(same, F.lit(False)).cast("int")
    return let(F.when(at > 0, at - 1).otherwise(F.size(same)), body)


def staying_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, kept): by document the numbers of the lines with words that stay."""
    texts = docs.select("doc_id", "text").where("doc_id is not null")
    placed = (
        texts.select("doc_id", F.posexplode(lines_of(F.col("text"))).alias("no", "line"))
        .where("line != ''")
        .withColumn("n", n_words(F.col("line")))
        .select(
            F.xxhash64("line").alias("h1"),
            F.xxhash64(F.lit(7), "line", "n").alias("h2"),
            F.struct("doc_id", "no").alias("place"),
            *[c.alias(name) for name, c in ends(F.col("line"), F.col("n")).items()],
        )
    )
    first = cut(placed.groupBy("h1", "h2").agg(F.min("place").alias("place"), *[F.first(c).alias(c) for c in ("head", "tail", "more")]))

    # end: 0 for a head, 1 for a tail, 2 for a pair with a longer line
    one = lambda k, end: F.struct(k.alias("key"), F.lit(end).alias("end"))
    own = F.when(F.col("head").isNotNull(), F.array(one(F.col("head"), 0), one(F.col("tail"), 1))).otherwise(F.array().cast("array<struct<key:bigint,end:int>>"))
    longer = F.coalesce(F.transform("more", lambda k: one(k, 2)), F.array().cast("array<struct<key:bigint,end:int>>"))
    screen = first.where("head is not null or more is not null").select("h1", F.inline(F.concat(own, longer)))
    # written first, so that the join has an exchange on both sides and Spark may split a hot key
    shared = cut(screen.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"))
    passed = screen.join(shared, "key", "left_semi").groupBy("h1").agg(F.collect_set("end").alias("ends"))
    passed = passed.join(first.select("h1", "place"), "h1").groupBy("place.doc_id").agg(F.collect_list(F.struct("place.no", "ends")).alias("lines"))
    passed = cut(passed)

    # the words of the lines that passed, from a second look at their documents, numbered in the order of their places
    lines = texts.join(passed, "doc_id").select(
        "doc_id",
        F.inline(
            let(
                lines_of(F.col("text")),
                lambda ls: F.transform("lines", lambda x: F.struct(x["no"].alias("no"), x["ends"].alias("ends"), F.split(F.get(ls, x["no"]), " ", -1).alias("w"))),
            )
        ),
    )
    lines = lines.where("w is not null").select(F.struct("doc_id", "no").alias("place"), "ends", "w").orderBy("place")
    lines = cut(lines.select(F.monotonically_increasing_id().alias("id"), "place", "ends", "w"))

    rows = lines.select("id", F.inline(variants(F.col("w"), F.col("ends"))))
    least = lambda role: F.min(F.when(F.col("role") == role, F.col("id")))
    # what an earlier near copy is for each role: same gap, a line that lacks a word of this key's line, the key's line
    groups = cut(rows.groupBy("key").agg(F.count("*").alias("c"), least(0).alias("p0"), least(2).alias("p1"), least(1).alias("p2")).where("c > 1").drop("c"))
    met = rows.join(groups, "key").select(
        "id", F.when(F.col("role") == 0, F.col("p0")).when(F.col("role") == 1, F.col("p1")).otherwise(F.col("p2")).alias("other")
    )
    candidates = met.where("other < id").distinct()
    words = lines.select("id", "place", "w")
    other = lines.select(F.col("id").alias("other"), F.col("w").alias("v"))
    near = candidates.join(words, "id").join(other, "other").where(within_one(F.col("w"), F.col("v"))).select("place").distinct()

    # one exchange for both: places of first lines, less those of near copies
    both = first.select("place.*", F.lit(False).alias("near")).union(near.select("place.*", F.lit(True)))
    lists = both.groupBy("doc_id").agg(F.collect_list(F.when(~F.col("near"), F.col("no"))).alias("first"), F.collect_list(F.when(F.col("near"), F.col("no"))).alias("near"))
    return lists.select("doc_id", F.array_except("first", "near").alias("kept"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """Replaces text by the lines that stay; adds n_lines (with words) and n_removed."""
    away, back = set_aside(docs, ("n_lines", "n_removed"), ("doc_id", "text"))
    joined = away.join(staying_lines(away), "doc_id", "left")

    def rebuild(parts):
        blank = F.transform(parts, lambda x: F.btrim(x, F.lit(BLANK)) == "")
        numbers = F.sequence(F.lit(0), F.size(parts) - 1)
        worded = let(blank, lambda e: F.filter(numbers, lambda i: ~F.get(e, i)))

        def stay(w):
            none = F.array().cast("array<int>")
            gone = F.when(F.col("doc_id").isNull(), none).otherwise(F.array_except(w, F.coalesce("kept", none)))
            text = let(gone, lambda g: F.array_join(F.transform(F.array_except(numbers, g), lambda i: F.get(parts, i)), "\n"))
            return F.struct(text.alias("text"), F.size(w).cast("long").alias("n"), F.size(gone).cast("long").alias("gone"))

        return let(worded, stay)

    joined = joined.withColumn("r", let(F.split(F.coalesce("text", F.lit("")), "\n"), rebuild))
    joined = joined.withColumn("text", F.when(F.col("text").isNotNull(), F.col("r.text")))
    return back(joined, F.col("r.n").alias("n_lines"), F.col("r.gone").alias("n_removed"))


def query(spark, sf_dir: str) -> DataFrame:
    from lorekeep.llm.common import table

    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


SQL = rf"""
with l as (
  select doc_id, no - 1 as no, raw, trim(raw, ' ' || chr(9) || chr(13)) as line
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as no from documents)
), f as (
  select line, min((doc_id, no)) as place from l where line <> '' group by line
), w as (
  select place, line, string_split(line, ' ') as w, len(string_split(line, ' ')) as n from f
), v as (
  select place, n, i, array_to_string(w[1:i - 1] || w[i + 1:], chr(1)) as k
  from (select *, unnest(range(1, n + 1)) as i from w where n >= {MIN_WORDS})
), near as (
  select a.place from v a join (select n, i, k, min(place) as place from v group by n, i, k) b using (n, i, k) where b.place < a.place
  union
  select a.place from v a join w b on array_to_string(b.w, chr(1)) = a.k and b.n = a.n - 1 where b.place < a.place
  union
  select b.place from w b join v a on array_to_string(b.w, chr(1)) = a.k and b.n = a.n - 1 where a.place < b.place
), s as (
  select l.*, (line = '' or ((l.doc_id, l.no) in (select place from f) and (l.doc_id, l.no) not in (select place from near))) as stays from l
)
select doc_id, count(*) filter (line <> '')::bigint as n_lines, count(*) filter (not stays)::bigint as n_removed,
       sha256(coalesce(string_agg(raw, chr(10) order by no) filter (stays), '')) as text_sha256
from s group by doc_id
"""

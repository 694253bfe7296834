"""Benchmark decontamination [native]: a prefix-filtered set join.

Every window of 13 consecutive item words (a shorter item as a whole) is a set
of five-word shingles; a document contains the window only if it contains all of
them. So the necessary prefix of the set, with shingles in order of rarity, is
its one rarest shingle.

1. The documents' shingles meet the benchmark's shingles in one join: the hits
   (document, position, shingle). They are few and are written to the shared
   checkpoint folder.
2. Counts of the hits order each window's shingles by rarity, over the whole
   corpus. A window with a shingle that no document has ends here.
3. The hits of prefix shingles give candidates: a window at a start. Length and
   position bound them: the window must lie within the document.
4. The candidates meet their document's words again; the exact words of the
   window are compared. Words under verified windows are hit.

The benchmark's shingles are broadcast if they are counted to be at most
``BROADCAST_ROWS``; beyond that they are joined by a shuffle, which may split hot
keys. Nothing is collected but the set of shingle lengths (five numbers at most).

Defined results: null, empty and wordless texts have no words and are clean;
wordless items have no windows; repeated documents are judged each, repeated
items count each by its id; without documents or items the result is empty or
clean; a null doc_id is judged by its text; very long texts are judged whole.
Extra columns of documents stay, whatever their names; the added names replace
columns so named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import NOT_ALNUM, ascii_lower, cut, let, set_aside, split_words

WINDOW = 13
SHINGLE = 5
#: Rows of (shingle hash) that may be broadcast: 16 MB of keys.
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    return split_words(ascii_lower(F.coalesce(text, F.lit(""))), NOT_ALNUM)


def shingles_at(words: Column, n: Column, size) -> Column:
    """Hashes of the shingles by start; empty if there are fewer words than ``size``."""
    return F.when(n >= size, F.transform(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))), lambda i: F.xxhash64(F.slice(words, i + 1, size)))).otherwise(
        F.array().cast("array<bigint>")
    )


def windows_of(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(words, item ids) of distinct windows, and their shingles as (words, size, offset, h)."""
    w = items.select("item_id", words_of(F.col("text")).alias("w")).withColumn("n", F.size("w")).where("n > 0")
    each = w.select(
        "item_id",
        F.explode(
            F.transform(F.sequence(F.lit(0), F.greatest(F.col("n") - window, F.lit(0))), lambda i: F.slice(F.col("w"), i + 1, F.least(F.col("n"), F.lit(window))))
        ).alias("words"),
    ).distinct()
    distinct = each.select("words").distinct().withColumn("size", F.least(F.size("words"), F.lit(shingle)))
    shingles = distinct.select("words", "size", F.posexplode(shingles_at(F.col("words"), F.size("words"), F.col("size"))).alias("offset", "h"))
    return each, shingles


def covered(spans: Column) -> Column:
    """Positions inside a union of (start, end) spans: one pass over the sorted spans."""
    zero = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).alias("upto"))
    return F.aggregate(
        F.sort_array(spans),
        zero,
        lambda acc, s: F.struct(
            (acc["hit"] + F.greatest(s["end"] - F.greatest(s["start"], acc["upto"]), F.lit(0))).alias("hit"),
            F.greatest(acc["upto"], s["end"]).alias("upto"),
        ),
        lambda acc: acc["hit"],
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, share: int = 20) -> DataFrame:
    """Adds n_words, n_hit, n_items, items_sha256 and contaminated (n_hit > 0 and share * n_hit >= n_words)."""
    added = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    docs, back = set_aside(docs, added, ("doc_id", "text"))
    key = F.struct(F.col("doc_id"), F.xxhash64(F.col("text"))).alias("_key")
    items, shingles = windows_of(benchmark, window, shingle)
    shingles = cut(shingles)
    sizes = sorted(r[0] for r in shingles.select("size").distinct().collect())
    wanted = shingles.select("h").distinct()
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)

    tokens = docs.select(key, words_of(F.col("text")).alias("_w")).withColumn("_n", F.size("_w"))
    by_size = [tokens.select("_key", "_n", F.posexplode(shingles_at(F.col("_w"), F.col("_n"), s)).alias("pos", "h")) for s in sizes]
    hits = tokens.select("_key", "_n", F.lit(0).alias("pos"), F.lit(0).cast("long").alias("h")).limit(0) if not by_size else by_size[0]
    for more in by_size[1:]:
        hits = hits.unionByName(more)
    hits = cut(hits.join(wanted, "h"))

    rarity = hits.groupBy("h").agg(F.count("*").alias("c"))
    prefix = (
        shingles.join(rarity, "h", "left")
        .groupBy("words")
        .agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "offset", "h")).alias("first"))
        .where("first.c > 0")
        .select("words", F.size("words").alias("len"), "first.offset", "first.h")
    )
    start = (F.col("pos") - F.col("offset")).alias("start")
    found = (
        hits.join(prefix, "h")
        .select("_key", "_n", start, "len", "words")
        .where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("_n")))
        .groupBy("_key")
        .agg(F.collect_set(F.struct("start", (F.col("start") + F.col("len")).alias("end"), "words")).alias("_found"))
    )

    judged = docs.withColumn("_key", key).join(found, "_key", "left")
    true = let(
        words_of(F.col("text")),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.filter(F.coalesce(F.col("_found"), F.array()), lambda c: F.slice(w, c["start"] + 1, c["end"] - c["start"]) == c["words"]).alias("spans"),
        ),
    )
    judged = judged.withColumn("_t", true)
    judged = cut(
        judged.select(
            *docs.columns,
            "_key",
            F.col("_t.n_words").alias("n_words"),
            covered(F.transform("_t.spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))).alias("n_hit"),
            F.array_distinct(F.transform("_t.spans", lambda s: s["words"])).alias("_windows"),
        )
    )
    by_doc = (
        judged.where("n_hit > 0")
        .select("_key", F.explode("_windows").alias("words"))
        .distinct()
        .join(items, "words")
        .groupBy("_key")
        .agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("_items"))
    )
    empty = F.array().cast("array<string>")
    out = judged.join(by_doc, "_key", "left").withColumn("_items", F.coalesce("_items", empty))
    return back(
        out,
        "n_words",
        "n_hit",
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    from lorekeep.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).drop("text")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
with d as (
  select doc_id, {_WORDS} as w from documents
), i as (
  select item_id, w, least(len(w), {WINDOW}) as n from (select item_id, {_WORDS} as w from benchmark) where len(w) > 0
), win as (
  select distinct item_id, n, array_to_string(w[s:s + n - 1], ' ') as k from (select *, unnest(range(1, len(w) - n + 2)) as s from i)
), lens as (
  select distinct n from win
), dwin as (
  select doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') as k
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from d, lens where len(w) >= n)
), occ as (
  select doc_id, s, dwin.n, item_id from dwin join win on dwin.k = win.k and dwin.n = win.n
), hit as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from occ) group by doc_id
), its as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, item_id::varchar as item from occ) group by doc_id
)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256,
       (coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w)) as contaminated
from d left join hit using (doc_id) left join its using (doc_id)
"""

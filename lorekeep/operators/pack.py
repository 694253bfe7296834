"""Context packs: results rendered within a budget of characters, near duplicates left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep import lexicon as X
from lorekeep.functions.text import jaccard, semantic_terms
from lorekeep.operators.index import Index
from lorekeep.operators.lineage import cut
from lorekeep.operators.search import search, search_hot

ITEM = "struct<id:string,kind:string,scope:string,title:string,excerpt:string,score:double>"


def _dots(c: Column, most: Column) -> Column:
    """Cut to make room for three dots."""
    keep = F.greatest(most - 3, F.lit(0))
    return F.concat(F.rtrim(F.substring(c, F.lit(1), keep)), F.lit("..."))


def fold(results: Column, header: Column, budget: int, limit: int, threshold: float) -> Column:
    """The pack of one query: an ordered fold over its ranked results.

    A near duplicate of a kept item is passed over; a line beyond the budget ends
    the pack, or is cut if it is the first; the whole is cut to the budget.
    """
    start = F.struct(
        header.alias("text"), F.array().cast(f"array<{ITEM}>").alias("items"), F.array().cast("array<array<string>>").alias("kept"), F.lit(False).alias("full")
    )

    def step(acc, r):
        line = F.concat(
            F.lit("- ["), r["kind"], F.lit("/"), r["scope"], F.lit("] "), r["title"], F.lit(": "), r["excerpt"],
            F.when(r["source"] != "", F.concat(F.lit(" (source: "), r["source"], F.lit(")"))).otherwise(""),
        )
        near = F.exists(acc["kept"], lambda k: jaccard(k, r["words"]) >= threshold) if threshold < 1 else F.lit(False)
        stop = acc["full"] | (F.size(acc["items"]) >= limit) | near
        over = F.length(acc["text"]) + 1 + F.length(line) > budget
        first = F.size(acc["items"]) == 0
        cut = F.when(over, _dots(line, F.greatest(F.lit(budget) - F.length(acc["text"]) - 1, F.lit(0)))).otherwise(line)
        item = F.struct(*[r[c].alias(c) for c in ("id", "kind", "scope", "title", "excerpt", "score")])
        taken = F.struct(
            F.concat(acc["text"], F.lit("\n"), cut).alias("text"),
            F.array_append(acc["items"], item).alias("items"),
            F.array_append(acc["kept"], r["words"]).alias("kept"),
            F.lit(False).alias("full"),
        )
        closed = F.struct(acc["text"].alias("text"), acc["items"].alias("items"), acc["kept"].alias("kept"), F.lit(True).alias("full"))
        return F.when(stop, acc).when(over & ~first, closed).otherwise(taken)

    def finish(acc):
        text = F.when(F.length(acc["text"]) > budget, _dots(acc["text"], F.lit(budget))).otherwise(acc["text"])
        return F.struct(F.lit(budget).alias("budget_chars"), F.length(text).alias("used_chars"), acc["items"].alias("items"), text.alias("rendered"))

    return F.aggregate(results, start, step, finish)


def render(results: DataFrame, asked: DataFrame, header: Column, budget: int, limit: int, threshold: float) -> DataFrame:
    """A pack for every query of ``asked`` (qid and what the header needs). At most 4 x limit results of a query are folded."""
    r = F.struct("rank", "id", "kind", "scope", "title", "excerpt", "score", "source", semantic_terms(F.col("content")).alias("words"))
    lists = results.groupBy("qid").agg(F.sort_array(F.collect_list(r)).alias("results"))
    kind = lists.schema["results"].dataType.simpleString()
    joined = asked.join(lists, "qid", "left").withColumn("results", F.coalesce("results", F.array().cast(kind)))
    return joined.withColumn("pack", fold(F.col("results"), header, budget, limit, threshold)).select("qid", "pack.*")


def context_packs(queries: DataFrame, memories: DataFrame, now: Column, budget: int = 1200, limit: int = 5, threshold: float = X.NEAR_DUPLICATE, index: Index | None = None) -> tuple[DataFrame, DataFrame]:
    """(packs, results): a pack by query; queries that match nothing show hot memories and say so."""
    most = 4 * limit
    direct = cut(search(queries, memories, now, most, index))  # 4 x limit rows a query, used for packs and for what missed
    asked = queries.select("qid", F.coalesce("query", F.lit("")).alias("query"))
    missed = cut(queries.join(direct.select("qid").distinct(), "qid", "left_anti").where(F.trim(F.coalesce("query", F.lit(""))) != ""))
    asked = asked.join(missed.select("qid", F.lit(True).alias("hot")), "qid", "left")
    results = direct.unionByName(search_hot(missed, memories, now, most)) if missed.limit(1).count() else direct
    title = F.concat(F.lit("Context pack for: "), F.col("query"))
    header = F.when(F.col("hot"), F.concat(title, F.lit(" (no direct match; showing hot memories)"))).otherwise(title)
    return render(results, asked, header, budget, limit, threshold), results


def wake_up_packs(scopes: DataFrame, memories: DataFrame, now: Column, budget: int = 800, limit: int = 6, threshold: float = X.NEAR_DUPLICATE) -> tuple[DataFrame, DataFrame]:
    """(packs, results) for scopes (qid, scope; a null scope is all): the hottest memories."""
    results = search_hot(scopes, memories, now, 4 * limit)
    return render(results, scopes.select("qid"), F.lit("Wake-up pack"), budget, limit, threshold), results

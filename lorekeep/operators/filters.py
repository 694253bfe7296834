"""Filters, orders and point look-ups over memories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.text import normalize_tags

LOWER_ASCII = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def active() -> Column:
    """Neither archived nor superseded."""
    return F.col("archived_at").isNull() & F.col("superseded_by").isNull()


def has_tag(tag: Column, exact: bool = False) -> Column:
    """Whether the joined tags contain the tag (as a pattern of LIKE), or with ``exact`` whether it is one of them."""
    if exact:
        return F.array_contains("tags", tag)
    joined = F.lower(F.array_join("tags", " "))
    return F.like(joined, F.concat(F.lit("%"), tag, F.lit("%")), F.lit("\x01"))


def where(scope: str | None = None, kind: str | None = None, tags=(), include_archived: bool = False, exact_tags: bool = False) -> Column:
    """All given conditions; what is empty sets none."""
    parts = [F.lit(True)]
    if scope:
        parts.append(F.col("scope") == scope)
    if kind:
        parts.append(F.col("kind") == kind)
    for tag in tags or ():
        clean = normalize_tags(F.array(F.lit(tag)))[0]
        parts.append(F.coalesce(has_tag(clean, exact_tags), F.lit(True)))
    if not include_archived:
        parts.append(active())
    return reduce(lambda a, b: a & b, parts)


def recent_first() -> list[Column]:
    return [F.desc("updated_at"), F.desc("created_at"), F.desc("rowid")]


def hot_first() -> list[Column]:
    return [F.desc("importance"), F.desc("certainty"), F.desc("access_count"), F.desc("updated_at"), F.asc("rowid")]


def important_first() -> list[Column]:
    return [F.desc("importance"), F.desc("certainty"), F.desc("updated_at"), F.asc("rowid")]


def get_memory(memories: DataFrame, id: str) -> DataFrame:
    """The memory of an id, archived or not; no row if there is none."""
    return memories.where(F.col("id") == id)


def list_memories(memories: DataFrame, scope=None, kind=None, tags=(), limit: int = 20, include_archived: bool = False, exact_tags: bool = False) -> DataFrame:
    """The latest memories that fit."""
    return memories.where(where(scope, kind, tags, include_archived, exact_tags)).orderBy(*recent_first()).limit(limit)


def hot_memories(memories: DataFrame, scope=None, kind=None, tags=(), limit: int = 5, include_archived: bool = False) -> DataFrame:
    return memories.where(where(scope, kind, tags, include_archived)).orderBy(*hot_first()).limit(limit)


def like(query: Column) -> Column:
    """Title, summary or content contain the query (a LIKE pattern), whatever the case."""
    pattern = F.concat(F.lit("%"), F.lower(query), F.lit("%"))
    return reduce(lambda a, b: a | b, [F.like(F.lower(F.col(c)), pattern, F.lit("\x01")) for c in ("title", "summary", "content")])


def search_like(memories: DataFrame, query: str, scope=None, kind=None, tags=(), limit: int = 5, include_archived: bool = False) -> DataFrame:
    found = memories.where(where(scope, kind, tags, include_archived) & like(F.lit(query)))
    return found.orderBy(*important_first()).limit(limit)


def superseded_chain(memories: DataFrame) -> DataFrame:
    """(id, superseded_by, new_title): what replaced each superseded memory."""
    old, new = memories.alias("o"), memories.alias("n")
    return old.join(new, F.col("o.superseded_by") == F.col("n.id"), "left").where("o.superseded_by is not null").select("o.id", "o.superseded_by", F.col("n.title").alias("new_title"))

"""Counts over memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.filters import active


def totals(memories: DataFrame) -> DataFrame:
    """total, active, archived (or superseded), in one pass."""
    return memories.agg(F.count("*").alias("total"), F.count_if(active()).alias("active"), F.count_if(~active()).alias("archived"))


def by_kind(memories: DataFrame) -> DataFrame:
    return memories.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


def top_scopes(memories: DataFrame, limit: int = 10) -> DataFrame:
    return memories.groupBy("scope").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "scope").limit(limit)


def since(memories: DataFrame, cutoff: Column) -> DataFrame:
    """created_since and updated_since, as instants."""
    return memories.agg(F.count_if(F.col("created_at") >= cutoff).alias("created_since"), F.count_if(F.col("updated_at") >= cutoff).alias("updated_since"))


def by_kind_since(memories: DataFrame, cutoff: Column) -> DataFrame:
    return by_kind(memories.where(F.col("updated_at") >= cutoff))


def report(memories: DataFrame, cutoff: Column | None = None) -> DataFrame:
    """All of it as one row."""
    as_map = lambda df, key: df.agg(F.map_from_entries(F.collect_list(F.struct(key, "n"))).alias(f"by_{key}"))  # noqa: E731  at most six kinds, ten scopes
    out = totals(memories).join(as_map(by_kind(memories), "kind")).join(as_map(top_scopes(memories), "scope").withColumnRenamed("by_scope", "top_scopes"))
    if cutoff is not None:
        out = out.join(since(memories, cutoff)).join(as_map(by_kind_since(memories, cutoff), "kind").withColumnRenamed("by_kind", "by_kind_since"))
    return out

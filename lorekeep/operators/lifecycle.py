"""Life of memories: update, delete, archive, restore, supersede, decay, recall counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep import lexicon as X
from lorekeep.functions import enrich
from lorekeep.operators.filters import active
from lorekeep.operators.upsert import _derived, checked
from lorekeep.schema import COLUMNS

EDITABLE = ["scope", "kind", "title", "content", "summary", "tags", "source", "importance", "certainty"]


def update_memories(memories: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """changes: id and new values (null: unchanged). The summary is not derived anew from changed content."""
    new = changes.select("id", *[F.col(c).alias(f"new_{c}") for c in EDITABLE if c in changes.columns])
    hit = memories.join(new, "id")
    for c in EDITABLE:
        if c in changes.columns:
            hit = hit.withColumn(c, F.coalesce(f"new_{c}", c))
    hit = _derived(checked(hit)).withColumn("updated_at", now)
    return memories.join(new.select("id"), "id", "left_anti").select(COLUMNS).unionByName(hit.select(COLUMNS))


def delete_memories(memories: DataFrame, ids: DataFrame) -> DataFrame:
    return memories.join(ids.select("id"), "id", "left_anti").select(COLUMNS)


def found(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, found) by asked id."""
    return ids.select("id").distinct().join(memories.select("id", F.lit(True).alias("found")), "id", "left").select("id", F.coalesce("found", F.lit(False)).alias("found"))


def _flagged(memories: DataFrame, ids: DataFrame) -> DataFrame:
    return memories.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")


def archive(memories: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Hides memories; those that are archived already stay as they are."""
    act = F.col("_hit") & F.col("archived_at").isNull()
    out = _flagged(memories, ids).withColumns({"updated_at": F.when(act, now).otherwise(F.col("updated_at")), "archived_at": F.when(act, now).otherwise(F.col("archived_at"))})
    return out.select(COLUMNS)


def restore(memories: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Shows archived memories again; others stay as they are."""
    act = F.col("_hit") & F.col("archived_at").isNotNull()
    out = _flagged(memories, ids).withColumns({"updated_at": F.when(act, now).otherwise(F.col("updated_at")), "archived_at": F.when(act, F.lit(None)).otherwise(F.col("archived_at"))})
    return out.select(COLUMNS)


def supersede(memories: DataFrame, pairs: DataFrame, now: Column) -> DataFrame:
    """pairs: old_id, new_id. A pair of one id, or with an id that isn't there, fails the job."""
    ids = memories.select("id")
    known = pairs.join(ids.withColumnRenamed("id", "old_id").withColumn("_old", F.lit(True)), "old_id", "left").join(ids.withColumnRenamed("id", "new_id").withColumn("_new", F.lit(True)), "new_id", "left")
    problem = F.when(F.col("old_id") == F.col("new_id"), F.lit("a memory cannot supersede itself")).when(
        F.col("_old").isNull() | F.col("_new").isNull(), F.concat(F.lit("no such memory: "), F.when(F.col("_old").isNull(), F.col("old_id")).otherwise(F.col("new_id")))
    )
    good = known.where(F.when(problem.isNull(), F.lit(True)).otherwise(F.raise_error(problem).cast("boolean"))).select(F.col("old_id").alias("id"), F.col("new_id").alias("_by"))
    out = memories.join(good, "id", "left")
    return out.withColumns({"superseded_by": F.coalesce("_by", "superseded_by"), "updated_at": F.when(F.col("_by").isNotNull(), now).otherwise(F.col("updated_at"))}).select(COLUMNS)


def decay_candidates(memories: DataFrame, now: Column, min_age_days: int = X.DECAY_AGE_DAYS, max_access: int = X.DECAY_ACCESS, threshold: float = X.DECAY_THRESHOLD, scope: str | None = None) -> DataFrame:
    """Active notes and facts with ``retention``, ``age_days`` and ``fades``: old, seldom recalled and weak."""
    seen = F.coalesce("last_accessed_at", "created_at")
    rows = memories.where(F.col("kind").isin(*X.DECAY_KINDS) & active())
    if scope:
        rows = rows.where(F.col("scope") == scope)
    rows = rows.withColumns({"age_days": enrich.age_days(seen, now), "retention": enrich.retention(F.col("importance"), F.col("access_count"), seen, now)})
    return rows.withColumn("fades", (F.col("age_days") >= min_age_days) & (F.col("access_count") <= max_access) & (F.col("retention") < threshold))


def decay(memories: DataFrame, now: Column, **limits) -> DataFrame:
    """Archives what fades."""
    return archive(memories, decay_candidates(memories, now, **limits).where("fades").select("id"), now)


def fold_accesses(memories: DataFrame, log: DataFrame) -> DataFrame:
    """Recall counts and times from the log; ``updated_at`` stays. A hot memory's log is combined before the shuffle."""
    seen = log.groupBy("id").agg(F.count("*").alias("_n"), F.max("at").alias("_at"))
    out = memories.join(seen, "id", "left")
    return out.withColumns({"access_count": F.col("access_count") + F.coalesce("_n", F.lit(0)), "last_accessed_at": F.greatest("last_accessed_at", "_at")}).select(COLUMNS)

"""Integrity: derived columns and the index against what they should be; migrations of older tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep import lexicon as X
from lorekeep.functions import text as t
from lorekeep.operators.index import Index
from lorekeep.operators.upsert import _derived
from lorekeep.schema import COLUMNS


def drift(memories: DataFrame) -> DataFrame:
    """(rowid, id, stems_ok, fingerprint_ok) of rows whose derived columns are not what they should be."""
    c = F.col
    stems = t.stems_text(c("title"), c("content"), c("tags"))
    prints = t.fingerprint(c("scope"), c("kind"), c("title"), c("content"))
    checked = memories.select("rowid", "id", (stems == c("stems_text")).alias("stems_ok"), (prints == c("fingerprint")).alias("fingerprint_ok"))
    return checked.where(~(c("stems_ok") & c("fingerprint_ok")))


def index_drift(memories: DataFrame, index: Index) -> DataFrame:
    """Rowids that only one side has: a row without postings though it has tokens, or postings without a row."""
    tokens = sum((F.size(t.index_tokens(F.col(c))) for c in list(X.WEIGHTS)[1:]), F.size(t.index_tokens(F.col("title"))))
    rows = memories.where(tokens > 0).select("rowid", F.lit(True).alias("stored"))
    indexed = index.postings.select("rowid").distinct().withColumn("indexed", F.lit(True))
    return rows.join(indexed, "rowid", "full").where("stored is null or indexed is null").select("rowid", F.coalesce("stored", F.lit(False)).alias("stored"), F.coalesce("indexed", F.lit(False)).alias("indexed"))


def verify(memories: DataFrame, index: Index | None = None, version: int = X.VERSION) -> DataFrame:
    """One row: version, counts of wrong rows, healthy."""
    bad = drift(memories).agg(F.count_if(~F.col("stems_ok")).alias("stems_mismatches"), F.count_if(~F.col("fingerprint_ok")).alias("fingerprint_mismatches"))
    wrong = index_drift(memories, index).agg(F.count("*").alias("index_mismatches")) if index else None
    out = bad.join(wrong) if wrong is not None else bad.withColumn("index_mismatches", F.lit(0).cast("long"))
    healthy = (F.col("stems_mismatches") + F.col("fingerprint_mismatches") + F.col("index_mismatches") == 0) & F.lit(version == X.VERSION)
    return out.withColumns({"version": F.lit(version), "healthy": healthy})


def repair(memories: DataFrame) -> DataFrame:
    """Derived columns as they should be."""
    return _derived(memories).select(COLUMNS)


def _v1_to_v2(df: DataFrame) -> DataFrame:
    c = F.col
    made = t.fingerprint(c("scope"), c("kind"), c("title"), c("content"))
    return df.withColumn("fingerprint", F.when(F.coalesce(c("fingerprint"), F.lit("")) == "", made).otherwise(c("fingerprint")) if "fingerprint" in df.columns else made)


def _v2_to_v3(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumn("stems_text", t.stems_text(c("title"), c("content"), c("tags")))


def _v3_to_v4(df: DataFrame) -> DataFrame:
    for name, kind in (("archived_at", "timestamp"), ("superseded_by", "string")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


MIGRATIONS = {1: _v1_to_v2, 2: _v2_to_v3, 3: _v3_to_v4}


def migrate(df: DataFrame, version: int) -> DataFrame:
    """A table of an older version as one of today; a fingerprint that is there is not judged."""
    for v in range(max(version, 1), X.VERSION):
        df = MIGRATIONS[v](df)
    return df.select(COLUMNS)

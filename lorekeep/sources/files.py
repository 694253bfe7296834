"""Export to and import from JSON and JSON lines, and raw text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.operators.filters import recent_first, where
from lorekeep.schema import EXPORT, IMPORT

ISO = "yyyy-MM-dd'T'HH:mm:ssXXX"


def iso(c: str) -> Column:
    """Second precision, +00:00 for UTC (the session's zone)."""
    return F.regexp_replace(F.date_format(c, ISO), "Z$", "+00:00").alias(c)


def export_rows(memories: DataFrame, scope=None, kind=None, tags=(), limit: int | None = None) -> DataFrame:
    """The export columns of what fits, archived rows too, latest first; times as ISO text."""
    if limit is not None and limit <= 0:
        raise ValueError("limit must be positive")
    rows = memories.where(where(scope, kind, tags, include_archived=True)).orderBy(*recent_first())
    rows = rows.limit(limit) if limit else rows
    return rows.select(*[iso(c) if c.endswith("_at") else c for c in EXPORT])


def export_jsonl(memories: DataFrame, path: str, **filters) -> None:
    """One record a line; the parts follow each other in order."""
    export_rows(memories, **filters).write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def export_json(memories: DataFrame, database: str, exported_at: Column, scope=None, kind=None, tags=(), limit=None) -> DataFrame:
    """One row ``json``: the snapshot in its envelope. Meant for exports that one text can hold; use lines beyond that."""
    rows = export_rows(memories, scope, kind, tags, limit).withColumn("_n", F.monotonically_increasing_id())
    listed = rows.agg(F.sort_array(F.collect_list(F.struct("_n", F.struct(*EXPORT).alias("m")))).alias("l")).select(F.transform("l", lambda x: x["m"]).alias("memories"))
    filters = F.struct(F.lit(scope).cast("string").alias("scope"), F.lit(kind).cast("string").alias("kind"), F.array(*[F.lit(x) for x in tags]).cast("array<string>").alias("tags"), F.lit(limit).cast("int").alias("limit"))
    stamp = F.regexp_replace(F.date_format(exported_at, ISO), "Z$", "+00:00")
    envelope = F.struct(F.lit(1).alias("version"), stamp.alias("exported_at"), F.lit(database).alias("database"), F.size("memories").alias("count"), filters.alias("filters"), F.col("memories"))
    return listed.select(F.to_json(envelope, {"ignoreNullFields": "false"}).alias("json"))


def resolve_format(path: str, given: str | None = None) -> str:
    return given or ("jsonl" if path.lower().rstrip("/").endswith(".jsonl") else "json")


def read_import(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    """Records with ``seq`` in the order of files and of their lines: JSON lines, or an envelope, a list or a single record.

    A line or a text that is no JSON, or no record, fails the job.
    """
    jsonl = resolve_format(path, format) == "jsonl"
    if jsonl:  # a file's lines stay in order within a split, and splits are told apart by where they start
        split = F.struct("_metadata.file_path", "_metadata.file_block_start")
        text = spark.read.text(path).select("value", split.alias("split"), F.monotonically_increasing_id().alias("n"))
        text = text.withColumn("value", F.regexp_replace("value", "^\\x{FEFF}", "")).where(F.trim("value") != "")
    else:
        split = F.struct("_metadata.file_path", F.lit(0).cast("long").alias("file_block_start"))
        text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^(?:\\x{FEFF}|\\s)+", "").alias("value"), split.alias("split"), F.lit(0).cast("long").alias("n"))
    broken = "_broken"
    record = T.StructType([*IMPORT.fields, T.StructField(broken, T.StringType())])
    envelope = T.StructType([*IMPORT.fields, T.StructField("memories", T.ArrayType(IMPORT)), T.StructField(broken, T.StringType())])
    options = {"columnNameOfCorruptRecord": broken}
    fail = lambda what: F.raise_error(F.concat(F.lit(f"{what}: "), F.substring("value", 1, 80)))
    plain = lambda s: F.struct(*[s[n].alias(n) for n in EXPORT])
    if jsonl:
        one = F.from_json("value", record, options)
        listed = F.when(one.isNull() | one[broken].isNotNull(), fail("this line is no JSON record").cast(T.ArrayType(IMPORT))).otherwise(F.array(plain(one)))
    else:
        several, whole = F.from_json("value", T.ArrayType(IMPORT)), F.from_json("value", envelope, options)
        no_json = fail("this text is no JSON of records").cast(T.ArrayType(IMPORT))
        listed = (
            F.when(F.col("value").startswith("["), F.coalesce(several, no_json))
            .when(whole.isNull() | whole[broken].isNotNull(), no_json)
            .otherwise(F.coalesce(whole["memories"], F.array(plain(whole))))
        )
    rows = text.select("split", "n", F.posexplode(listed).alias("at", "m"))
    # a number by split (a row each), then by line and by record
    order = Window.orderBy("split.file_path", "split.file_block_start")
    splits = rows.select("split").distinct().withColumn("file", F.row_number().over(order).cast("long"))
    first = rows.groupBy("split").agg(F.min("n").alias("first"))
    numbered = rows.join(F.broadcast(splits.join(first, "split")), "split")
    within = (F.col("n") - F.col("first")).bitwiseAND((1 << 33) - 1) if jsonl else F.col("at").cast("long")
    return numbered.select("m.*", (F.shiftleft("file", 33) + within).alias("seq"))


def read_texts(spark: SparkSession, path: str, scope: str) -> DataFrame:
    """Whole files as texts for ingestion: text, scope, and the file as source."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.regexp_replace("value", "^\\x{FEFF}", "").alias("text"), F.lit(scope).alias("scope"), F.input_file_name().alias("source"))

"""Column and session helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators.lineage import cut, release, shared_dir, small

__all__ = ["NOT_ALNUM", "SPACE", "UPPER", "ascii_lower", "cut", "let", "partitions", "quoted", "release", "set_aside", "shared_dir", "shared_path", "small", "split_words", "table"]

#: ASCII white space: the separators of plain words.
SPACE = r"[\x20\x09-\x0D]+"
#: Everything in ASCII that is neither a digit nor a lower-case letter.
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body) -> Column:
    """``body(x)`` with x bound to ``value``, which is evaluated once however often x is used."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only; other letters stay as they are."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(c, UPPER, UPPER.lower())).otherwise(F.lower(c))


def split_words(c: Column, separators: str = SPACE) -> Column:
    """The words between separators as an array; null has none."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), separators), "")


def set_aside(df: DataFrame, added: tuple[str, ...], needed: tuple[str, ...], used_up: tuple[str, ...] = ()):
    """(df, back): columns other than ``needed`` under names that no operator uses, and what gives them their names back.

    Columns named like one of ``added`` go. ``back(out, *results)`` selects df's
    columns in their order, less those ``used_up``, then the results.
    """
    kept = [c for c in df.columns if c.lower() not in added]
    hidden = {c: c if c in needed else f"__aside_{k}" for k, c in enumerate(kept)}
    away = df.select(*[F.col(quoted(c)).alias(h) for c, h in hidden.items()])
    return away, lambda out, *results: out.select(*[F.col(h).alias(c) for c, h in hidden.items() if c not in used_up], *results)


def quoted(name: str) -> str:
    """A column's name that may hold dots or backticks."""
    return "`" + name.replace("`", "``") + "`"


def shared_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

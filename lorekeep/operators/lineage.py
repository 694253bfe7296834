"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that may be broadcast: narrow ones, of less than 100 bytes each.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local session (tests) gets a folder under its warehouse;
    on a cluster such a folder might be one machine's own, so it is refused.
    """
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return own


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder; it survives lost executors."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it has no more rows than that. For narrow tables that were cut before: they are counted."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def release(spark: SparkSession) -> None:
    """Lets Spark delete the exchanges and checkpoints that nothing needs any more.

    They go once the driver's JVM has collected what referred to them, and a
    driver that waits for long stages may not collect for many minutes.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()

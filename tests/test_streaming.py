"""Streams: texts are remembered batch by batch; recalls are counted by event time."""

from datetime import datetime

from pyspark.sql import functions as F

from lorekeep.api import MemoryStore
from lorekeep.streaming.ingest import access_rates, ingest_stream


def test_ingest_stream(spark, tmp_path):
    source = tmp_path / "in"
    rows = [("- We decided to use Parquet for snapshots.\n- TODO: add a compaction job soon.", "p")]
    spark.createDataFrame(rows, "text string, scope string").write.parquet(str(source))
    store = MemoryStore(spark, str(tmp_path / "t"), clock=lambda: datetime(2026, 4, 12, 20))
    stream = spark.readStream.schema("text string, scope string").parquet(str(source))
    query = ingest_stream(stream, store, str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["kind"] for r in store.list()) == ["decision", "task"]


def test_access_rates(spark):
    log = spark.createDataFrame([("a", datetime(2026, 1, 1, 1, m)) for m in (5, 50)] + [("a", datetime(2026, 1, 1, 2, 5)), ("b", datetime(2026, 1, 1, 1, 5))], "id string, at timestamp")
    got = {(r.id, r.start.hour): r.n for r in access_rates(log).withColumn("start", F.col("start")).collect()}
    assert sorted(got.values()) == [1, 1, 2]

"""MemoryStore: the table's verbs for a user at a prompt. Everything runs as batch plans of ``operators``."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep import lexicon as X
from lorekeep.operators import filters, lifecycle, pack, search, segment, stats, upsert, verify
from lorekeep.plans.table import MemoryTable
from lorekeep.schema import INPUT
from lorekeep.sources import files

_QUERY = T.StructType([T.StructField("qid", T.LongType()), T.StructField("query", T.StringType()), T.StructField("scope", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType()))])


class MemoryStore:
    def __init__(self, spark: SparkSession, path: str, clock=None, track_access: bool = True, stemming: bool = True):
        self.spark, self.table = spark, MemoryTable.open(spark, path)
        self.clock = clock or (lambda: datetime.now(timezone.utc).replace(microsecond=0, tzinfo=None))
        self.track_access, self.stemming = track_access, stemming

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

    def close(self) -> None:
        self.table.close()

    def _now(self):
        value = self.clock()
        return value, F.lit(value.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")

    def _ids(self, *ids: str) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], "id string")

    # writes
    def remember_many(self, inputs: DataFrame) -> list[dict]:
        """inputs with ``seq``; all or none. Returns the report in order."""
        value, now = self._now()
        m = self.table.manifest()
        with upsert.remember(self.table.current(m), upsert.checked(inputs), now, value) as (after, report):
            rows = [r.asDict() for r in report.orderBy("seq").collect()]  # one row by input of the call
            self.table.commit(after, m, new_log=True)
        return rows

    def remember_all(self, inputs: DataFrame) -> dict[str, int]:
        """``remember_many`` for tables of inputs: the report is counted, not collected."""
        value, now = self._now()
        m = self.table.manifest()
        with upsert.remember(self.table.current(m), upsert.checked(inputs), now, value) as (after, report):
            counts = {r.action: r.n for r in upsert.action_counts(report).collect()}
            self.table.commit(after, m, new_log=True)
        return counts

    def _change(self, act) -> None:
        """Commits ``act(memories, now)``, made from one manifest."""
        m = self.table.manifest()
        self.table.commit(act(self.table.current(m), self._now()[1]), m, new_log=True)

    def remember(self, **fields) -> dict:
        row = [tuple(fields.get(n) for n in INPUT.fieldNames())]
        return self.remember_many(self.spark.createDataFrame(row, INPUT).withColumn("seq", F.lit(0).cast("long")))[0]

    def _texts(self, text, scope, source, tags):
        return self.spark.createDataFrame([(text, scope, source, list(tags))], "text string, scope string, source string, tags array<string>")

    def preview_ingest(self, text, scope, source="", tags=(), max_items=X.SEGMENTS, kind=None, importance=None, certainty=None) -> list[dict]:
        return [r.asDict() for r in segment.preview(self._texts(text, scope, source, tags), max_items, kind, importance, certainty).orderBy("seq").collect()]

    def ingest(self, text, scope, source="", tags=(), max_items=X.SEGMENTS, kind=None, importance=None, certainty=None) -> dict:
        report = self.remember_many(segment.preview(self._texts(text, scope, source, tags), max_items, kind, importance, certainty))
        made = sum(r["action"] == "created" for r in report)
        return {"stored": len(report), "created": made, "updated": len(report) - made, "items": report}

    def update(self, id: str, **fields) -> dict:
        fields = {k: v for k, v in fields.items() if v is not None}
        if not fields:
            raise ValueError("update needs at least one field")
        self._need(id)
        row = self.spark.createDataFrame([(id, *fields.values())], T.StructType([T.StructField("id", T.StringType()), *[INPUT[k] for k in fields]]))
        self._change(lambda before, now: lifecycle.update_memories(before, row, now))
        return self.get(id)

    def _need(self, *ids: str) -> None:
        for i in ids:
            if self.get(i) is None:
                raise KeyError(i)

    def delete(self, id: str) -> bool:
        there = self.get(id) is not None
        if there:
            self._change(lambda before, now: lifecycle.delete_memories(before, self._ids(id)))
        return there

    def archive(self, id: str) -> bool:
        return self._flag(id, lifecycle.archive)

    def restore(self, id: str) -> bool:
        return self._flag(id, lifecycle.restore)

    def _flag(self, id, act) -> bool:
        there = self.get(id) is not None
        if there:
            self._change(lambda before, now: act(before, self._ids(id), now))
        return there

    def revise(self, new_id: str, old_id: str) -> dict:
        if new_id == old_id:
            raise ValueError("a memory cannot supersede itself")
        self._need(new_id, old_id)
        pairs = self.spark.createDataFrame([(old_id, new_id)], "old_id string, new_id string")
        self._change(lambda before, now: lifecycle.supersede(before, pairs, now))
        return self.get(old_id)

    def decay(self, dry_run: bool = True, **limits) -> DataFrame:
        """What fades (id, title, kind, retention, age_days); archived unless it is a dry run."""
        now = self._now()[1]
        m = self.table.manifest()
        before = self.table.current(m)  # of one snapshot, whatever is committed later
        fading = lifecycle.decay_candidates(before, now, **limits).where("fades").select("id", "title", "kind", "retention", "age_days")
        if not dry_run:
            self.table.commit(lifecycle.archive(before, fading.select("id"), now), m, new_log=True)
        return fading

    def import_file(self, path: str, format: str | None = None) -> dict:
        m = self.table.manifest()
        with upsert.import_memories(self.table.current(m), files.read_import(self.spark, path, format), self._now()[1]) as (after, report):
            counts = {r.action: r.n for r in upsert.action_counts(report).collect()}
            self.table.commit(after, m, new_log=True)
        return {"imported": sum(counts.values()), "created": counts.get("created", 0), "updated": counts.get("updated", 0)}

    # reads
    def get(self, id: str) -> dict | None:
        row = filters.get_memory(self.table.current(), id).first()
        return row.asDict() if row else None

    def list(self, **wanted) -> list[dict]:
        return [r.asDict() for r in filters.list_memories(self.table.current(), **wanted).collect()]

    def _query(self, query, scope, kind, tags) -> DataFrame:
        return self.spark.createDataFrame([(0, query, scope, kind, list(tags))], _QUERY)

    def _recall(self, results: DataFrame) -> None:
        if self.track_access:
            self.table.record_access(results, self._now()[1])

    def search(self, query: str, limit: int = 5, scope=None, kind=None, tags=()) -> list[dict]:
        found = search.search(self._query(query, scope, kind, tags), self.table.current(), self._now()[1], limit, self.table.index(), self.stemming)
        rows = found.orderBy("rank").collect()
        if rows:
            self._recall(self._ids(*[r.id for r in rows]))
        return [r.asDict() for r in rows]

    def context(self, query: str, budget: int = 1200, limit: int = 5, scope=None, kind=None, tags=(), threshold: float = X.NEAR_DUPLICATE) -> dict:
        packs, results = pack.context_packs(self._query(query, scope, kind, tags), self.table.current(), self._now()[1], budget, limit, threshold, self.table.index())
        return self._packed(packs, results)

    def wake_up(self, budget: int = 800, limit: int = 6, scope=None, threshold: float = X.NEAR_DUPLICATE) -> dict:
        packs, results = pack.wake_up_packs(self._query("", scope, None, ()).select("qid", "scope"), self.table.current(), self._now()[1], budget, limit, threshold)
        return self._packed(packs, results)

    def _packed(self, packs: DataFrame, results: DataFrame) -> dict:
        row = packs.first().asDict(True)
        row.pop("qid")
        self._recall(results)
        return row

    def stats(self, since: datetime | None = None) -> dict:
        cutoff = F.lit(since.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp") if since else None
        return {**stats.report(self.table.current(), cutoff).first().asDict(), "engine": "spark"}

    def verify(self, fix: bool = False) -> dict:
        before = verify.verify(self.table.memories(), self.table.index()).first().asDict()
        if not fix or before["healthy"]:
            return {**before, "repaired": 0}
        bad = verify.drift(self.table.memories()).count()
        self._change(lambda memories, now: verify.repair(memories))
        return {**verify.verify(self.table.memories(), self.table.index()).first().asDict(), "repaired": bad}

    def export_jsonl(self, path: str, **wanted) -> None:
        files.export_jsonl(self.table.current(), path, **wanted)

    def export_json(self, **wanted) -> str:
        return files.export_json(self.table.current(), self.table.path, self._now()[1], **wanted).first().json

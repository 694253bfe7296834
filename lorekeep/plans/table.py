"""The stored table: Parquet snapshots under numbered manifests that are never replaced.

A change reads the table at manifest N, writes a snapshot of its own name and
then publishes manifest N + 1, which must not exist yet: of two writers one
succeeds and the other fails with ``ConflictError``, having changed nothing. The
highest manifest is the table; a crash at any step leaves the one before.
Recalls are appended to an access log; a manifest names the log's files that its
snapshot has folded in, so recalls that come during a change are kept. The index
of a snapshot is stored beside it and made from the one before.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep import lexicon as X
from lorekeep.operators import lifecycle
from lorekeep.operators.index import Index, build_index, update_index, vocabulary
from lorekeep.operators.verify import migrate
from lorekeep.schema import ACCESS_LOG, COLUMNS, MEMORIES

ACCESS = "access"


class ConflictError(RuntimeError):
    """Another writer has changed the table since it was read."""


class MemoryTable:
    """A table at a path of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._index: tuple[int, Index] | None = None
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        root = self._hadoop.Path(self.path)
        self._fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._local = urlparse(str(self._fs.makeQualified(root).toString())).path if self._fs.getScheme() == "file" else None

    def _file(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def _names(self, folder: str = "") -> list[str]:
        at = self._file(folder) if folder else self._hadoop.Path(self.path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "MemoryTable":
        """Opens a table, creates an empty one where nothing is, or brings an older version up to date."""
        table = cls(spark, path)
        if not table._numbers():
            if any(n.startswith(("snapshot-", "manifest")) for n in table._names()):
                raise RuntimeError(f"{path} holds snapshots but no manifest that names one; it is no new table")
            try:
                table.commit(spark.createDataFrame([], MEMORIES), {"number": 0, "folded": [], "log": []})
            except ConflictError:  # somebody else has just created it
                pass
        elif (m := table.manifest())["version"] < X.VERSION:
            table.commit(migrate(spark.read.parquet(f"{table.path}/{m['snapshot']}"), m["version"]), m)
        return table

    def _numbers(self) -> list[int]:
        return sorted(int(m[1]) for n in self._names() if (m := re.fullmatch(r"manifest-(\d+)\.json", n)))

    def manifest(self, number: int | None = None) -> dict:
        """The latest manifest, or that of a number; ``log`` names the files of the access log that it hasn't folded in."""
        stream = self._fs.open(self._file(f"manifest-{number or self._numbers()[-1]}.json"))
        try:
            m = json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()
        return {**m, "log": [n for n in self._names(ACCESS) if n.endswith(".parquet") and n not in set(m["folded"])]}

    def memories(self, m: dict | None = None) -> DataFrame:
        return self.spark.read.schema(MEMORIES).parquet(f"{self.path}/{(m or self.manifest())['snapshot']}")

    def access_log(self, m: dict | None = None) -> DataFrame:
        files = [f"{self.path}/{ACCESS}/{n}" for n in (m or self.manifest())["log"]]
        return self.spark.read.schema(ACCESS_LOG).parquet(*files) if files else self.spark.createDataFrame([], ACCESS_LOG)

    def current(self, m: dict | None = None) -> DataFrame:
        """Memories with the recalls of the log folded in."""
        m = m or self.manifest()
        return lifecycle.fold_accesses(self.memories(m), self.access_log(m))

    def commit(self, memories: DataFrame, m: dict, new_log: bool = False) -> None:
        """Writes the next snapshot, by scope and kind within files, and its manifest.

        ``m`` is the manifest that the change was made from; with ``new_log`` the
        change has folded in the recalls that it names.
        """
        number, snapshot = m["number"] + 1, f"snapshot-{m['number'] + 1}-{uuid.uuid4().hex[:12]}"
        memories.select(COLUMNS).sortWithinPartitions("scope", "kind").write.mode("errorifexists").parquet(f"{self.path}/{snapshot}")
        there = set(self._names(ACCESS))
        folded = [n for n in [*m["folded"], *(m["log"] if new_log else [])] if n in there]
        try:
            self._publish(f"manifest-{number}.json", json.dumps({"version": X.VERSION, "number": number, "snapshot": snapshot, "folded": folded}))
        except ConflictError:
            self._fs.delete(self._file(snapshot), True)
            raise

    def _publish(self, name: str, text: str) -> None:
        """A whole new file, or ConflictError if there is one of the name."""
        part = f".{name}.{uuid.uuid4().hex}"
        out = self._fs.create(self._file(part), False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if self._local is not None:  # a link never replaces a file
                os.link(f"{self._local}/{part}", f"{self._local}/{name}")
            elif self._fs.exists(self._file(name)) or not self._fs.rename(self._file(part), self._file(name)):
                raise FileExistsError(name)
        except FileExistsError:
            raise ConflictError(f"{self.path}: another writer has published {name}") from None
        finally:
            if self._fs.exists(self._file(part)):
                self._fs.delete(self._file(part), False)

    def index(self) -> Index:
        """The index of the present snapshot: stored once, from the one of the snapshot before if that is there."""
        m = self.manifest()
        if self._index is None or self._index[0] != m["number"]:
            self.close()
            path = f"index-{m['snapshot']}"
            if not self._fs.exists(self._file(f"{path}/stats/_SUCCESS")):
                self._store_index(m, path)
            postings = self.spark.read.parquet(f"{self.path}/{path}/postings")
            stats = self.spark.read.parquet(f"{self.path}/{path}/stats")
            self._index = (m["number"], Index(postings, vocabulary(postings), stats).persist())
        return self._index[1]

    def _store_index(self, m: dict, path: str) -> None:
        """Written under another name first, so that an index is whole or not there."""
        now, part = self.memories(m), f".{path}.{uuid.uuid4().hex}"
        index = None
        if m["number"] - 1 in self._numbers():
            old = self.manifest(m["number"] - 1)
            if self._fs.exists(self._file(f"index-{old['snapshot']}/stats/_SUCCESS")):
                at = f"{self.path}/index-{old['snapshot']}"
                postings = self.spark.read.parquet(f"{at}/postings")
                index = update_index(Index(postings, vocabulary(postings), self.spark.read.parquet(f"{at}/stats")), now, changed_rows(self.memories(old), now))
        index = index or build_index(now)
        index.postings.write.parquet(f"{self.path}/{part}/postings")
        index.stats.write.parquet(f"{self.path}/{part}/stats")
        if not self._fs.rename(self._file(part), self._file(path)):
            self._fs.delete(self._file(part), True)

    def record_access(self, results: DataFrame, now: Column) -> None:
        results.select("id", now.alias("at")).write.mode("append").parquet(f"{self.path}/{ACCESS}")

    def compact(self) -> None:
        m = self.manifest()
        self.commit(self.current(m), m, new_log=True)

    def vacuum(self, keep: int = 2) -> None:
        """Deletes all but the latest manifests, what no kept manifest names, and recalls that are folded in; readers of older ones fail."""
        numbers = self._numbers()
        kept = [self.manifest(n) for n in numbers[-keep:]]
        named = {m["snapshot"] for m in kept} | {f"index-{m['snapshot']}" for m in kept}
        for n in numbers[:-keep]:
            self._fs.delete(self._file(f"manifest-{n}.json"), False)
        for name in self._names():
            made = re.match(r"(?:index-)?snapshot-(\d+)-", name)
            if made and int(made[1]) <= kept[-1]["number"] and name not in named:  # later ones may be a change in progress
                self._fs.delete(self._file(name), True)
        for name in set.intersection(*[set(m["folded"]) for m in kept]):
            self._fs.delete(self._file(f"{ACCESS}/{name}"), False)

    def close(self) -> None:
        if self._index is not None:
            self._index[1].unpersist()
            self._index = None


def changed_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """(rowid) of rows whose indexed texts differ between two snapshots, or that one of them lacks."""
    print_of = lambda df, name: df.select("rowid", F.xxhash64(*X.WEIGHTS).alias(name))
    both = print_of(old, "a").join(print_of(new, "b"), "rowid", "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("rowid")

"""The one stored table, and the shapes of inputs and reports."""

from pyspark.sql import types as T

_S, _D, _L, _TS = T.StringType(), T.DoubleType(), T.LongType(), T.TimestampType()


def _struct(*fields):
    return T.StructType([T.StructField(n, k, null) for n, k, null in fields])


MEMORIES = _struct(
    ("rowid", _L, False), ("id", _S, False), ("scope", _S, False), ("kind", _S, False), ("title", _S, False), ("summary", _S, False),
    ("content", _S, False), ("tags", T.ArrayType(_S), False), ("tags_text", _S, False), ("stems_text", _S, False), ("source", _S, False),
    ("importance", _D, False), ("certainty", _D, False), ("fingerprint", _S, False), ("access_count", _L, False), ("created_at", _TS, False),
    ("updated_at", _TS, False), ("last_accessed_at", _TS, True), ("archived_at", _TS, True), ("superseded_by", _S, True),
)
COLUMNS = MEMORIES.fieldNames()

INPUT = _struct(
    ("scope", _S, True), ("kind", _S, True), ("title", _S, True), ("content", _S, True), ("summary", _S, True),
    ("tags", T.ArrayType(_S), True), ("source", _S, True), ("importance", _D, True), ("certainty", _D, True),
)

#: What export writes and import reads.
EXPORT = [
    "id", "scope", "kind", "title", "summary", "content", "tags", "source", "importance", "certainty", "access_count",
    "created_at", "updated_at", "last_accessed_at", "archived_at", "superseded_by",
]
IMPORT = T.StructType([T.StructField(n, _S if "_at" in n else MEMORIES[n].dataType, True) for n in EXPORT])

ACCESS_LOG = _struct(("id", _S, False), ("at", _TS, False))

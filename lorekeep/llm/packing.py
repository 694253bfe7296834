"""Token-id output: texts as packed id matrices.

Texts are encoded, split losslessly into pieces of at most ``length`` ids, and
packed by best fit decreasing: from the longest piece on, each goes to the open
row with the least free space that still holds it. A segment tree over free
capacities finds that row in O(log length).

Documents are dealt to shards by a hash of doc_id and ordered by doc_id within
(one exchange of the texts); a task streams its shards and packs ``HOLD_IDS`` ids
at a time, so memory is bounded whatever a shard holds, and a lost task packs the
same rows again. A row of the result is a row of a matrix: ids (little-endian
int32, padded), cumulative segment lengths, positions that start anew with each
segment, and where each segment comes from.

Defined results: null and empty texts have no ids and no segment; very long texts
are cut into pieces of ``length`` ids, none lost; repeated rows are packed each
(``doc_nos`` tells them apart); rows without a doc_id are packed under a null one,
dealt by their text; ids may be of any type; an empty table gives no rows; other
columns of documents are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.byte_bpe import load_ranks, vocabulary
from lorekeep.llm.common import partitions

LENGTH = 2048
#: The vocabulary's free id.
PAD = 50256
#: Ids that a task packs together: 64 MB.
HOLD_IDS = 16_000_000
#: Rows of matrices in a batch of the result: 16 MB of ids and as much of positions at the usual length.
BATCH_ROWS = 2000


class CapacityTree:
    """Open rows by free capacity; a node counts the rows below it."""

    def __init__(self, most: int):
        self.width = 1 << most.bit_length()
        self.count = [0] * (2 * self.width)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        i, count = capacity + self.width, self.count
        while i:
            count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes and returns (capacity, row) of the least capacity that is ``need`` or more; the latest of equals."""
        count, i = self.count, need + self.width
        if not count[i]:
            # up until a right neighbour holds something, then down to its leftmost row
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.width:
                i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.width
        while i:
            count[i] -= 1
            i >>= 1
        return capacity, self.rows[capacity].pop()


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of piece numbers; every size is between 1 and ``length``."""
    tree = CapacityTree(length)
    rows: list[list[int]] = []
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        size = sizes[k]
        found = tree.take(size) if size < length else None
        if found is None:
            rows.append([k])
            left, row = length - size, len(rows) - 1
        else:
            capacity, row = found
            rows[row].append(k)
            left = capacity - size
        if left:
            tree.add(left, row)
    return rows


def _tokenizer(path: str, pattern: str):
    import tiktoken

    enc = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})
    return lambda text: enc.encode_to_numpy(text, disallowed_special=())


#: Columns of a row; {0} is the type of doc_id.
SCHEMA = (
    "shard long, row long, n_tokens long, ids binary, cu_seqlens array<int>, positions binary, "
    "doc_ids array<{0}>, doc_nos array<long>, offsets array<long>"
)


def pack(docs: DataFrame, length: int = LENGTH, pad: int = PAD, path: str | None = None, pattern: str | None = None, shards: int | None = None) -> DataFrame:
    """Rows of packed matrices."""
    import pyarrow as pa

    if path is None:
        path, pattern = vocabulary()
    shards = shards or partitions(docs.sparkSession)
    shard = F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), F.lit(shards)).alias("shard")
    schema = SCHEMA.format(docs.schema["doc_id"].dataType.simpleString())
    dealt = (
        docs.select(shard, "doc_id", "text")
        .where("text is not null and text != ''")
        .repartition(shards, "shard")
        .sortWithinPartitions("shard", "doc_id", F.xxhash64("text"))
    )

    def matrices(shard, first_row, rows, id_type):
        """One batch of rows of pieces: (doc_id, doc_no, offset, ids)."""
        cols: list[list] = [[] for _ in range(9)]
        for n, own in enumerate(rows):
            sizes = [len(p[3]) for p in own]
            total = sum(sizes)
            ids = np.full(length, pad, "<i4")
            ids[:total] = np.concatenate([p[3] for p in own])
            cu = np.r_[0, np.cumsum(sizes)].astype(np.int32)
            positions = np.arange(length, dtype="<i4")
            positions[:total] -= np.repeat(cu[:-1], sizes)
            positions[total:] -= total
            values = [shard, first_row + n, total, ids.tobytes(), cu, positions.tobytes(), *[[p[k] for p in own] for k in range(3)]]
            for c, v in zip(cols, values, strict=True):
                c.append(v)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = {"ids": pa.binary(), "positions": pa.binary(), "cu_seqlens": pa.list_(pa.int32()), **{c: pa.list_(pa.int64()) for c in ("doc_nos", "offsets")}, "doc_ids": pa.list_(id_type)}
        return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names, cols, strict=True)], names)

    def emit(shard, first_row, held, id_type):
        """Packs what is held: (doc_id, doc_no, ids)."""
        pieces = [(d, no, o, ids[o : o + length]) for d, no, ids in held for o in range(0, len(ids), length)]
        rows = best_fit_decreasing([len(p[3]) for p in pieces], length)
        for i in range(0, len(rows), BATCH_ROWS):
            yield matrices(shard, first_row + i, [[pieces[k] for k in row] for row in rows[i : i + BATCH_ROWS]], id_type)
        return len(rows)

    def run(batches):
        encode = _tokenizer(path, pattern)
        at, held, size, row, no, id_type = None, [], 0, 0, 0, None
        for b in batches:
            id_type = b.column("doc_id").type
            for s, d, text in zip(b.column("shard").to_pylist(), b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if held and (s != at or size >= HOLD_IDS):
                    row += yield from emit(at, row, held, id_type)
                    held, size = [], 0
                if s != at:
                    at, row, no = s, 0, 0
                ids = encode(text)
                held.append((d, no, ids))
                size += len(ids)
                no += 1
        if held:
            yield from emit(at, row, held, id_type)

    return dealt.mapInArrow(run, schema)


def write(packed: DataFrame, path: str) -> None:
    """Writes the matrices as Parquet, one folder per shard: fixed-size binary rows that map to int32 matrices."""
    packed.write.mode("errorifexists").partitionBy("shard").parquet(path)


def unpack(packed: DataFrame) -> DataFrame:
    """(shard, doc_no, doc_id, ids): the documents' ids again, whole."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for s, ids, cu, d, n, o in zip(*[b.column(c).to_pylist() for c in ("shard", "ids", "cu_seqlens", "doc_ids", "doc_nos", "offsets")], strict=True):
                flat = np.frombuffer(ids, "<i4")
                for k in range(len(d)):
                    for c, v in zip(out, (s, n[k], d[k], o[k], flat[cu[k] : cu[k + 1]]), strict=True):
                        c.append(v)
            kinds = [pa.int64(), pa.int64(), b.column("doc_ids").type.value_type, pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["shard", "doc_no", "doc_id", "offset", "ids"])

    id_type = packed.schema["doc_ids"].dataType.elementType.simpleString()
    pieces = packed.select("shard", "ids", "cu_seqlens", "doc_ids", "doc_nos", "offsets").mapInArrow(run, f"shard long, doc_no long, doc_id {id_type}, offset long, ids array<int>")
    whole = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"]))
    return pieces.groupBy("shard", "doc_no", "doc_id").agg(whole.alias("ids"))


def query(spark, sf_dir: str) -> DataFrame:
    from lorekeep.llm.common import table

    return pack(table(spark, sf_dir, "documents"))

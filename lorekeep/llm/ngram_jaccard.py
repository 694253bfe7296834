"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct word shingles. The parity sketch of a set
has one bit for each value of a 64-bit shingle hash, flipped by each shingle that
has the value; two sketches differ in at most as many bits as the sets differ in
shingles (|A xor B|). Jaccard similarity of num/den bounds that difference by
(den - num)(a + b) / (den + num).

1. Documents of equal sets are one class, represented by the smallest doc_id.
2. Size bands: each band ends where the smallest partner of a larger set would
   start, so linked sets lie in one of the windows of two neighbouring bands.
3. Pigeonhole: in a window whose linked sets differ in at most D shingles, the
   sketch is dealt into p > D pieces; linked sets agree in p - D pieces or more.
   The XOR of a piece's bits' hashes stands for the piece, with window and place
   it is the join key. Pieces of fewer than two shingles agree by chance; a set
   leaves them out as long as it has fewer of them than p - D, so that one piece
   of two or more must agree still. Sets with more emit them all.
4. Equal keys join: per batch, then per part of the key space, every holder of a
   key is tied to one other. A hot key leaves a batch once. The ties' connected
   components are candidate clusters; each set goes to its cluster once.
5. Within a cluster, sets that share a key and are not connected yet are
   compared: Hamming distance of folded sketches (a lower bound again), then the
   exact intersection; if links are counted, also those that are connected.
   Clusters beyond ``BLOCK`` shingles, or of more than a fair
   share of all, are dealt into blocks and compared block by block, so no task
   holds more than two blocks.
6. The links' components, by smallest doc_id.

Defined results: null, empty and wordless texts have no shingles and are alone;
texts of fewer words than a shingle have one, the whole sequence; very long texts
are taken whole; rows of the same doc_id are one document, linked by any of its
texts; a null doc_id has a null component and no links; an empty table gives an
empty table; ids of a type that is no integer are refused; other columns are not
read and not returned.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.llm.common import cut, partitions, release, small
from lorekeep.llm.graph import components

#: Shingles of a block: 8 MB of hashes.
BLOCK = 1_000_000
#: Shingles for each part of the key space, at most: a set emits a key for every two or three of them, of 16 bytes.
PART_SHINGLES = 4_000_000
#: Blocks that a cluster is dealt into, at most, for the sake of even work alone.
SPREAD = 8
#: Text that is hashed at once, keys that leave a task at once, words that a worker remembers.
CHUNK_BYTES, FLUSH_KEYS, MEMO_WORDS = 2_000_000, 600_000, 250_000
#: Bits of the folded sketches that are compared before the sets are.
FOLDED = 2048

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class _Memo(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_MEMO = _Memo()


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words of an ASCII-lower-cased text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if len(_MEMO) > MEMO_WORDS:
        _MEMO.clear()
    return np.fromiter(map(_MEMO.__getitem__, words), np.uint64, len(words))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    w = word_hashes(text)
    n = len(w)
    if not n:
        return w
    width_ = min(width, n)
    h = np.full(n - width_ + 1, width_, np.uint64)
    for k in range(width_):
        h = mix(h * _M1 + w[k : n - width_ + 1 + k])
    return np.unique(h)


class Bands:
    """Size bands and what their windows need, for a similarity of num / den."""

    def __init__(self, num: int, den: int, upto: int = 1 << 40):
        self.num, self.den = num, den
        lows = [1]
        while lows[-1] < upto:
            lows.append(den * lows[-1] // num + 1)
        self.lows = np.array(lows, np.int64)
        high = np.array(lows[2:], np.int64) - 1  # of window k: bands k and k + 1
        self.differ = (den - num) * 2 * high // (den + num)
        self.pieces = self.differ + 2 + self.differ // 16

    def band(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lows, sizes, "right") - 1

    def differ_of(self, sizes: np.ndarray, window: np.ndarray) -> np.ndarray:
        """The most that a set of this size can differ from a linked one of the window."""
        partner = np.minimum(self.den * sizes // self.num, self.lows[window + 2] - 1)
        return (self.den - self.num) * (sizes + partner) // (self.den + self.num)

    def keys(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(key, index of the set) of all pieces that the sets emit."""
        sizes = np.array([len(s) for s in sets], np.int64)
        which = np.flatnonzero(sizes)
        if not len(which):
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        out_k, out_i = [], []
        band = self.band(np.maximum(sizes, 1))
        for back in (0, 1):
            own = which[band[which] - back >= 0]
            own = own[self.differ[band[own] - back] > 0]  # else linked sets are equal
            if not len(own):
                continue
            win = band[own] - back
            p, n = self.pieces[win], sizes[own]
            tokens = np.concatenate([sets[i] for i in own])
            at = np.repeat(np.cumsum(p) - p, n)
            bits = mix(tokens ^ np.repeat(win.astype(np.uint64) * _M1, n))
            piece = at + ((bits >> np.uint64(11)) % np.repeat(p, n).astype(np.uint64)).astype(np.int64)
            total = int(p.sum())
            order = np.argsort(piece, kind="stable")
            sorted_piece = piece[order]
            count = np.bincount(piece, minlength=total)
            filled = np.flatnonzero(count)
            value = np.zeros(total, np.uint64)
            value[filled] = np.bitwise_xor.reduceat(mix(bits[order] + _M1), np.searchsorted(sorted_piece, filled))
            doc = np.repeat(np.arange(len(own)), p)
            place = np.arange(total) - np.repeat(np.cumsum(p) - p, p)
            must = p - self.differ_of(n, win)  # pieces that agree at least
            few = np.bincount(doc[count < 2], minlength=len(own))
            none = np.bincount(doc[count < 1], minlength=len(own))
            least = np.where(few < must, 2, np.where(none < must, 1, 0))
            emit = count >= least[doc]
            tag = mix(win[doc[emit]].astype(np.uint64) * _M2 + place[emit].astype(np.uint64) * _M1)
            out_k.append(mix(value[emit] ^ tag))
            out_i.append(own[doc[emit]])
        if not out_k:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        return np.concatenate(out_k), np.concatenate(out_i)

    def keys_of_many(self, sets: list[np.ndarray], at_once: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
        """``keys`` of some shingles at a time."""
        out_k, out_i, i = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
        while i < len(sets):
            j, size = i, 0
            while j < len(sets) and (j == i or size < at_once):
                size += len(sets[j])
                j += 1
            k, own = self.keys(sets[i:j])
            out_k.append(k)
            out_i.append(own + i)
            i = j
        return np.concatenate(out_k), np.concatenate(out_i)


def ties(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with their smallest document, and the ties (document, smallest) of the others."""
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    head = docs[first][np.cumsum(first) - 1]
    other = ~first & (docs != head)
    pairs = np.unique(np.stack([docs[other], head[other]]), axis=1) if other.any() else np.empty((2, 0), np.int64)
    return keys[first], docs[first], pairs[0], pairs[1]


def folded(s: np.ndarray) -> np.ndarray:
    """The parity sketch folded to FOLDED bits, as 64-bit words."""
    bits = np.bincount((mix(s) % np.uint64(FOLDED)).astype(np.int64), minlength=FOLDED) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


class Members:
    """The sets of a cluster with their shingles numbered, so that an intersection is a look-up in a mask."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        distinct, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.start = np.cumsum(self.sizes) - self.sizes
        self.mask = np.zeros(len(distinct), bool)

    def of(self, i: int) -> np.ndarray:
        return self.flat[self.start[i] : self.start[i] + self.sizes[i]]

    def common(self, i: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of set i with others."""
        self.mask[self.of(i)] = True
        if 4 * self.sizes[others].sum() > len(self.flat):
            out = np.add.reduceat(self.mask[self.flat].astype(np.int64), self.start)[others]
        else:
            out = np.array([np.count_nonzero(self.mask[self.of(j)]) for j in others.tolist()], np.int64)
        self.mask[self.of(i)] = False
        return out


def links_within(sets: list[np.ndarray], side: np.ndarray, bands: Bands, copies: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(links that connect what is linked, as pairs of indices; number of linked documents by set).

    side: sets of 0 and 1 are compared across, 2 with all; none is empty. Without
    ``copies``, the documents that each set stands for, pairs that are connected
    already are passed over and nothing is counted.
    """
    n = len(sets)
    degree = np.zeros(n, np.int64)
    out: list[tuple[int, int]] = []
    if n < 2:
        return out, degree
    sizes = np.array([len(s) for s in sets], np.int64)
    keys, own = bands.keys_of_many(sets)
    order = np.argsort(keys, kind="stable")
    keys, own = keys[order], own[order]
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    stop = np.r_[start[1:], len(keys)].astype(np.int64)
    many = stop - start > 1
    start, stop = start[many], stop[many]
    groups_of: list[list[int]] = [[] for _ in range(n)]
    for g, (a, b) in enumerate(zip(start.tolist(), stop.tolist(), strict=True)):
        for i in own[a:b].tolist():
            groups_of[i].append(g)
    sketch = np.stack([folded(s) for s in sets])
    members = Members(sets)
    label = np.arange(n)
    seen = np.zeros(n, bool)
    # those that share the most come first: they tie the others together early
    weight = np.array([sum(int(stop[g] - start[g]) for g in gs) for gs in groups_of], np.int64)
    rank = np.empty(n, np.int64)
    by_weight = np.argsort(-weight, kind="stable")
    rank[by_weight] = np.arange(n)
    num, den = bands.num, bands.den
    for i in by_weight.tolist():
        if not groups_of[i]:
            continue
        seen[:] = False
        for g in groups_of[i]:
            seen[own[start[g] : stop[g]]] = True
        cand = np.flatnonzero(seen)
        cand = cand[rank[cand] > rank[i]]
        if copies is None:
            cand = cand[label[cand] != label[i]]
        if side[i] != 2:
            cand = cand[side[cand] != side[i]]
        a, b = sizes[i], sizes[cand]
        cand = cand[num * np.maximum(a, b) <= den * np.minimum(a, b)]
        if not len(cand):
            continue
        far = np.bitwise_count(sketch[cand] ^ sketch[i]).sum(axis=1, dtype=np.int64)
        cand = cand[far * (den + num) <= (den - num) * (a + sizes[cand])]
        if not len(cand):
            continue
        common = members.common(i, cand)
        cand = cand[den * common >= num * (a + sizes[cand] - common)]
        if copies is not None:
            degree[i] += copies[cand].sum()
            degree[cand] += copies[i]
        for j in cand.tolist():
            if label[j] != label[i]:
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out, degree


def _chunks(texts: list[str | None]):
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size < CHUNK_BYTES):
            size += len(texts[j] or "")
            j += 1
        yield i, texts[i:j]
        i = j


def set_hashes(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles and 128 bits of hash of the set."""
    import pyarrow as pa

    def run(batches):
        import xxhash

        for b in batches:
            n, h1, h2 = [], [], []
            for t in b.column("text").to_pylist():
                s = shingle_set(t, width)
                d = xxhash.xxh3_128_digest(s.tobytes())
                n.append(len(s))
                h1.append(int.from_bytes(d[:8], "little", signed=True))
                h2.append(int.from_bytes(d[8:], "little", signed=True))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())], ["doc_id", "n_shingles", "h1", "h2"])
        _MEMO.clear()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long")


def candidate_ties(docs: DataFrame, width: int, bands: Bands, parts: int) -> DataFrame:
    """Ties (u, v) between documents that share a key."""
    import pyarrow as pa

    names = ["part", "keys", "docs"]

    def emit(keys, docs):
        keys, docs, u, v = ties(keys, docs)
        part = (keys % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[order], np.arange(parts + 1))
        rows = [(p, keys[order[a:b]].tobytes(), docs[order[a:b]].tobytes()) for p, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
        if len(u):  # ties within the batch travel as they are, under a negative part
            rows.append((-1 - int(u[0]) % parts, u.tobytes(), v.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names)

    def run(batches):
        held_k, held_d, held = [], [], 0
        for b in batches:
            ids = np.array(b.column("doc_id").to_pylist(), np.int64)
            for at, texts in _chunks(b.column("text").to_pylist()):
                sets, seen, idx = [], set(), []
                for k, t in enumerate(texts):
                    s = shingle_set(t, width)
                    if len(s) and (h := s.tobytes().__hash__()) not in seen:  # equal sets of a chunk are joined elsewhere
                        seen.add(h)
                        sets.append(s)
                        idx.append(at + k)
                k, i = bands.keys(sets)
                held_k.append(k)
                held_d.append(ids[np.array(idx, np.int64)[i]] if len(i) else np.empty(0, np.int64))
                held += len(k)
                if held >= FLUSH_KEYS:
                    yield emit(np.concatenate(held_k), np.concatenate(held_d))
                    held_k, held_d, held = [], [], 0
        if held:
            yield emit(np.concatenate(held_k), np.concatenate(held_d))
        _MEMO.clear()

    def gather(table: pa.Table) -> pa.Table:
        """The ties of one part of the key space, packed by part of the documents."""
        keys = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()])
        docs = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("docs").to_pylist()])
        if table.column("part")[0].as_py() < 0:
            u, v = keys.view(np.int64), docs
        else:
            _, _, u, v = ties(keys, docs)
        part = (mix(u.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[order], np.arange(parts + 1))
        rows = [(p, u[order[a:b]].tobytes(), v[order[a:b]].tobytes()) for p, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int64()), "keys": pa.array([r[1] for r in rows], pa.binary()), "docs": pa.array([r[2] for r in rows], pa.binary())})

    def distinct(table: pa.Table) -> pa.Table:
        """A document pair may share keys of many parts."""
        u, v = (np.concatenate([np.frombuffer(x, np.int64) for x in table.column(c).to_pylist()]) for c in ("keys", "docs"))
        u, v = np.unique(np.stack([u, v]), axis=1)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    schema = "part long, keys binary, docs binary"
    blobs = docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(run, schema)
    packed = blobs.groupBy("part").applyInArrow(gather, schema)
    return packed.groupBy("part").applyInArrow(distinct, "u long, v long")


def cluster_links(docs: DataFrame, members: DataFrame, width: int, bands: Bands, count: bool) -> DataFrame:
    """Links inside candidate clusters. members: doc_id, cluster, n_shingles, copies.

    Rows (u, v, null) connect what is linked; with ``count``, rows (u, null, n) sum up to the documents linked with u.
    """
    import pyarrow as pa

    size = members.groupBy("cluster").agg(F.sum("n_shingles").alias("total"))
    total = members.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    buckets = max(2 * partitions(docs.sparkSession), int(total // BLOCK) + 1)
    # a cluster of more than a fair share of all shingles is spread over tasks as well
    tasks = partitions(docs.sparkSession)
    spread = F.least(F.lit(SPREAD), F.ceil(F.sqrt(F.col("total") * (2.0 * tasks / max(total, 1)))))
    blocks = F.greatest(F.ceil(F.col("total") / BLOCK), F.when(F.col("total") * tasks > 2 * total, spread).otherwise(1)).cast("int")
    members = (
        members.join(size, "cluster")
        .withColumn("blocks", blocks)
        .withColumn("block", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("doc_id"), F.col("blocks"))).otherwise(F.lit(0)).cast("int"))
        .select("doc_id", "cluster", "blocks", "block", "copies")
    )
    # members are broadcast up to a bound, so that only their sets are shuffled and no text is
    joined = docs.join(small(cut(members)), "doc_id")

    def run(batches):
        for b in batches:
            sets = [shingle_set(t, width).tobytes() for t in b.column("text").to_pylist()]
            names = ["doc_id", "cluster", "blocks", "block", "copies"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(sets, pa.binary())], [*names, "hashes"])
        _MEMO.clear()

    sets = joined.mapInArrow(run, "doc_id long, cluster long, blocks int, block int, copies long, hashes binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = sets.select("*", other).select(
        F.when(F.col("blocks") > 1, F.col("cluster")).otherwise(F.pmod(F.xxhash64("cluster"), F.lit(buckets))).alias("g"),
        (F.col("blocks") > 1).alias("large"),
        F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"),
        "cluster",
        "block",
        "doc_id",
        "copies",
        "hashes",
    )

    def compare(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        cluster = table.column("cluster").to_numpy()
        ids = table.column("doc_id").to_numpy()
        block = table.column("block").to_numpy()
        order = np.lexsort((ids, cluster))
        starts = np.flatnonzero(np.r_[True, cluster[order][1:] != cluster[order][:-1]])
        copies = table.column("copies").to_numpy()
        hashes = table.column("hashes")
        u, v, n = [], [], []
        for a, b in zip(starts, np.r_[starts[1:], len(order)], strict=True):
            own, sets, last = [], [], None
            for k in order[a:b].tolist():
                raw = hashes[k].as_py()
                if raw and (ids[k], raw) != last:  # repeated rows of a document are one
                    last = (ids[k], raw)
                    own.append(k)
                    sets.append(np.frombuffer(raw, np.uint64))
            own = np.array(own, np.int64)
            side = np.full(len(own), 2) if i == j else (block[own] == j).astype(np.int64)
            found, degree = links_within(sets, side, bands, copies[own] if count else None)
            for x, y in found:
                u.append(int(ids[own[x]]))
                v.append(int(ids[own[y]]))
                n.append(None)
            for x in np.flatnonzero(degree).tolist():
                u.append(int(ids[own[x]]))
                v.append(None)
                n.append(int(degree[x]))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "n": pa.array(n, pa.int64())})

    return dealt.groupBy("g", "large", "i", "j").applyInArrow(compare, "u long, v long, n long")


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, count: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id: documents of a Jaccard similarity of num / den or more are linked.

    With ``count`` also n_links: how many other documents each one is linked with,
    copies included. That verifies every pair that shares a key, not only what
    connects the component.
    """
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("doc_id must be of an integer type")
    bands = Bands(num, den)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hashed = cut(set_hashes(docs, width))
    sets = hashed.where("n_shingles > 0 and doc_id is not null")
    # written first, so that the join below has exchanges on both sides and Spark may split a large class
    classes = cut(sets.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")))
    of = cut(sets.join(classes, ["h1", "h2"]).groupBy("doc_id").agg(F.min("rep").alias("rep"), F.max("n_shingles").alias("n_shingles")))
    size = cut(of.groupBy("rep").agg(F.count("*").alias("copies")))

    # a part of the key space is held by one task: by the number of shingles, whatever the number of partitions is
    total = hashed.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    tied = candidate_ties(docs, width, bands, max(partitions(docs.sparkSession), -(-total // PART_SHINGLES)))
    rep = lambda c: of.select(F.col("doc_id").alias(c), F.col("rep").alias(f"{c}r"))
    tied = tied.join(rep("u"), "u").join(rep("v"), "v").where("ur <> vr").select(F.col("ur").alias("u"), F.col("vr").alias("v"))
    clusters = components(tied)
    members = clusters.join(of, clusters.node == of.doc_id).join(size, "rep").select("doc_id", F.col("component").alias("cluster"), "n_shingles", "copies")
    members = cut(members)
    release(docs.sparkSession)  # the keys' exchange, before the sets' one is written
    links = cut(cluster_links(docs, members, width, bands, count))
    release(docs.sparkSession)
    found = components(links.where("v is not null").select("u", "v"))

    by_class = size.join(found, size.rep == found.node, "left").select("rep", "copies", F.coalesce("component", "rep").alias("component_id"))
    columns = ["doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")]
    if count:
        linked = links.where("n is not null").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n"))
        by_class = by_class.join(linked, "rep", "left").withColumn("links", F.col("copies") - 1 + F.coalesce("n", F.lit(0)))
        columns.append(F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))
    # a row by class, written first: Spark may split a large class in the one join that its documents need
    of = of.select("doc_id", "rep").join(cut(by_class), "rep")
    return hashed.select("doc_id", "n_shingles").join(of, "doc_id", "left").select(*columns)


def query(spark, sf_dir: str) -> DataFrame:
    from lorekeep.llm.common import table

    return jaccard_components(table(spark, sf_dir, "documents"), width=4, num=85, den=100, count=True)

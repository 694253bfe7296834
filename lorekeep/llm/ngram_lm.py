"""LM scoring: an interpolated modified Kneser-Ney model of any order from 2 on (the query's is ``ORDER``).

    p(w | u) = max(c(uw) - D, 0) / c(u) + g(u) p(w | u less its first word)
    p(w)     = (N1+(. w) - D) / N1+(. .) + g1 / (V + 1)

c counts n-grams at the highest order, distinct predecessors below it. Discounts
D1, D2, D3+ come from counts of counts at every level (Chen, Goodman). A text has
order - 1 begin tokens ahead of it.

1. Unigrams and n-grams of the training texts are counted, task by task; counts
   leave a task combined, as packed arrays by part of the hash space. That is done
   in rounds, each over all texts and for a span of the parts, so that the exchange
   of one round is there at a time.
2. Each part is merged and written to the shared folder as sorted hash arrays:
   n-gram counts, and what their contexts need. Numbers of distinct predecessors
   of the n-grams one word shorter go on to the next level, down to the words, as
   runs in the shared folder: one file by part and span, deleted once it is merged.
3. Workers memory-map the arrays and score texts by binary search, in sorted
   batches. Only sums of counts reach the driver.

Arrays of n-grams and contexts leave out the top 16 bits of their hashes, which a
table of offsets gives; contexts' sums are numbers of the distinct ones.

Words are known by 64-bit hashes (48 bits as followers, the rest of 64 for
n-grams), contexts by 64-bit hashes; nothing is pruned, so the model grows with
the corpus. All counts of one context meet in one part, after they are combined:
a hot context costs one entry for each distinct follower and, below the highest
order, for each part that its longer contexts lie in. The arrays are the model:
``train`` returns it for use in other jobs; a task that is run again writes the
same files again.

Defined results: null and empty texts have the end token alone; the empty
training set gives the uniform model; a null doc_id counts as the empty string
in the split; very long texts are read whole; repeated rows count and are scored
each; an empty table gives an empty table; extra columns, whatever their names,
stay unless they clash with the added names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import partitions, set_aside, shared_path
from lorekeep.llm.ngram_jaccard import mix
from lorekeep.llm.shared_arrays import SharedArrays

U = np.uint64
#: Hashes of the end token and of the context of a first word; words hold no blanks, these texts do.
END, BEGIN = U(0xE5A1D3F0B6C79284), U(0x1B7C93A5F2D8E460)
#: Tokens that are counted, and bytes of text that are hashed for it or scored, at once.
COUNT_TOKENS, COUNT_BYTES, SCORE_BYTES = 2_500_000, 4_000_000, 4_000_000
#: Order of a model, and of the query's.
ORDER = 3
#: Characters of training text for each part of the hash space, at most: what one task merges.
PART_CHARS = 30_000_000
#: Rounds, at most; characters of training text for each, at least.
ROUNDS, ROUND_CHARS = 4, 10_000_000
#: Spark's setting by which a job's exchanges are deleted as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Parts are ranges of the hash space."""
    return (((h >> U(32)) * U(parts)) >> U(32)).astype(np.int64)


def pair_keys(v: np.ndarray, follower: np.ndarray, parts: int) -> np.ndarray:
    """Keys of n-grams: the context's part in the top bits, then a hash of both."""
    bits = U(parts.bit_length())
    return (part_of(v, parts).astype(U) << (U(64) - bits)) | (mix(mix(v) + follower) >> bits)


def pieces(texts, most: int):
    """An Arrow array in slices of some bytes of text each, a text at least."""
    import pyarrow.compute as pc

    ends, i = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield texts.slice(i, j - i)
        i = j


def hashed_words(texts) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of the ASCII-lower-cased texts in a row, number of words by text), as ``word_hashes`` gives them; each distinct word is hashed once."""
    import pyarrow as pa
    import pyarrow.compute as pc
    import xxhash

    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = split.flatten()
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    upto = np.r_[0, np.cumsum(full)]
    at = split.offsets.to_numpy()
    coded_ = words.filter(pa.array(full)).dictionary_encode()
    distinct = coded_.dictionary.view(pa.large_binary() if pa.types.is_large_string(words.type) else pa.binary()).to_numpy(zero_copy_only=False).tolist()
    h = np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))
    return h[coded_.indices.to_numpy(zero_copy_only=False)], np.diff(upto[at - at[0]])


def padded(words: np.ndarray, n: np.ndarray, order: int) -> np.ndarray:
    """The tokens of texts in a row, of n words each: order - 1 BEGINs, the words, END."""
    begin = np.cumsum(n + order) - (n + order) + order - 1
    out = np.full(len(words) + order * len(n), BEGIN)
    out[np.arange(len(words)) + np.repeat(begin - (np.cumsum(n) - n), n)] = words
    out[begin + n] = END
    return out


def contexts(tokens: np.ndarray, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places of the tokens that are no BEGIN; hashes of the order - 1, .., 2, 1 tokens before each (one is the token itself)."""
    at = np.flatnonzero(tokens != BEGIN)
    out = [tokens[at - 1]]
    for k in range(2, order):
        out.append(mix(mix(out[-1]) + tokens[at - k]))
    return at, out[::-1]


def _join(parts: list[np.ndarray], dtype) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, dtype)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def packed_runs(level: int, context: np.ndarray, length: np.ndarray, follower: np.ndarray, n: np.ndarray, parts: int):
    """Rows (level, part, packed arrays) of n-grams, which lie by context. context: level - 1 rows, sorted by the first."""
    bounds = np.searchsorted(part_of(context[0], parts), np.arange(parts + 1))
    ends = np.r_[0, np.cumsum(length)]
    for p in range(parts):
        a, b = bounds[p], bounds[p + 1]
        if b > a:
            i, j = ends[a], ends[b]
            f = follower[i:j]
            yield str(level), p, [np.ascontiguousarray(context[:, a:b]).tobytes(), length[a:b].astype(np.uint32).tobytes(), (f & U(0xFFFFFFFF)).astype(np.uint32).tobytes(), (f >> U(32)).astype(np.uint16).tobytes(), n[i:j].astype(np.uint32).tobytes()]


def count_chunk(tokens: np.ndarray, parts: int, order: int, low: int, high: int):
    """tokens: texts in a row, each between BEGINs and END. Rows (kind, part, packed arrays) of the combined counts of parts low to high; words are all counted with the first."""
    if low == 0:
        words, count = np.unique(tokens, return_counts=True)
        real = words != BEGIN
        words, count = words[real], count[real]
        bounds = np.searchsorted(part_of(words, parts), np.arange(parts + 1))
        for p in range(parts):
            a, b = bounds[p], bounds[p + 1]
            if b > a:
                yield "u", p, [words[a:b].tobytes(), count[a:b].astype(np.uint32).tobytes()]
    inner, context = contexts(tokens, order)
    own = part_of(context[0], parts)
    keep = np.flatnonzero((own >= low) & (own < high))
    if not len(keep):
        return
    head, first, v = np.unique(context[0][keep], return_index=True, return_inverse=True)
    context = np.stack([head, *[x[keep[first]] for x in context[1:]]])
    words, at = np.unique(tokens[inner[keep]], return_inverse=True)
    grams, n = np.unique((v.astype(U) << U(32)) | at.astype(U), return_counts=True)
    length = np.bincount((grams >> U(32)).astype(np.int64), minlength=len(head))
    yield from packed_runs(order, context, length, words[(grams & U(0xFFFFFFFF)).astype(np.int64)] >> U(16), n, parts)


def narrow(a: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in the smallest type that holds them."""
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


def write_keys(store: SharedArrays, name: str, keys: np.ndarray) -> None:
    """Sorted distinct keys: the lower 48 bits as three rows of digits; the first of the top 16 bits' values, and where each value begins."""
    digits = np.stack([(keys >> U(k)).astype(np.uint16) for k in (32, 16, 0)])
    top = (keys >> U(48)).astype(np.int64)
    first, last = (int(top[0]), int(top[-1])) if len(top) else (0, -1)
    store.write(f"{name}-key", digits)
    store.write(f"{name}-at", narrow(np.r_[first, np.searchsorted(top, np.arange(first, last + 2))]))


def places(digits: np.ndarray, at: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where the keys stand, -1 for those that are not there."""
    out = np.full(len(keys), -1, np.int64)
    if not digits.shape[1]:
        return out
    top = (keys >> U(48)).astype(np.int64) - int(at[0])
    own = np.flatnonzero((top >= 0) & (top < len(at) - 2))
    lead, low, digit = digits[0], at[1:][top[own]].astype(np.int64), (keys[own] >> U(32)).astype(np.uint16)
    high = end = at[2:][top[own]].astype(np.int64)
    for _ in range(int((high - low).max(initial=0)).bit_length()):
        mid = (low + high) >> 1
        less = (mid < high) & (lead[np.minimum(mid, len(lead) - 1)] < digit)
        low, high = np.where(less, mid + 1, low), np.where(less, high, mid)
    rest = keys[own] & U(0xFFFFFFFF)
    left = np.flatnonzero(low < end)
    while len(left):  # keys whose first digit is the same follow each other
        left = left[lead[low[left]] == digit[left]]
        i = low[left]
        hit = (digits[1][i].astype(U) << U(16) | digits[2][i].astype(U)) == rest[left]
        out[own[left[hit]]] = i[hit]
        left = left[~hit]
        low[left] += 1
        left = left[low[left] < end[left]]
    return out


def coded(stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each row's kind, the kinds): rows of four small numbers are mostly alike."""
    small = (stats < 1 << 16).all(axis=1)
    shifts = np.array([48, 32, 16, 0], U)
    kinds, code = np.unique((stats[small].astype(U) << shifts).sum(axis=1, dtype=U), return_inverse=True)
    out = np.empty(len(stats), np.int64)
    out[small] = code
    out[~small] = len(kinds) + np.arange(len(stats) - len(code))
    table = np.concatenate([((kinds[:, None] >> shifts) & U(0xFFFF)).astype(np.int64), stats[~small]])
    return narrow(out), narrow(table)


class Runs:
    """What the parts of a level hand on: compressed arrays by target part, a file by part and span of targets."""

    def __init__(self, store: SharedArrays, spans: list[tuple[int, int]]):
        self.store, self.spans = store, spans

    def write(self, level: int, p: int, rows) -> None:
        import pyarrow as pa

        of = {q: arrays for _, q, arrays in rows}
        for k, (low, high) in enumerate(self.spans):
            at, data = np.zeros((high - low, 6), np.int64), []
            for q in range(low, high):
                if q in of:
                    data.append(pa.compress(b"".join(of[q]), codec="lz4", asbytes=True))
                    at[q - low, : len(of[q]) + 1] = [len(data[-1]), *map(len, of[q])]
            self.store.write(f"r{level}-{p}-{k}", np.array(bytearray(b"".join(data)), np.uint8))
            self.store.write(f"r{level}-{p}-{k}-at", at)

    def read(self, level: int, k: int, q: int, sources: list[int]) -> list[list[bytes]]:
        """The five lists of arrays for part q of span k."""
        import pyarrow as pa

        out: list[list[bytes]] = [[] for _ in range(5)]
        for p in sources:
            at = self.store.read(f"r{level}-{p}-{k}-at")
            own = at[q - self.spans[k][0]]
            if own[0]:
                begin = int(at[: q - self.spans[k][0], 0].sum())
                packed = self.store.read(f"r{level}-{p}-{k}")[begin : begin + int(own[0])].tobytes()
                raw, a = pa.decompress(packed, int(own[1:].sum()), codec="lz4", asbytes=True), 0
                for column, size in zip(out, own[1:].tolist(), strict=True):
                    column.append(raw[a : a + size])
                    a += size
        return out

    def drop(self, level: int, k: int, sources: list[int]) -> None:
        for p in sources:
            self.store.remove(f"r{level}-{p}-{k}")
            self.store.remove(f"r{level}-{p}-{k}-at")


def packed_words(word: np.ndarray, n: np.ndarray, parts: int):
    """Rows (kind, part, packed arrays) of sorted words of 48 bits."""
    bounds = np.searchsorted(part_of(word << U(16), parts), np.arange(parts + 1))
    for q in range(parts):
        a, b = bounds[q], bounds[q + 1]
        if b > a:
            w = word[a:b]
            yield "w", q, [(w & U(0xFFFFFFFF)).astype(np.uint32).tobytes(), (w >> U(32)).astype(np.uint16).tobytes(), n[a:b].astype(np.uint32).tobytes()]


def _unpack(blobs: list[bytes], dtype) -> np.ndarray:
    return _join([np.frombuffer(x, dtype) for x in blobs if x], dtype)


_SCHEMA = "kind string, part long, a0 binary, a1 binary, a2 binary, a3 binary, a4 binary"
_NAMES = ["kind", "part", "a0", "a1", "a2", "a3", "a4"]


def _batch(rows):
    import pyarrow as pa

    cols = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())]
    cols += [pa.array([r[2][k] if k < len(r[2]) else None for r in rows], pa.binary()) for k in range(5)]
    return pa.RecordBatch.from_arrays(cols, _NAMES)


def counts_of_counts(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts; plain ones where the counts of counts say nothing."""
    if not n1 or not n2:
        return 0.5, 0.75, 0.75
    y = n1 / (n1 + 2 * n2)
    d1 = 1 - 2 * y * n2 / n1
    d2 = 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return tuple(min(max(d, 0.01), k - 0.01) for k, d in ((1, d1), (2, d2), (3, d3)))


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the few numbers beside them."""

    uri: str
    order: int
    parts: int
    tokens: int
    types: int
    pairs: int
    d_gram: tuple[tuple[float, float, float], ...]  # by level, from 2 on
    d_word: tuple[float, float, float]
    g_word: float  # weight of the uniform distribution in p1
    written: frozenset[tuple[str, int]]  # kinds of arrays ("u", "w", or a level) and parts that have entries


def train(texts: DataFrame, order: int = ORDER) -> Model:
    """Counts ``text`` of all rows and writes the model to the shared folder."""
    import pyarrow as pa

    if order < 2:
        raise ValueError("order is less than 2")
    spark = texts.sparkSession
    chars = texts.agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0))).first()[0]
    rounds = max(1, min(ROUNDS, -(-chars // ROUND_CHARS)))
    parts = max(partitions(spark), 8 * rounds, -(-chars // PART_CHARS))
    step = -(-parts // rounds)
    spans = [(a, min(a + step, parts)) for a in range(0, parts, step)]
    uri = shared_path(spark, "ngram-lm")

    def count(low, high):
        def run(batches):
            held, size = [], 0
            for b in batches:
                for texts_ in pieces(b.column("text"), COUNT_BYTES):
                    held.append(padded(*hashed_words(texts_), order))
                    size += len(held[-1])
                    if size >= COUNT_TOKENS:
                        yield _batch(list(count_chunk(np.concatenate(held), parts, order, low, high)))
                        held, size = [], 0
            if held:
                yield _batch(list(count_chunk(np.concatenate(held), parts, order, low, high)))

        return run

    def merge_grams(store, level: int, p: int, blobs: list[list[bytes]]):
        context = np.concatenate([np.frombuffer(x, U).reshape(level - 1, -1) for x in blobs[0]], axis=1)
        own = np.repeat(np.arange(context.shape[1], dtype=np.int32), _unpack(blobs[1], np.uint32))
        follower = _unpack(blobs[2], np.uint32).astype(U) | (_unpack(blobs[3], np.uint16).astype(U) << U(32))
        n = _unpack(blobs[4], np.uint32).astype(np.int64)
        key = pair_keys(context[0][own], follower, parts)
        by = np.argsort(key)
        key, own, follower, n = key[by], own[by], follower[by], n[by]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        key, own, follower, n = key[first], own[first], follower[first], np.add.reduceat(n, first)
        write_keys(store, f"b{level}-{p}", key)
        store.write(f"b{level}-{p}-n", np.minimum(n, 255).astype(np.uint8))
        large = n >= 255
        store.write(f"b{level}-{p}-largekey", key[large])
        store.write(f"b{level}-{p}-large", n[large])
        del key
        v = context[0][own]
        by = np.argsort(v)
        v, n_of = v[by], n[by]
        runs = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
        write_keys(store, f"v{level}-{p}", v[runs])
        stats = np.stack([np.add.reduceat(x.astype(np.int64), runs) for x in (n_of, n_of == 1, n_of == 2, n_of > 2)], axis=1)
        kind, kinds = coded(stats)
        store.write(f"v{level}-{p}-n", kind)
        store.write(f"v{level}-{p}-kinds", kinds)
        sums = [len(n), *counts_of_counts(n)]
        del by, v, n_of, stats, kind, n
        if level > 2:
            # one entry for each n-gram, of the n-gram less its first word: sums are numbers of distinct predecessors
            by = np.lexsort((follower, context[1][own]))
            own, follower = own[by], follower[by]
            v = context[1][own]
            first = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (follower[1:] != follower[:-1])])
            before, own, follower = np.diff(np.r_[first, len(v)]), own[first], follower[first]
            v = v[first]
            runs = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
            rows = packed_runs(level - 1, context[1:, own[runs]], np.diff(np.r_[runs, len(v)]), follower, before, parts)
        else:
            word, before = np.unique(follower, return_counts=True)
            rows = packed_words(word, before, parts)
        Runs(store, spans).write(level - 1, p, rows)
        return "s", p, [np.array(sums, np.int64).tobytes()]

    def merge_words(store, p: int, blobs: list[list[bytes]]):
        word = _unpack(blobs[0], np.uint32).astype(U) | (_unpack(blobs[1], np.uint16).astype(U) << U(32))
        word, n = _summed(word, _unpack(blobs[2], np.uint32).astype(np.int64))
        store.write(f"w{p}-key", word)
        store.write(f"w{p}-n", narrow(n))
        return "s", p, [np.array([len(n), *counts_of_counts(n)], np.int64).tobytes()]

    def merge(table: pa.Table) -> pa.Table:
        store, kind, p = SharedArrays(uri), table.column("kind")[0].as_py(), table.column("part")[0].as_py()
        blobs = [table.column(f"a{k}").to_pylist() for k in range(5)]
        if kind != "u":
            return pa.Table.from_batches([_batch([merge_grams(store, order, p, blobs)])])
        words, n = _summed(_unpack(blobs[0], np.uint64), _unpack(blobs[1], np.uint32).astype(np.int64))
        store.write(f"u{p}-key", words)
        store.write(f"u{p}-n", narrow(n))
        return pa.Table.from_batches([_batch([("u", p, [np.array([len(words), n.sum()], np.int64).tobytes()])])])

    def lower(level, k, sources):
        def run(batches):
            store = SharedArrays(uri)
            for b in batches:
                for p in b.column("id").to_pylist():
                    blobs = Runs(store, spans).read(level, k, p, sources)
                    if blobs[0]:
                        yield _batch([merge_grams(store, level, p, blobs) if level > 1 else merge_words(store, p, blobs)])

        return run

    def grams_of(low, high):
        """Rows of numbers of the highest order's parts low to high. The round's exchange is deleted with its job."""
        old = spark.conf.get(CLEANUP)
        spark.conf.set(CLEANUP, "true")
        try:
            return texts.select("text").mapInArrow(count(low, high), _SCHEMA).groupBy("kind", "part").applyInArrow(merge, _SCHEMA).select("kind", "part", "a0").collect()
        finally:
            spark.conf.set(CLEANUP, old)

    sums, by_level, written = np.zeros(2, np.int64), {}, set()
    for level in range(order, 0, -1):
        rows = []  # two rows of numbers a part
        for k, (low, high) in enumerate(spans):
            if level == order:
                rows += grams_of(low, high)
            else:
                rows += spark.range(low, high, 1, high - low).mapInArrow(lower(level, k, sources), _SCHEMA).select("kind", "part", "a0").collect()
                Runs(SharedArrays(uri), spans).drop(level, k, sources)
        own = np.zeros(5, np.int64)
        for r in rows:
            written.add((r.kind if r.kind == "u" else str(level) if level > 1 else "w", r.part))
            if r.kind == "u":
                sums = sums + np.frombuffer(r.a0, np.int64)
            else:
                own = own + np.frombuffer(r.a0, np.int64)
        sources = sorted(r.part for r in rows if r.kind == "s")
        by_level[level] = own.tolist()
    of_grams, c = [by_level[level] for level in range(2, order + 1)], by_level[1]
    (types, tokens), pairs = sums.tolist(), of_grams[0][0]
    d = discounts(*c[1:])
    rest = c[0] - c[1] - c[2]
    g = (d[0] * c[1] + d[1] * c[2] + d[2] * rest) / pairs if pairs else 1.0
    return Model(uri, order, parts, tokens, types, pairs, tuple(discounts(*x[1:]) for x in of_grams), d, g, frozenset(written))


class Scorer:
    """A worker's view of the model: maps arrays when a part is first asked for; one that was written and isn't there fails the task."""

    def __init__(self, model: Model):
        self.m = model
        self.store = SharedArrays(model.uri)
        self.maps: dict[str, np.ndarray] = {}

    def array(self, kind: str, part: int, suffix: str):
        name = f"{kind}{part}-{suffix}"
        if name not in self.maps:
            there = (kind.strip("bv-") or kind, part) in self.m.written
            self.maps[name] = self.store.read(name) if there else np.empty(0, np.uint64)
        return self.maps[name]

    def find(self, kind: str, keys: np.ndarray, part: np.ndarray, width: int = 1, suffix: str = "n") -> np.ndarray:
        """Values of sorted keys; 0 where there is none."""
        out = np.zeros((len(keys), width), np.int64)
        bounds = np.searchsorted(part, np.arange(self.m.parts + 1))
        for p in np.flatnonzero(np.diff(bounds)).tolist():
            a, b = bounds[p], bounds[p + 1]
            have = self.array(kind, p, "largekey" if suffix == "large" else "key")
            if not len(have):
                continue
            if have.ndim > 1:
                at = places(have, self.array(kind, p, "at"), keys[a:b])
                hit = at >= 0
            else:
                at = np.minimum(np.searchsorted(have, keys[a:b]), len(have) - 1)
                hit = have[at] == keys[a:b]
            value = self.array(kind, p, suffix)[at[hit]]
            out[a:b][hit] = (self.array(kind, p, "kinds")[value] if width > 1 else value).reshape(-1, width)
        return out

    def score(self, texts):
        """n_tokens, n_known, base_score and score of each text of an Arrow array or a list."""
        import pyarrow as pa

        m = self.m
        if isinstance(texts, list):
            texts = pa.array([None if t is None else t.encode("utf-8", "surrogatepass") for t in texts], pa.binary()).view(pa.string())
        words, n = hashed_words(texts)
        size = n + 1
        start = np.cumsum(size) - size
        tokens = padded(words, n, m.order)
        inner, context = contexts(tokens, m.order)
        tokens = tokens[inner]
        words, at = np.unique(tokens, return_inverse=True)
        count = self.find("u", words, part_of(words, m.parts))[:, 0]
        base = np.log10((count + 1) / (m.tokens + m.types + 1))
        # p1 by word
        before = self.find("w", words >> U(16), part_of(words, m.parts))[:, 0]
        d = np.array([0.0, *m.d_word])
        p1 = np.full(len(words), m.g_word / (m.types + 1))
        if m.pairs:
            p1 += (before - d[np.minimum(before, 3)]) / m.pairs
        p = p1[at]
        for level in range(2, m.order + 1):
            # what a context gives away
            own, v_at = np.unique(context[m.order - level], return_inverse=True)
            in_part = part_of(own, m.parts)
            stats = self.find(f"v{level}-", own, in_part, 4)
            total, d = stats[:, 0], np.array([0.0, *m.d_gram[level - 2]])
            g = np.where(total > 0, (stats[:, 1:] @ d[1:]) / np.maximum(total, 1), 1.0)
            grams, back = np.unique((v_at.astype(U) << U(32)) | at.astype(U), return_inverse=True)
            v, w = (grams >> U(32)).astype(np.int64), (grams & U(0xFFFFFFFF)).astype(np.int64)
            key = pair_keys(own[v], words[w] >> U(16), m.parts)
            order = np.argsort(key, kind="stable")
            part = in_part[v[order]]
            found = self.find(f"b{level}-", key[order], part)[:, 0]
            big = found == 255
            if big.any():
                found[big] = self.find(f"b{level}-", key[order][big], part[big], suffix="large")[:, 0]
            n = np.empty(len(key), np.int64)
            n[order] = found
            p = g[v_at] * p + np.where(n > 0, (n - d[np.minimum(n, 3)]) / np.maximum(total[v], 1), 0.0)[back]
        logs = np.log10(p)
        return size, np.add.reduceat((count > 0)[at].astype(np.int64), start), np.add.reduceat(base[at], start), np.add.reduceat(logs, start)


_SCORERS: dict[Model, Scorer] = {}


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds n_tokens, n_known, train_tokens, base_score, score and perplexity."""
    import pyarrow as pa
    from pyspark.sql import types as T

    added = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    away, back = set_aside(docs, tuple(added), ("text",), ("text",))
    keep = [f for f in away.schema.fields if f.name != "text"]
    kinds = [T.LongType()] * 3 + [T.DoubleType()] * 3
    schema = T.StructType([*keep, *[T.StructField(n, k) for n, k in zip(added, kinds, strict=True)]])

    def run(batches):
        if model not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[model] = Scorer(model)
        scorer = _SCORERS[model]
        for b in batches:
            done = [scorer.score(texts) for texts in pieces(b.column("text"), SCORE_BYTES)]
            if not done:
                continue
            n, known, base, own = (np.concatenate(x) for x in zip(*done, strict=True))
            cols = [pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), model.tokens), pa.int64()), pa.array(base), pa.array(own), pa.array(10.0 ** (-own / n))]
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in keep], *cols], [*[f.name for f in keep], *added])

    return back(away.mapInArrow(run, schema), *added)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's text, by folds."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def query(spark, sf_dir: str) -> DataFrame:
    from lorekeep.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", fold(F.col("doc_id"), 7) == 2)
    model = train(docs.where("not held_out"), ORDER)
    return score(docs, model).drop("perplexity")

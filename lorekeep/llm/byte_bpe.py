"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct pre-tokens ("words") of a stretch of the corpus are laid end to end
in one array of parts. An inverted index leads from the rank of a mergeable pair
to the positions where it stands, over all words. Ranks are taken from a heap in
ascending order; each is applied to all of its positions at once, and only the
neighbours that a merge touches are looked at again. Words that were seen are
kept in a bounded cache, so a common word is replayed once per task.

A merge can, in rare cases, bring up a pair of lower rank than the one being
replayed (the same bytes reached over another split). Such a word must take the
lower rank before its remaining occurrences of the present one; it is taken out
of the replay and settled alone, which keeps results equal to word-by-word
encoding.

Documents are encoded where they are read: no shuffle, one narrow stage, memory
bounded by the Arrow batch and the cache. A lost executor's partitions are just
read again. Defined results: null or empty text has no tokens and decodes to
nothing; a text of which no bytes merge has a token for each byte; very long
texts are encoded whole; repeated rows are encoded each; a null doc_id stays
null; an empty table gives an empty table; extra columns, dots in their names
included, are kept by ``encode`` unless they clash with ``ids``/``n_tokens``.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from heapq import heappop, heappush

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lorekeep.llm.common import set_aside

#: Entries after which a task's cache of encoded words starts anew.
CACHE_WORDS = 350_000
#: Distinct words that are replayed together.
REPLAY_WORDS = 100_000
#: Pairs of parts whose ranks a worker remembers (the first ones, which are the frequent ones).
PAIRS = 500_000
#: Positions of a rank from which it is applied to all at once.
BULK = 64


class MergeReplay:
    """Encodes many distinct words at once by the ranks of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for b, r in ranks.items():
            self.bytes_of[r] = b
        self.pairs: dict[int, int] = {}  # by left << 20 | right
        self.single = [ranks.get(bytes([i]), -1) for i in range(256)]

    def rank(self, left: int, right: int) -> int:
        """The rank that two adjacent parts merge to, or -1."""
        key = left << 20 | right
        r = self.pairs.get(key)
        if r is None:
            r = self.ranks.get(self.bytes_of[left] + self.bytes_of[right], -1)
            if len(self.pairs) < PAIRS:
                self.pairs[key] = r
        return r

    def alone(self, word: bytes) -> list[int]:
        """One word: the lowest rank first, the leftmost of equals."""
        parts = [self.single[b] for b in word]
        while len(parts) > 1:
            best, at = -1, -1
            for i in range(len(parts) - 1):
                r = self.rank(parts[i], parts[i + 1])
                if r >= 0 and (best < 0 or r < best):
                    best, at = r, i
            if best < 0:
                break
            parts[at : at + 2] = [best]
        return parts

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``rank`` of many pairs."""
        keys, back = np.unique(left.astype(np.int64) << 20 | right, return_inverse=True)
        known = self.pairs.get
        out = [known(k, -2) for k in keys.tolist()]
        for n, r in enumerate(out):
            if r == -2:
                k = int(keys[n])
                out[n] = self.rank(k >> 20, k & 0xFFFFF)
        return np.array(out, np.int64)[back]

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each of the words, by one replay over all of them."""
        out: list[list[int] | None] = [[r] if (r := self.ranks.get(w)) is not None else None if w else [] for w in words]
        todo = [k for k, ids in enumerate(out) if ids is None]
        if not todo:
            return out
        size = np.array([len(words[k]) for k in todo], np.int64)
        start = np.cumsum(size) - size
        n = int(size.sum())
        joined = np.frombuffer(b"".join([words[k] for k in todo]), np.uint8)
        # one memory, seen as arrays by bulk steps and item by item by small ones
        part, after, before = (array("q", bytes(8 * n)) for _ in range(3))
        P, A, B = (np.frombuffer(x, np.int64) for x in (part, after, before))
        P[:] = np.array(self.single, np.int64)[joined]  # the part at a position; -1 once merged into its left neighbour
        A[:] = np.arange(1, n + 1)  # the next part's position; -1 at a word's end
        B[:] = np.arange(-1, n - 1)
        A[start + size - 1] = -1
        B[start] = -1
        owner = np.repeat(np.arange(len(todo)), size)
        irregular: set[int] = set()  # words to be settled alone
        at = np.flatnonzero(A >= 0)
        r = self.ranks_of(P[at], P[at + 1])
        at, r = at[r >= 0], r[r >= 0]
        order = np.argsort(r, kind="stable")
        at, r = at[order], r[order]
        found, bounds = np.unique(r, return_index=True)
        # a replay may hold no mergeable pair at all; np.split would make one part of nothing
        index = {q: x.tolist() for q, x in zip(found.tolist(), np.split(at, bounds[1:]), strict=True)} if len(found) else {}
        heap = list(index)
        while heap:
            r = heappop(heap)
            at = index.pop(r)
            if len(at) >= BULK:
                self._merge_bulk(r, at, index, heap, P, A, B, owner, irregular)
            else:
                self._merge_few(r, at, index, heap, part, after, before, owner, irregular)
        live = np.flatnonzero(P >= 0)
        ids = P[live].tolist()
        stops = np.searchsorted(live, start + size).tolist()
        i = 0
        for k, j in zip(todo, stops, strict=True):
            out[k] = ids[i:j]
            i = j
        for k in irregular:
            out[todo[k]] = self.alone(words[todo[k]])
        return out

    def _merge_few(self, r, at, index, heap, part, after, before, owner, irregular) -> None:
        """Applies rank r at a few positions, one by one."""
        rank, known = self.rank, self.pairs.get
        at.sort()
        for i in at:
            x, j = part[i], after[i]
            if x < 0 or j < 0:
                continue
            y = part[j]
            if known(x << 20 | y, -1) != r and rank(x, y) != r:
                continue
            if irregular and owner[i] in irregular:
                continue
            part[i], part[j] = r, -1
            z = after[i] = after[j]
            w = before[i]
            for a, left, right in ((i, r, z), (w, w, r)):
                if left < 0 or right < 0:
                    continue
                key = r << 20 | part[z] if a == i else part[w] << 20 | r
                q = known(key)
                if q is None:
                    q = rank(key >> 20, key & 0xFFFFF)
                if q < 0:
                    continue
                if q < r:
                    irregular.add(int(owner[i]))
                    break
                if q in index:
                    index[q].append(a)
                else:
                    index[q] = [a]
                    heappush(heap, q)
            if z >= 0:
                before[z] = i

    def _merge_bulk(self, r, at, index, heap, P, A, B, owner, irregular) -> None:
        """Applies rank r at many positions at once."""
        at = np.unique(np.array(at, np.int64))
        at = at[(P[at] >= 0) & (A[at] >= 0)]
        at = at[self.ranks_of(P[at], P[A[at]]) == r]
        if irregular:
            at = at[~np.isin(owner[at], list(irregular))]
        j = A[at]
        meet = np.flatnonzero(j[:-1] == at[1:])
        if len(meet):  # positions that share a part: the left one has it
            keep = np.ones(len(at), bool)
            for m in meet.tolist():
                if keep[m]:
                    keep[m + 1] = False
            at = at[keep]
            j = A[at]
        if not len(at):
            return
        z = A[j]
        was = P[z]  # the right neighbour before this rank reaches it
        P[at], P[j] = r, -1
        A[at] = z
        inner = z >= 0
        B[z[inner]] = at[inner]
        now = P[z]
        w = B[at]
        outer = w >= 0
        left, right = at[inner], w[outer]
        pairs = np.concatenate([left, right])
        q = self.ranks_of(np.concatenate([np.full(len(left), r), P[right]]), np.concatenate([now[inner], np.full(len(right), r)]))
        changed = inner & (was != now)
        low = set(owner[pairs[(q >= 0) & (q < r)]].tolist())
        if changed.any():
            early = self.ranks_of(np.full(int(changed.sum()), r), was[changed])
            low |= set(owner[at[changed][(early >= 0) & (early < r)]].tolist())
        irregular |= low
        pairs, q = pairs[q > r], q[q > r]
        if not len(q):
            return
        order = np.argsort(q, kind="stable")
        pairs, q = pairs[order], q[order]
        found, bounds = np.unique(q, return_index=True)
        for key, x in zip(found.tolist(), np.split(pairs, bounds[1:]), strict=True):
            if key in index:
                index[key] += x.tolist()
            else:
                index[key] = x.tolist()
                heappush(heap, key)

    def decode(self, ids) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """Path and pre-token pattern of a public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


_ENCODERS: dict[tuple[str, str, str], "Encoder"] = {}


def worker_encoder(path: str, pattern: str, kind: str, keep) -> "Encoder":
    """This worker process's encoder: tasks that follow each other in it share the vocabulary."""
    key = (path, pattern, kind)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(path, pattern, keep)
    return _ENCODERS[key]


class Encoder:
    """Encodes texts; keeps the words it has met, with what ``keep(ids)`` makes of their ids."""

    def __init__(self, path: str, pattern: str, keep):
        import regex

        self.replay = MergeReplay(load_ranks(path))
        self.find = regex.compile(pattern).findall
        self.keep = keep
        self.seen: dict[str, object] = {}

    def forget(self) -> None:
        """An idle worker keeps the vocabulary alone."""
        self.seen.clear()
        self.replay.pairs.clear()

    def learn(self, words, slim=None) -> None:
        if len(self.seen) > CACHE_WORDS:
            self.seen.clear()
        new = list(words)
        for i in range(0, len(new), REPLAY_WORDS):
            some = new[i : i + REPLAY_WORDS]
            for w, ids in zip(some, self.replay.encode([w.encode("utf-8", "surrogatepass") for w in some]), strict=True):
                self.seen[w] = self.keep(ids) if slim is None else slim(w, self.keep(ids))

    def batches(self, texts: list[str | None], slim=None, chars: int = 4_000_000):
        """(index, words, kept parts) of each text; stretches of about ``chars`` characters are replayed together."""
        i = 0
        while i < len(texts):
            j, total, found, fresh = i, 0, [], set()
            while j < len(texts) and (j == i or total < chars):
                words = self.find(texts[j] or "")
                found.append(words)
                fresh.update(words)
                total += len(texts[j] or "")
                j += 1
            if len(self.seen) > CACHE_WORDS:
                self.seen.clear()
            self.learn([w for w in fresh if w not in self.seen], slim)
            seen = self.seen
            for k, words in enumerate(found):
                yield i + k, words, [seen[w] for w in words]
            i = j


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, text_col: str = "text") -> DataFrame:
    """Adds ``ids`` (array of int) and ``n_tokens``."""
    import pyarrow as pa

    if path is None:
        path, pattern = vocabulary()
    away, back = set_aside(docs, ("ids", "n_tokens"), (text_col,))
    keep = away.schema.fields
    schema = T.StructType([*keep, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())])

    def run(batches):
        import itertools

        enc = worker_encoder(path, pattern, "ids", tuple)
        for b in batches:
            rows = [list(itertools.chain.from_iterable(parts)) for _, _, parts in enc.batches(b.column(text_col).to_pylist())]
            cols = [b.column(f.name) for f in keep]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(rows, pa.list_(pa.int32())), pa.array([len(r) for r in rows], pa.int64())], [*[f.name for f in keep], "ids", "n_tokens"]
            )
        enc.forget()

    return back(away.mapInArrow(run, schema), "ids", "n_tokens")


def decode(ids_df: DataFrame, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded`` (binary): the bytes that the ids stand for."""
    import pyarrow as pa

    path = path or vocabulary()[0]
    away, back = set_aside(ids_df, ("decoded",), (ids_col,))
    keep = away.schema.fields
    schema = T.StructType([*keep, T.StructField("decoded", T.BinaryType())])

    def run(batches):
        m = MergeReplay(load_ranks(path))
        for b in batches:
            out = [None if ids is None else m.decode(ids) for ids in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in keep], pa.array(out, pa.binary())], [*[f.name for f in keep], "decoded"])

    return back(away.mapInArrow(run, schema), "decoded")


def digest(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the text decoded from them.

    The same encoder; of a word the ids are kept as the string that the digest
    needs. What they decode to is kept beside it if it isn't the word itself.
    """
    import pyarrow as pa

    if path is None:
        path, pattern = vocabulary()

    def run(batches):
        enc = worker_encoder(path, pattern, "digest", lambda ids: (" ".join(map(str, ids)), enc.replay.decode(ids)))
        for b in batches:
            n, ids, dec = [], [], []
            for _, words, parts in enc.batches(b.column("text").to_pylist(), _as_digest):
                try:
                    text, decoded = " ".join(parts), "".join(words).encode()
                except TypeError:  # some word decodes to other bytes than its own
                    text = " ".join([p if type(p) is str else p[0] for p in parts])
                    decoded = b"".join([w.encode() if type(p) is str else p[1] for w, p in zip(words, parts, strict=True)])
                n.append(text.count(" ") + 1 if text else 0)
                ids.append(hashlib.sha256(text.encode()).hexdigest())
                dec.append(hashlib.sha256(decoded).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(dec, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        enc.forget()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _as_digest(word: str, kept: tuple[str, bytes]):
    """The ids' string alone if they decode to the word."""
    return kept[0] if kept[1] == word.encode("utf-8", "surrogatepass") else kept


def query(spark, sf_dir: str) -> DataFrame:
    from lorekeep.llm.common import table

    return digest(table(spark, sf_dir, "documents"))

"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence is toxic with probability
sigmoid(b + sum of its words' weights); the document is toxic if any sentence
is, by noisy-or: 1 - prod(1 - p). Weights are learned from document labels
alone, through the noisy-or, so the sentences to blame are found on the way.
A word's weight sums those of its features: the word and its first 3 to 6
letters, which carry over to unseen inflections. Labels, language, source and
id are never inputs.

The classifier is fitted on a bounded sample of labelled rows, ``SAMPLE`` of
each class in the order of a hash of doc_id, by one task that holds the sample
alone; whole texts are used. Weights go to the workers; scoring is one narrow
stage over all documents, with a bounded memory of words.

Defined results: null and empty texts are one empty sentence and get the bias
alone; very long texts are read whole; rows without a label teach nothing,
repeated labels of a document count once (toxic if any says so); of repeated rows
of a document the least text teaches, and each row is scored; without labels of
both classes every score is 0; an empty table gives an empty table. Extra columns
stay, whatever their names, unless they clash with the added names.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import set_aside

#: Labelled rows of each class that the classifier is fitted on, at most.
SAMPLE = {0: 4000, 1: 2500}
#: A feature needs this many documents of the sample.
LEAST_DOCS = 4
ROUNDS, RATE, DECAY = 120, 0.25, 2e-4
MEMO_WORDS = 600_000
#: A sentence from this probability on is named as offending.
OFFENDING = 0.5
#: The bias of a model that has seen one class alone: nothing is toxic.
NEVER = float("-inf")
TOKENS = re.compile(r"[^\W_]+|[.!?\n]")
STOPS = frozenset(".!?\n")


def features(word: str) -> list[str]:
    return [word, *["^" + word[:k] for k in range(3, min(len(word), 6) + 1)]]


def sentences(text: str | None) -> list[list[str]]:
    """Lower-cased words by sentence; at least one sentence."""
    out: list[list[str]] = [[]]
    for t in TOKENS.findall((text or "").lower()):
        if t in STOPS:
            out.append([])
        else:
            out[-1].append(t)
    return [s for s in out if s] or [[]]


def fit(texts: list[str | None], labels: list[int], rounds: int = ROUNDS) -> tuple[dict[str, float], float]:
    """Weights of features, and the bias."""
    y = np.array(labels, np.float64)
    if not (y == 0).any() or not (y == 1).any():
        return {}, NEVER
    bags = [sentences(t) for t in texts]
    df: Counter[str] = Counter()
    for bag in bags:
        df.update({f for w in {w for s in bag for w in s} for f in features(w)})
    index = {f: i for i, f in enumerate(sorted(f for f, n in df.items() if n >= LEAST_DOCS))}
    by_word: dict[str, list[int]] = {}
    cols, counts, doc_of = [], [], []
    for d, bag in enumerate(bags):
        for s in bag:
            own = []
            for w in s:
                ids = by_word.get(w)
                if ids is None:
                    ids = by_word[w] = [index[f] for f in features(w) if f in index]
                own += ids
            cols.append(np.array(own, np.int32))
            counts.append(len(own))
            doc_of.append(d)
    idx = np.concatenate(cols) if cols else np.empty(0, np.int32)
    row = np.repeat(np.arange(len(counts)), counts)
    doc_of = np.array(doc_of)
    del bags, cols, df
    # features by how unevenly they fall on the classes give the first weights
    n1, n0 = y.sum(), (1 - y).sum()
    pairs = np.unique(doc_of[row].astype(np.int64) << 32 | idx)
    of_doc, of_idx = pairs >> 32, pairs & 0xFFFFFFFF
    hit1 = np.bincount(of_idx, y[of_doc], len(index))
    hit0 = np.bincount(of_idx, minlength=len(index)) - hit1
    odds = np.log((hit1 + 0.5) / (n1 + 1) / ((hit0 + 0.5) / (n0 + 1)))
    # a feature that clean texts hold as well says little by itself
    w = np.where((hit0 <= 0.02 * hit1) & (odds > 1), 0.5 * odds, 0.0)
    b = -6.0
    g2, gb2 = np.full(len(index), 1e-8), 1e-8
    weight = np.where(y == 1, n0 / n1, 1.0) / len(y)
    for _ in range(rounds):
        z = b + np.bincount(row, w[idx], len(doc_of))
        p = 1 / (1 + np.exp(-np.clip(z, -40, 30)))
        none = np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y))
        doc = np.clip(-np.expm1(none), 1e-9, 1 - 1e-12)
        # derivative by the sentence's logit: p for clean documents, -p (1 - P) / P for toxic ones
        gz = p * np.where(y == 1, -(1 - doc) / doc, 1.0)[doc_of] * weight[doc_of]
        g = np.bincount(idx, gz[row], len(index)) + DECAY * w / len(y)
        gb = gz.sum()
        g2 = 0.9 * g2 + 0.1 * g * g
        gb2 = 0.9 * gb2 + 0.1 * gb * gb
        step = RATE / 2
        w -= step * g / (np.sqrt(g2) + 1e-5)
        b -= step * gb / (np.sqrt(gb2) + 1e-5)
    return {f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-3}, float(b)


def sample(labels: DataFrame, sizes: dict[int, int] = SAMPLE) -> DataFrame:
    """(doc_id, toxic): the bounded sample."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    out = None
    for label, n in sizes.items():
        some = known.where(F.col("toxic") == label).orderBy(F.xxhash64(F.col("doc_id")), "doc_id").limit(n)
        out = some if out is None else out.unionByName(some)
    return out


def train(docs: DataFrame, labels: DataFrame, sizes: dict[int, int] = SAMPLE) -> tuple[dict[str, float], float]:
    """Fits the classifier in one task on the sample; returns weights and bias."""
    import pyarrow as pa

    chosen = docs.select("doc_id", "text").join(F.broadcast(sample(labels, sizes)), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("doc_id").to_numpy(), kind="stable")
        texts, labels = table.column("text").to_pylist(), table.column("toxic").to_pylist()
        weights, bias = fit([texts[i] for i in order], [labels[i] for i in order])
        return pa.table({"f": pa.array([None, *weights], pa.string()), "w": pa.array([bias, *weights.values()], pa.float64())})

    rows = chosen.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(run, "f string, w double").collect()  # the model: features of the sample
    weights = {r.f: r.w for r in rows}
    bias = weights.pop(None, NEVER)
    return weights, bias


class Scores(dict):
    """Words and their weights; sentence ends are not a number."""

    def __init__(self, weights: dict[str, float]):
        super().__init__({s: float("nan") for s in STOPS})
        self.weights = weights

    def __missing__(self, word: str) -> float:
        get = self.weights.get
        s = self[word] = sum(get(f, 0.0) for f in features(word))
        return s

    def trim(self) -> None:
        if len(self) > MEMO_WORDS:
            self.clear()
            self.update({s: float("nan") for s in STOPS})


def logits(tokens: list[str], scores: Scores, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """Logits of the sentences with words (or of one empty one), and the index of the stop before each."""
    x = np.fromiter(map(scores.__getitem__, tokens), np.float64, len(tokens))
    stops = np.r_[-1, np.flatnonzero(np.isnan(x))]
    words = np.diff(np.r_[stops, len(x)]) > 1
    total = np.r_[0.0, np.cumsum(np.nan_to_num(x))]
    z = bias + total[np.r_[stops[1:], len(x)]] - total[stops + 1]
    if not words.any():
        return np.array([bias]), np.array([-1])
    return z[words], stops[words]


def noisy_or(z: np.ndarray) -> float:
    return float(-np.expm1(-np.logaddexp(0, z).sum()))


_SCORES: dict[int, Scores] = {}


def score(docs: DataFrame, model: tuple[dict[str, float], float], threshold: float = 0.7, locate: bool = True) -> DataFrame:
    """Adds score, predicted and, if asked for, ``offending``: the sentences to blame in documents predicted toxic."""
    import pyarrow as pa
    from pyspark.sql import types as T

    weights, bias = model
    given = docs.sparkSession.sparkContext.broadcast(weights)  # bounded by the sample
    added = ["score", "predicted"] + ["offending"] * locate
    away, back = set_aside(docs, tuple(added), ("text",))
    keep = away.schema.fields
    types = [T.DoubleType(), T.IntegerType(), T.ArrayType(T.StringType())]
    schema = T.StructType([*keep, *[T.StructField(n, k) for n, k in zip(added, types, strict=False)]])

    def run(batches):
        key = given.id if hasattr(given, "id") else 0
        if key not in _SCORES:
            _SCORES.clear()
            _SCORES[key] = Scores(given.value)
        scores = _SCORES[key]
        for b in batches:
            out, named = [], []
            for text in b.column("text").to_pylist():
                lower = (text or "").lower()
                z, stops = logits(TOKENS.findall(lower), scores, bias)
                out.append(noisy_or(z))
                scores.trim()
                if locate:
                    named.append(blame(text, lower, scores, bias) if out[-1] >= threshold else [])
            cols = [pa.array(out, pa.float64()), pa.array([int(x >= threshold) for x in out], pa.int32())]
            cols += [pa.array(named, pa.list_(pa.string()))] * locate
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in keep], *cols], [*[f.name for f in keep], *added])

    return back(away.mapInArrow(run, schema), *added)


def blame(text: str, lower: str, scores: Scores, bias: float) -> list[str]:
    """The sentences of a toxic text whose own probability is ``OFFENDING`` or more; else the likeliest one."""
    found = list(TOKENS.finditer(lower))
    z, stops = logits([m[0] for m in found], scores, bias)
    ends = [k for k, m in enumerate(found) if m[0] in STOPS] + [len(found)]
    source = text if len(lower) == len(text) else lower
    wanted = np.flatnonzero(1 / (1 + np.exp(-np.clip(z, -40, 40))) >= OFFENDING).tolist() or [int(np.argmax(z))]
    out = []
    for i in wanted:
        first = int(stops[i]) + 1
        last = next(e for e in ends if e > stops[i])
        if first < len(found):
            out.append(source[found[first].start() : found[last - 1].end()])
    return out


def query(spark, sf_dir: str) -> DataFrame:
    from lorekeep.llm.common import table
    from lorekeep.llm.ngram_lm import fold

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(fold(F.col("doc_id"), 3) != 1)
    model = train(docs, labels)
    return score(docs.withColumn("held_out", fold(F.col("doc_id"), 3) == 1), model, locate=False).select("doc_id", "held_out", "score", "predicted")

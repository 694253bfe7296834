"""Texts to memory candidates: segments, then enriched inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep import lexicon as X
from lorekeep.functions import enrich, text as T


def split_sentences(clean: Column) -> Column:
    return F.filter(F.transform(F.split(clean, r"(?<=[.!?])\s+", -1), T.normalize_space), lambda p: p != "")


def _packed(pieces: Column, most: int) -> Column:
    """Sentences joined while they fit; a longer one stays whole."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc, piece):
        joined = F.when(acc["open"] == "", piece).otherwise(F.concat(acc["open"], F.lit(" "), piece))
        fits = F.length(joined) <= most
        done = F.when(fits | (acc["open"] == ""), acc["done"]).otherwise(F.array_append(acc["done"], acc["open"]))
        return F.struct(done.alias("done"), F.when(fits, joined).otherwise(piece).alias("open"))

    def finish(acc):
        return F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"]))

    return F.aggregate(pieces, start, step, finish)


def chunk(c: Column, most: int = X.SEGMENT_MOST, by_sentence: bool = False) -> Column:
    """Segments of one chunk of text."""

    def body(clean):
        def of(pieces):
            whole = F.when(F.length(clean) <= most, F.array(clean)).when(F.size(pieces) <= 1, F.array(T.ellipsis(clean, most))).otherwise(_packed(pieces, most))
            if by_sentence:
                whole = F.when(F.size(pieces) > 1, F.transform(pieces, lambda p: T.ellipsis(p, most))).otherwise(whole)
            return F.when(clean == "", F.array().cast("array<string>")).otherwise(whole)

        return T.let(split_sentences(clean), of)

    return T.let(T.normalize_space(c), body)


def segments(c: Column, limit: int = X.SEGMENTS, most: int = X.SEGMENT_MOST) -> Column:
    """Distinct segments in order: by line without bullets, or by sentence if that gives one at most."""
    bare = F.transform(T.lines(c), lambda x: T.normalize_space(F.regexp_replace(x, r"^(?U)\s*(?:[-*•]+|\d+[.)])\s*", "")))
    by_line = F.flatten(F.transform(F.filter(bare, lambda x: x != ""), lambda x: chunk(x, most)))
    chosen = T.let(by_line, lambda s: F.when(F.size(s) <= 1, chunk(c, most, by_sentence=True)).otherwise(s))
    start = F.array().cast("array<struct<canon:string,segment:string>>")

    def step(acc, s):
        canon = T.canonicalize(s)

        def add(k):
            new = (F.size(acc) < limit) & (F.length(s) >= X.SEGMENT_LEAST) & (k != "") & ~F.exists(acc, lambda x: x["canon"] == k)
            return F.when(new, F.array_append(acc, F.struct(k.alias("canon"), s.alias("segment")))).otherwise(acc)

        return T.let(canon, add)

    return F.aggregate(chosen, start, step, lambda acc: F.transform(acc, lambda x: x["segment"]))


def split_texts(texts: DataFrame, limit: int = X.SEGMENTS, most: int = X.SEGMENT_MOST) -> DataFrame:
    """A row per segment: the text's other columns, seq (from 0) and segment."""
    others = [c for c in texts.columns if c != "text"]
    return texts.select(*others, F.posexplode(segments(F.col("text"), limit, most)).alias("seq", "segment"))


def preview(texts: DataFrame, limit: int = X.SEGMENTS, kind: str | None = None, importance: float | None = None, certainty: float | None = None) -> DataFrame:
    """What ingesting would remember. texts: text, scope, and optionally source, tags and any further columns."""
    for name, value in (("source", F.lit("")), ("tags", F.array().cast("array<string>"))):
        if name not in texts.columns:
            texts = texts.withColumn(name, value)
    s = F.col("segment")
    out = split_texts(texts, limit).withColumn("kind", F.lit(kind) if kind else enrich.infer_kind(s))
    return out.withColumns(
        {
            "title": T.derive_title(s, F.col("kind")),
            "summary": T.derive_summary(s),
            "content": s,
            "tags": enrich.candidate_tags(s, F.col("tags")),
            "importance": F.lit(importance) if importance is not None else enrich.infer_importance(s, F.col("kind")),
            "certainty": F.lit(certainty) if certainty is not None else enrich.infer_certainty(s, F.col("kind")),
        }
    ).drop("segment")

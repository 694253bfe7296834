"""The inverted index: postings, row lengths and corpus statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep import lexicon as X
from lorekeep.functions.text import index_tokens
from lorekeep.operators.lineage import cut


@dataclass(frozen=True)
class Index:
    """postings: rowid, term, weight (occurrences by column weight), stems (occurrences in stems_text), dl; terms:
    distinct terms with their head (two letters); stats: one row of n and avgdl."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame

    def written(self) -> "Index":
        """The index over postings that are computed once, in the shared folder."""
        postings = cut(self.postings)
        return Index(postings, vocabulary(postings), cut(self.stats))

    def persist(self) -> "Index":
        postings = self.postings.persist()
        return Index(postings, vocabulary(postings).persist(), self.stats.persist())

    def unpersist(self) -> None:
        for part in (self.postings, self.terms, self.stats):
            part.unpersist()


def vocabulary(postings: DataFrame) -> DataFrame:
    return postings.select("term").distinct().withColumn("head", F.substring("term", 1, 2))


def build_index(memories: DataFrame) -> Index:
    """One pass over the texts; counts are combined before the shuffle."""
    columns = list(X.WEIGHTS)
    tokens = memories.select("rowid", *[index_tokens(F.col(c)).alias(c) for c in columns])
    tokens = tokens.withColumn("dl", sum((F.size(c) for c in columns[1:]), F.size(columns[0])).cast("long"))

    def tag(column: str, weight: float):
        in_stems = F.lit(int(column == "stems_text"))
        return F.transform(column, lambda t: F.struct(t.alias("term"), F.lit(weight).alias("w"), in_stems.alias("s")))

    tagged = F.concat(*[tag(c, w) for c, w in X.WEIGHTS.items()])
    postings = (
        tokens.select("rowid", "dl", F.inline(tagged))
        .groupBy("rowid", "term")
        .agg(F.sum("w").alias("weight"), F.sum("s").alias("stems"), F.first("dl").alias("dl"))
    )
    stats = tokens.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    return Index(postings, vocabulary(postings), stats)


def update_index(index: Index, memories: DataFrame, changed: DataFrame) -> Index:
    """The index after the rows of ``changed`` (rowid) were inserted, updated or deleted: their postings are replaced."""
    old = index.postings.join(changed.select("rowid").distinct(), "rowid", "left_anti")
    new = build_index(memories.join(changed.select("rowid").distinct(), "rowid", "left_semi")).postings
    postings = old.unionByName(new)
    lengths = postings.groupBy("rowid").agg(F.first("dl").alias("dl"))
    stats = memories.select("rowid").join(lengths, "rowid", "left").agg(F.count("*").alias("n"), F.avg(F.coalesce("dl", F.lit(0))).alias("avgdl"))
    return Index(postings, vocabulary(postings), stats)


def term_statistics(index: Index) -> DataFrame:
    """term, df and cf (weighted by column)."""
    return index.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("weight").alias("cf"))

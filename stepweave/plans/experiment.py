"""The experiment end to end: chunk, sample, extract, merge, compare with gold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunkers, extract, merge, metrics, stats


def chunked(docs: DataFrame, names: tuple[str, ...] = tuple(chunkers.CHUNKERS), **options) -> DataFrame:
    """Chunks of every chunker; documents are read once a chunker and never crossed with them."""
    return stats.union_all([chunkers.get(n)(docs, **options).withColumn("chunker", F.lit(n)) for n in names])


def cells(docs: DataFrame, by: str = "rules", names: tuple[str, ...] = tuple(chunkers.CHUNKERS), sample: int = extract.SAMPLE) -> DataFrame:
    """Merged graphs of every document and chunker."""
    taken = [extract.sample_chunks(chunkers.get(n)(docs), sample).withColumn("chunker", F.lit(n)) for n in names]
    return merge.merge_cells(merge.gather(extract.extract(stats.union_all(taken), by)))


def gold(docs: DataFrame, by: str = "rules") -> DataFrame:
    """(doc, gold): one call on the whole text, cut at the reader's limit."""
    whole = docs.select(F.col("doc").cast("string").alias("doc"), F.lit(-1).cast("long").alias("idx"), "text", F.lit("oracle").alias("chunker"))
    return extract.extract(whole, by).select("doc", F.col("graph").alias("gold"))


def evaluate(merged: DataFrame, golds: DataFrame) -> DataFrame:
    """Measures of every cell whose gold graph has a step."""
    pred = merged.select("doc", "chunker", F.struct("steps", "preconditions", "constraints", "edges").alias("pred"))
    return metrics.measures(pred.join(stats.scored(golds), "doc")).drop("gold", "pred")


def run(docs: DataFrame, by: str = "rules") -> DataFrame:
    """Measures of every chunker on every document whose gold graph has a step.

    ``evaluate`` joins cells with such graphs alone, so that join is made before
    chunking.  It goes by document, not by row: rows that share a document are
    all chunked if one of them has a step.  The graphs are made once and kept;
    they are counted first, as only then Spark knows whether they can be broadcast.
    """
    golds = stats.scored(gold(docs, by)).persist()
    golds.count()
    wanted = docs.withColumn("doc", F.col("doc").cast("string")).join(golds.select("doc"), "doc", "left_semi")
    return evaluate(cells(wanted, by), golds)

"""A corpus, cleaned in five stages: quality rules, near duplicates, benchmark decontamination, pseudonyms, mixing.

Each stage takes (spark, docs, sf_dir) and returns rows with the columns of
``documents``; the last returns the mix, in which a document stands as often as
it is taken.  ``run`` writes every stage as Parquet in the shared folder and
reads it again, so a lost executor costs part of one stage.  A stage decides by
(k, th), the id and the hash of the text, so rows that share an id are judged by
their own texts, and repeated rows stay or go together (near duplicates: one of
them stays).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm import decontaminate, jaccard_join, mixing, pii, quality
from stepweave.llm.scratch import Scratch, passing
from stepweave.llm.words import MAX_LONG

#: Near duplicates: share 80 % of their five-word shingles (op2's query has its contract's four words and 85 %).
GRAM, PERCENT = 5, 80
#: Rows of (k, th) up to which they are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 300_000


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without their source's common lines, and their length."""
    return _sized(quality.cleaned(spark, docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts stays: the one with the least id, of equal ids the text with the least hash, of rows with both equal the least by source and language; texts without words are no group."""
    keep = Scratch(spark)

    def keys(df: DataFrame, name: str) -> DataFrame:
        df = keep.table(df.select(F.col("k").alias("_k"), F.col("th").alias("_th")), name)
        return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df

    found = keep.table(jaccard_join.near_duplicates(spark, docs, gram=GRAM, percent=PERCENT).select("k", "th", "class"), "found")
    each = found.groupBy("k", "th").agg(F.first("class").alias("class"), F.count("*").alias("rows"))
    least = each.where("class is not null").groupBy("class").agg(F.min(F.struct("k", "th")).alias("o"))
    gone = keys(each.join(least, "class").where("k <> o.k or th <> o.th"), "gone")
    often = keys(each.where("rows > 1"), "often")
    marked = docs.withColumn("_k", F.coalesce(F.col("doc_id").cast("long"), F.lit(MAX_LONG))).withColumn("_th", F.xxhash64("text")).join(gone, ["_k", "_th"], "left_anti")
    again = marked.join(often, ["_k", "_th"], "left_semi").groupBy("_k", "_th").agg(F.min(F.struct("source", "lang", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))).alias("o"))
    once = marked.join(often, ["_k", "_th"], "left_anti").drop("_k", "_th")
    return once.unionByName(again.select("o.row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a twentieth or more of their words in benchmark passages."""
    found = decontaminate.find(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), rows=True)
    return found.where(~decontaminate.contaminated(F.col("n_hit"), F.col("n_words"))).select("row.*")


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced under the session's key, and their length."""
    return _sized(pii.pseudonymise(docs, pii.session_key(spark)).drop("n_pii", "pii_kinds"))


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's target takes it, numbered by ``copy``, and the length of its text."""
    return _sized(mixing.materialise(docs))


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("pseudonyms", pseudonyms), ("mixing", mixing_weights)]
#: Keyed pseudonyms and components are beyond SQL; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, keep = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for i, (_, stage) in enumerate(STAGES):
        with passing():
            docs = keep.table(stage(spark, docs, sf_dir), f"stage_{i}")
        if i:
            keep.drop(f"stage_{i - 1}")
    return docs

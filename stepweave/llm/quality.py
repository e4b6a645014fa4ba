"""Document quality by rules, and by how often a host repeats its lines.

Lines are normalised and hashed; a line that stands in more than ``share`` of a
host's distinct documents, and in more than ``least`` of them, is common:
``judge`` counts the words in such lines, ``cleaned`` removes the lines.  Exact
copies count as one document, so a group of copies does not make its own lines
common.  A document is rejected if a base rule fails, or if so many words
go that less than ``left`` of them stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import MAX_LONG, SPACE_CLASS, SPACES, ascii_lower, count_words, let, space_words

MIN_WORDS = 50
REPEAT_PERCENT = 50
LINE_SHARE = 0.3
LINE_LEAST = 20
LEFT = 0.3
#: Rows up to which common lines (host and hash) and the texts that have some are broadcast.
BROADCAST_LINES, BROADCAST_GONE = 200_000, 50_000


def repeat_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more: windows are hashed, sorted with their places, and compared with their neighbours."""

    def places(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))

        def count(s: Column) -> Column:
            twice = F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]))
            return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(F.sort_array(windows), count))

    return let(words, places).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of ``text``, beside k and th."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = space_words(F.col("text"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return docs.select(
        *(c for c in docs.columns if c != "text"),
        F.size(words).cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, SPACE_CLASS, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(words).alias("n_repeat_words"),
    )


def line_hash(line: Column) -> Column:
    """Lower case for A-Z, digits alike, white space as one space."""
    line = F.btrim(F.regexp_replace(F.translate(ascii_lower(line), "123456789", "000000000"), SPACE_CLASS, " "))
    return F.xxhash64(line)


def lines_of(docs: DataFrame) -> DataFrame:
    """(k, th, host, line, words): each distinct normalised line of a document with its words, repeats summed."""
    parts = F.transform(
        F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""),
        lambda x: F.struct(line_hash(x).alias("line"), count_words(x).alias("words")),
    )
    return docs.select("k", "th", "host", F.explode(parts).alias("p")).select("k", "th", "host", "p.line", "p.words")


def common_lines(docs: DataFrame, lines: DataFrame, share: float, least: int) -> DataFrame:
    """(host, line) above the limits; counts are over distinct documents of the host, combined before each shuffle."""
    per_line = lines.select("host", "line", "th").distinct().groupBy("host", "line").agg(F.count("*").alias("n"))
    per_host = docs.select("host", "th").distinct().groupBy("host").agg(F.count("*").alias("documents"))
    often = per_line.where(F.col("n") > F.lit(least))
    return often.join(per_host, "host").where(F.col("n") > F.col("documents") * F.lit(share)).select("host", "line")


def _judged(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, host_col: str, share: float, least: int, left: float) -> DataFrame:
    """The columns of ``judge``, the common lines of each text by their hashes (null without any), and the row of ``docs``."""
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(MAX_LONG)).alias("k"), F.xxhash64(text_col).alias("th"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit("")).alias("host"), F.col(text_col).cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    keep = Scratch(spark)
    lines = keep.table(lines_of(base), "lines")
    # less than 1 / share lines of a host for each line of a document: broadcast only if counted small, else AQE splits the common ones
    common = keep.table(common_lines(base, lines, share, least), "common_lines")
    common = F.broadcast(common) if common.count() <= BROADCAST_LINES else common
    gone = lines.join(common, ["host", "line"]).groupBy("k", "th", "host").agg(F.sum("words").alias("n_line_words"), F.collect_set("line").alias("lines"))
    s = statistics(base).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))
    # a row that stands twice has its lines counted twice
    twice = base.groupBy("k", "th", "host").agg(F.count("*").alias("rows"))
    gone = keep.table(gone.join(twice, ["k", "th", "host"]).select("k", "th", "host", F.expr("n_line_words div rows").alias("n_line_words"), "lines"), "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_GONE else gone
    j = s.join(gone, ["k", "th", "host"], "left").withColumn("n_line_words", F.coalesce("n_line_words", F.lit(0)).cast("long"))
    return j.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("n_line_words") >= F.col("n_words") * F.lit(left))).drop("host")


def judge(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", share: float = LINE_SHARE, least: int = LINE_LEAST, left: float = LEFT) -> DataFrame:
    """(doc_id, k, th, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_line_words, kept).

    ``n_line_words`` is the words in common lines.  One row for each input row;
    null and empty texts have no words and fail; a null host is a host; rows
    that share an id are judged by their own texts.  Other columns are not read.
    """
    return _judged(spark, docs, id_col, text_col, host_col, share, least, left).drop("lines", "row")


def cleaned(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", share: float = LINE_SHARE, least: int = LINE_LEAST, left: float = LEFT) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, their texts without the common lines of their host; other lines stay in order."""
    j = _judged(spark, docs, id_col, text_col, host_col, share, least, left).where("kept")
    text = F.col("row")[text_col].cast("string")
    rest = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains("lines", line_hash(x))), "\n")
    return j.select(*((F.when(F.col("lines").isNull(), text).otherwise(rest) if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns))

"""Benchmark decontamination by a distributed positional inverted index.

1. Words of all texts are counted as far as benchmark items use them.
2. Of each window of an item (``window`` consecutive words) the two rarest words
   are its anchors; overlapping windows mostly share them.
3. The postings (word, document, place) of the anchor words are stored.
4. Posting lists are shifted by the anchor's offset in its item and intersected:
   a document and a diagonal (place in the text less place in the item) where
   both anchors of some window stand is a candidate.
5. A candidate's windows are compared with the text word by word, on its
   diagonal; whatever lies in a window that occurs is hit.
6. For proximity matches the lists are intersected with a slop: both anchors of
   a window stand within ``slop`` words of their offset.  A window matches there
   if each of its words stands within ``slop`` words of where the place of the
   window's rarest word puts it; that is held against the text, word by word.

All steps are DataFrame operations.  What is broadcast is counted first, and a
shuffle takes its place beyond the bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import MAX_LONG, any_words, ascii_lower, let, plain_words

WINDOW = 13
#: Words by which a window's word may be out of place in a proximity match.
SLOP = 4
#: Rows of a table of words (under 20 MB) up to which it is broadcast.
BROADCAST_WORDS = 200_000


def item_windows(items: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, ih, words, len): distinct items with a word; ``len`` is the words of its windows."""
    words = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), plain_words(F.col(text_col).cast("string")).alias("words")).where(F.size("words") > 0)
    return words.withColumn("ih", F.xxhash64("words")).dropDuplicates(["item", "ih"]).withColumn("len", F.least(F.size("words"), F.lit(window)))


def _words_among(docs: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """(k, th, pos, term) of the words of texts that are among the terms.

    Words are met in full lower case, which Spark makes fast for ASCII and which
    equal words share; only others than ASCII are then held against the term
    itself, as ``plain_words`` leaves their capitals.
    """
    words = docs.select("k", "th", F.posexplode(any_words(F.col("text"))).alias("pos", "word"))
    known = terms.select("term", F.lower("term").alias("low"))
    ascii_ = F.octet_length("word") == F.length("word")
    j = words.join(F.broadcast(known) if n_terms <= BROADCAST_WORDS else known, F.lower("word") == F.col("low"))
    return j.where(F.when(ascii_, F.col("term") == F.col("low")).otherwise(ascii_lower(F.col("word")) == F.col("term"))).select("k", "th", "pos", "term")


def term_counts(docs: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """(term, n) over all texts, 0 where none has it; combined before any shuffle, so no word is too common."""
    if n_terms <= BROADCAST_WORDS:
        counts = _words_among(docs, terms, n_terms).groupBy("term").agg(F.count("*").alias("n"))
    else:
        counts = docs.select(F.explode(plain_words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return terms.join(counts, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def anchors(items: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds pairs: the places of the two rarest words of each window of an item, distinct; and lead: that of the rarest by the window's start (of equally rare words the first)."""
    places = items.select("item", "ih", F.posexplode("words").alias("p", "term")).join(counts, "term")
    rare = places.groupBy("item", "ih").agg(F.sort_array(F.collect_list(F.struct("p", "n"))).alias("rare"))
    first = lambda at: F.transform(F.slice("rare", at + 1, F.col("len")), lambda x: F.struct(x["n"].alias("n"), x["p"].alias("p")))
    two = lambda s: F.struct(F.get(s, F.lit(0))["p"].alias("a"), F.coalesce(F.get(s, F.lit(1))["p"], F.get(s, F.lit(0))["p"]).alias("b"))
    each = F.transform(F.sequence(F.lit(0), F.size("words") - F.col("len")), lambda at: let(F.sort_array(first(at)), two))
    found = items.join(rare, ["item", "ih"]).select("item", "ih", "words", "len", each.alias("each"))
    return found.select("item", "ih", "words", "len", F.array_distinct("each").alias("pairs"), F.transform("each", lambda x: x["a"]).alias("lead"))


def anchor_terms(items: DataFrame) -> DataFrame:
    """(term, item, ih, p): each anchor place of an item."""
    places = F.array_distinct(F.flatten(F.transform("pairs", lambda x: F.array(x["a"], x["b"]))))
    return items.select("item", "ih", "words", F.explode(places).alias("p")).select(F.element_at("words", F.col("p") + 1).alias("term"), "item", "ih", "p")


class Index:
    """The stored postings of one corpus for one benchmark; ``docs`` has k, th and text."""

    def __init__(self, spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = WINDOW):
        keep = Scratch(spark)
        plain = keep.table(items, "items") if "words" in items.columns else keep.table(item_windows(items, window), "items")
        terms = keep.table(plain.select(F.explode("words").alias("term")).distinct(), "terms")
        counts = term_counts(docs, terms, terms.count())
        self.items = keep.table(anchors(plain, counts), "anchors")
        self.anchors = keep.table(anchor_terms(self.items), "places")
        rare = self.anchors.select("term").distinct()
        self.postings = keep.table(_words_among(docs, rare, rare.count()), "postings")

    def _shifted(self) -> DataFrame:
        return self.postings.join(self.anchors, "term").select("k", "th", "item", "ih", "p", (F.col("pos") - F.col("p")).alias("delta"))

    def _both(self, found: DataFrame) -> DataFrame:
        """Of groups with the anchor places ``ps``, those with both anchors of a window."""
        return found.join(self.items, ["item", "ih"]).where(F.exists("pairs", lambda x: F.array_contains("ps", x["a"]) & F.array_contains("ps", x["b"])))

    def candidates(self) -> DataFrame:
        """(k, th, item, ih, deltas): diagonals where a window may occur."""
        one = self._shifted().groupBy("k", "th", "item", "ih", "delta").agg(F.collect_set("p").alias("ps"))
        return self._both(one).groupBy("k", "th", "item", "ih").agg(F.collect_list("delta").alias("deltas"))

    def near(self, slop: int = SLOP) -> DataFrame:
        """(k, th, item, ih, places): places (a, delta) of a window's rarest word that have the next rarest within ``slop`` words of its offset.

        Places are dealt into blocks of ``slop`` + 1 diagonals, each to its own
        and the next, so two that are close meet in one; a group holds one pair
        of anchors in one block and thus a bounded number of diagonals.
        """
        roles = self.items.select("item", "ih", "words", F.explode("pairs").alias("x")).select("item", "ih", "words", "x.a", "x.b", F.explode(F.array(F.struct(F.lit(True).alias("first"), F.col("x.a").alias("p")), F.struct(F.lit(False).alias("first"), F.col("x.b").alias("p")))).alias("r"))
        roles = roles.select(F.element_at("words", F.col("r.p") + 1).alias("term"), "item", "ih", "a", "b", "r.first", "r.p")
        s = self.postings.join(roles, "term").withColumn("delta", F.col("pos") - F.col("p"))
        block = F.floor(F.col("delta") / F.lit(slop + 1)).cast("long")
        of = lambda first: F.collect_set(F.when(F.col("first") == first, F.col("delta")))
        met = s.withColumn("block", F.explode(F.array(block, block + 1))).groupBy("k", "th", "item", "ih", "a", "b", "block").agg(of(True).alias("x"), of(False).alias("y"))
        close = F.filter("x", lambda x: F.exists("y", lambda y: F.abs(x - y) <= slop))
        places = met.select("k", "th", "item", "ih", "a", F.explode(close).alias("delta")).distinct()
        return places.groupBy("k", "th", "item", "ih").agg(F.collect_list(F.struct("a", "delta")).alias("places"))

    def found(self, slop: int | None = None) -> DataFrame:
        """(k, th, found): what is to be held against a text, each item's words once."""
        c = self.candidates()
        c = c.withColumn("places", F.array().cast("array<struct<a:int,delta:int>>")) if slop is None else c.join(self.near(slop), ["k", "th", "item", "ih"], "full")
        held = F.struct("item", F.coalesce("deltas", F.array()).alias("deltas"), F.coalesce("places", F.array()).alias("places"), "words", "len", "lead")
        return c.join(self.items.select("item", "ih", "words", "len", "lead"), ["item", "ih"]).groupBy("k", "th").agg(F.collect_list(held).alias("found"))


def hits(words: Column, found: Column) -> Column:
    """item, delta, len and the starts (in the item) of windows that occur, for each candidate diagonal."""

    def on(c: Column, delta: Column) -> Column:
        def occurs(s: Column) -> Column:
            at = delta + s
            return F.when(at < 0, False).otherwise(F.slice(words, at + 1, c["len"]) == F.slice(c["words"], s + 1, c["len"]))

        starts = F.filter(F.sequence(F.lit(0), F.size(c["words"]) - c["len"]), occurs)
        return F.struct(c["item"].alias("item"), delta.alias("delta"), c["len"].alias("len"), starts.alias("starts"))

    return F.filter(F.flatten(F.transform(found, lambda c: F.transform(c["deltas"], lambda d: on(c, d)))), lambda h: F.size(h["starts"]) > 0)


def near_items(words: Column, found: Column, slop: int) -> Column:
    """Ids of items with a window that matches in proximity, sorted and distinct."""

    def matches(c: Column, x: Column) -> Column:
        last = F.size(c["words"]) - c["len"]
        starts = F.filter(F.sequence(F.greatest(F.lit(0), x["a"] - c["len"] + 1), F.least(x["a"], last)), lambda s: F.get(c["lead"], s) == x["a"])

        def stands(q: Column) -> Column:
            low, high = F.greatest(F.lit(1), x["delta"] + q + 1 - slop), x["delta"] + q + 1 + slop
            return F.array_contains(F.slice(words, low, F.greatest(F.lit(0), high - low + 1)), F.get(c["words"], q))

        return F.exists(starts, lambda s: F.forall(F.sequence(s, s + c["len"] - 1), stands))

    held = F.filter(found, lambda c: F.exists(c["places"], lambda x: matches(c, x)))
    return F.sort_array(F.array_distinct(F.transform(held, lambda c: c["item"])))


def find(spark: SparkSession, docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, rows: bool = False, slop: int | None = None) -> DataFrame:
    """(doc_id, k, th, n_words, n_hit, items, near): words, words inside occurring windows, the sorted ids of their items, and with ``slop`` those of items with a window in proximity (which an exact one is too), else null.

    One row for each input row.  Null and empty texts have no words; items
    without words occur nowhere; an item of fewer words than a window is one
    window.  A null item id is an empty string; rows that share an id are held
    against the items by their own texts.  Other columns are not read, but with
    ``rows`` each row of ``docs`` is returned as the struct ``row``.
    """
    carried = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if rows else []
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(MAX_LONG)).alias("k"), F.xxhash64(text_col).alias("th"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *carried)
    found = Index(spark, base, items, window).found(slop)
    if rows:  # the text travels once
        base = base.drop("text")
    j = base.join(found, ["k", "th"], "left")
    if rows:
        j = j.withColumn("text", F.col("row")[text_col].cast("string"))

    def judge(w: Column) -> Column:
        def of(h: Column) -> Column:
            covered = F.flatten(F.transform(h, lambda x: F.flatten(F.transform(x["starts"], lambda s: F.sequence(x["delta"] + s, x["delta"] + s + x["len"] - 1)))))
            return F.struct(F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(covered)).cast("long").alias("n_hit"), F.sort_array(F.array_distinct(F.transform(h, lambda x: x["item"]))).alias("items"), near.alias("near"))

        near = F.lit(None).cast("array<string>") if slop is None else near_items(w, F.col("found"), slop)
        return let(hits(w, F.col("found")), of)

    n_words = F.size(any_words(F.col("text"))).cast("long")
    none = F.struct(n_words.alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"), F.lit(None if slop is None else []).cast("array<string>").alias("near"))
    names = ["doc_id", "k", "th", *(["row"] if rows else [])]
    return j.select(*names, F.when(F.col("found").isNull(), none).otherwise(let(plain_words(F.col("text")), judge)).alias("r")).select(*names, "r.*")


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """A twentieth of the words or more lie in windows of items."""
    return (n_hit > 0) & (20 * n_hit >= n_words)

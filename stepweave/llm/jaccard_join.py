"""Links between texts whose sets of word n-grams overlap, by vertical partitioning.

N-grams have one global order: those that a count-min sketch of all distinct
sets calls single come first, then the rarer by the sketch's counts, then by
hash.  Pivots cut the order into fragments; their number grows with the longest
set, and the single n-grams, which no two sets share, are in none.

The order is made again for the classes that may have a link, which are few.
Where the sketch's bound can't hold the n-grams, a shuffle counts them exactly.

1. Texts with equal sets are one class; one text stands for it.
2. A pair with Jaccard >= t shares one of the first ``n - ceil(t n) + 1``
   n-grams of both.  Those that aren't single are posted, with their place and
   the number of single n-grams of the set.  As single n-grams are first, a text
   of which more than 1 - t is its own posts nothing.
3. Each posting list links its members to one hub, the member with the fewest
   n-grams of its own, of those the largest (the original rather than a changed
   or shortened copy); the verified links make
   components.  Then the pairs of a list that lie in different components are
   tried, so a group of copies costs a star, not all its pairs, and no link
   between components is lost.  While more pairs are left than postings and
   stars still link, another hub is drawn for each list first.
4. A pair is tried only if sizes, places and single n-grams allow the overlap.
   Pairs meet by n-gram and size class, the smaller set by its shorter index
   prefix, so pairs that their sizes rule out never meet.
5. Every fragment counts its part of a pair's overlap separately, and the parts
   are summed per pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rolling, sketch
from .components import components
from .rolling import U
from .scratch import Scratch
from .substring_dedup import keyed

#: N-grams of the longest set that make one fragment.
FRAGMENT_GRAMS, LEAST_FRAGMENTS = 16_384, 4
#: Rows of (k, th) up to which the wanted texts are broadcast rather than shuffled.
BROADCAST_TEXTS = 300_000
#: Cells of a line of the sketch of all n-grams, as powers of two (16 MB at most); beyond, n-grams are counted by a shuffle.
LEAST_BITS, MOST_BITS = 12, 27
#: N-grams that a task holds before they become rows of the sketch; sorting them takes about 70 bytes each in every Python worker.
FLUSH_GRAMS = 1_000_000
#: Width of a size class, and the rounds of hubs at most before all pairs that are left are tried.
SIZE_STEP, MOST_ROUNDS = 1.1, 8
_SHORT = rolling.mix(np.arange(1, 65, dtype=U) * U(0x632BE59BD9B4E019))


def sets_of(column: pa.Array, gram: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes) of each text with a word."""
    for first, data, offsets in rolling.text_chunks(column):
        h, _, _, bounds = rolling.word_hashes(data, offsets, lower=True)
        grams = rolling.fold(h, gram)
        for i in range(len(bounds) - 1):
            a, b = bounds[i], bounds[i + 1]
            if b - a >= gram:
                yield first + i, np.unique(grams[a : b - gram + 1])
            elif b > a:
                whole = _SHORT[(b - a) % 64 : (b - a) % 64 + 1].copy()
                for w in h[a:b]:
                    whole = rolling.mix(whole * rolling.STEP[3] + w)
                yield first + i, whole


def set_hash(s: np.ndarray) -> np.uint64:
    return np.add.reduce(rolling.mix(s ^ U(0x5851F42D4C957F2D)))


class _Order:
    """The global order of n-grams, and pivots that cut the repeated ones into fragments of equal weight."""

    def __init__(self, lines: np.ndarray, levels: np.ndarray, bits: int, pivots: list[int]):
        self.repeated, self.levels, self.bits = sketch.repeated(lines, bits), levels, bits
        self.pivots = np.array(pivots, U)

    def keys(self, s: np.ndarray) -> np.ndarray:
        """Below 2**56 for the single ones; without a sketch by hash."""
        if not len(self.levels):
            return U(1 << 56) | s >> U(8)
        level = sketch.level_of(self.levels, s, self.bits).astype(U) + U(1)
        return np.where(self.repeated(s), level, U(0)) << U(56) | s >> U(8)


def _pivots(weight: np.ndarray, n: int) -> list[int]:
    """Keys that part the repeated n-grams, by their weight in each level, into ``n`` ranges."""
    share = np.append(0, np.cumsum(weight)) / max(1.0, weight.sum())
    out = []
    for f in range(1, n) if weight.any() else ():
        c = min(len(weight) - 1, int(np.searchsorted(share, f / n, "right")) - 1)
        out.append((c + 1 << 56) + int((f / n - share[c]) / max(1e-12, share[c + 1] - share[c]) * (2**56 - 1)))
    return out


class Join:
    """Sets, classes and links of one table; ``docs`` as from ``substring_dedup.keyed``."""

    def __init__(self, spark: SparkSession, docs: DataFrame, gram: int = 4, percent: int = 85):
        self.spark, self.docs, self.gram, self.percent = spark, docs.select("k", "th", "text"), gram, percent
        self.keep, self.verifications = Scratch(spark), 0
        self._classes()

    def _classes(self) -> None:
        """The size and hash of every text's set, the classes, and the texts that stand for them."""
        gram = self.gram

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, sig = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, U)
                for row, s in sets_of(batch.column(2), gram):
                    n[row], sig[row] = len(s), set_hash(s)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), rolling.signed(sig)], names=["k", "th", "n", "sig"])

        self.texts = self.keep.table(self.docs.mapInArrow(scan, "k long, th long, n int, sig long"), "scan")
        some = self.texts.where("n > 0")
        found = some.groupBy("sig").agg(F.min(F.struct("k", "th")).alias("o"), F.first("n").alias("n"))
        self.classes = self.keep.table(found.select("sig", "o.k", "o.th", "n"), "classes")
        total = self.classes.agg(F.sum("n"), F.max("n")).first()
        self.cells = 2
        self.grams, longest = total[0] or 0, total[1] or 0
        self.fragments = max(LEAST_FRAGMENTS, -(-longest // FRAGMENT_GRAMS))
        first = self.classes.select("k", "th")
        spare = self.keep.table(some.select("k", "th").distinct().join(first, ["k", "th"], "left_anti"), "spare")
        if spare.count() <= BROADCAST_TEXTS:
            self.first = self.docs.join(F.broadcast(spare), ["k", "th"], "left_anti")
        else:
            self.first = self.keep.table(self.docs.join(first, ["k", "th"], "left_semi"), "first")

    def _order(self) -> None:
        """The order by a sketch of the n-grams of ``self.first``, if one of ``MOST_BITS`` holds them; else only fragments by hash, and ``_ranked`` takes exact counts."""
        gram, bits = self.gram, max(LEAST_BITS, min(MOST_BITS, (self.cells * self.grams).bit_length()))
        self.sketched = self.grams >> MOST_BITS == 0
        if not self.sketched:
            self.order = self.spark.sparkContext.broadcast((np.zeros((0, 0), np.uint8), np.zeros(0, np.uint8), 0, _pivots(np.ones(1), self.fragments)))
            return

        def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from sketch.partial_rows((s for b in batches for _, s in sets_of(b.column(0), gram)), bits, FLUSH_GRAMS)

        lines, levels, weight = sketch.levelled(self.first.select("text").mapInArrow(prints, sketch.ROWS), bits)
        self.order = self.spark.sparkContext.broadcast((lines, levels, bits, _pivots(weight, self.fragments)))

    def _lists(self) -> DataFrame:
        """(h, i, n, a, sig): the postings of n-grams that two classes have, with their place in the order and the set's single n-grams.

        Only classes in a list can link.  While they have less than half of the
        n-grams, the order is made again for them alone: what no other of them
        has is single then, and a sketch that was nearly full holds them easily.
        """
        turn = 0
        while True:
            self._order()
            post = self.keep.table(self._posted() if self.sketched else self._ranked(), f"postings_{turn}")
            several = post.groupBy("h").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).where("lo <> hi").select("h")
            lists = self.keep.table(post.join(several, "h"), f"lists_{turn}")
            self.keep.drop(f"postings_{turn}")
            among = self.keep.table(lists.select("sig").distinct().join(self.classes, "sig").select("k", "th", "n"), f"among_{turn}")
            grams, texts = among.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
            if not self.sketched or not grams or 2 * grams > self.grams:
                return lists
            self.order.destroy()
            self.grams, self.cells, turn = grams, 16, turn + 1  # so that few share a cell's level
            among = among.select("k", "th")
            self.first = self.docs.join(F.broadcast(among) if texts <= BROADCAST_TEXTS else among, ["k", "th"], "left_semi")

    def _posted(self) -> DataFrame:
        order, gram, percent = self.order, self.gram, self.percent

        def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            o = _Order(*order.value)
            for batch in batches:
                out: list[list[np.ndarray]] = [[], [], [], [], []]
                for _, s in sets_of(batch.column(0), gram):
                    n, keys = len(s), o.keys(s)
                    a, prefix = int((keys < U(1 << 56)).sum()), n - (percent * n + 99) // 100 + 1
                    if a < prefix:
                        h = s[np.argsort(keys, kind="stable")[a:prefix]]
                        sig = set_hash(s)
                        for c, x in zip(out, (h, np.arange(a, prefix, dtype=np.int32), np.full(len(h), n, np.int32), np.full(len(h), a, np.int32), np.full(len(h), sig, U)), strict=True):
                            c.append(x)
                if out[0]:
                    h, i, n, a, sig = (np.concatenate(c) for c in out)
                    yield pa.RecordBatch.from_arrays([rolling.signed(h), pa.array(i), pa.array(n), pa.array(a), rolling.signed(sig)], names=["h", "i", "n", "a", "sig"])

        return self.first.select("text").mapInArrow(post, "h long, i int, n int, a int, sig long")

    def _ranked(self) -> DataFrame:
        """The same by exact counts: all n-grams are shuffled once to be counted, the repeated ones once more to be ranked."""
        gram = self.gram

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, s in sets_of(batch.column(0), gram):
                    yield pa.RecordBatch.from_arrays([rolling.signed(s), pa.array(np.full(len(s), len(s), np.int32)), rolling.signed(np.full(len(s), set_hash(s), U))], names=["h", "n", "sig"])

        grams = self.first.select("text").mapInArrow(each, "h long, n int, sig long")
        often = grams.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
        shared = grams.join(often, "h").distinct()  # a row that stands twice
        one = Window.partitionBy("sig")
        place = (F.col("n") - F.count("*").over(one)).cast("int")
        rank = F.row_number().over(one.orderBy("df", "h")) - 1
        return shared.select("h", "n", "sig", place.alias("a"), rank.alias("rank")).selectExpr("h", "a + rank as i", "n", "a", "sig").where(f"100L * (n - i) >= {self.percent}L * n")

    def _fits(self, x: str, y: str) -> str:
        """What n, i and a of two sets that share the n-gram at these places must fulfil for a link; true for the first one that linked sets share."""
        p = self.percent
        return (
            f"100L * least(n{x}, n{y}) >= {p}L * greatest(n{x}, n{y})"
            f" and {p + 100}L * least(n{x} - i{x}, n{y} - i{y}) >= {p}L * (n{x} + n{y})"
            # single n-grams of either are in one set only
            f" and {100 + p}L * (a{x} + a{y}) <= {100 - p}L * (n{x} + n{y})"
        )

    def _met(self, index: DataFrame, probe: DataFrame) -> DataFrame:
        """(a, b, na, nb): pairs of an index set and a probe set at least as large, in different groups ``c``, that share an n-gram and fit; distinct."""
        p = self.percent

        def size_class(n: str) -> Column:
            return F.floor(F.log(F.expr(n).cast("double")) / F.lit(math.log(SIZE_STEP))).cast("int")

        def named(x: str) -> list[Column]:
            return [F.col("sig").alias(x), *(F.col(c).alias(c + x) for c in ("n", "i", "a", "c"))]

        small = index.where(f"{p + 100}L * (n - i) >= {2 * p}L * n").select("h", size_class("n").alias("size"), *named("x"))
        # the least and the largest partner that length, place and single n-grams allow
        low = F.expr(f"greatest(({p}L * n + 99) div 100, ({100 + p}L * a + {100 - p - 1}L) div {100 - p}L - n, 1L)") if p < 100 else F.expr("cast(n as bigint)")
        large = probe.withColumn("low", low).withColumn("most", F.expr(f"least(n, (n - i) * {100 + p}L div {p}L - n)")).where("low <= most")
        large = large.select("h", F.explode(F.sequence(size_class("low"), size_class("most"))).alias("size"), *named("y"))
        met = small.join(large, ["h", "size"]).where(f"cx <> cy and (nx < ny or nx = ny and x <> y) and {self._fits('x', 'y')}")
        ordered = F.col("x") < F.col("y")
        return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(ordered, F.col("nx")).otherwise(F.col("ny")).alias("na"), F.when(ordered, F.col("ny")).otherwise(F.col("nx")).alias("nb")).distinct()

    def _fragments(self, sigs: DataFrame, name: str) -> DataFrame:
        """(sig, f, part): the repeated n-grams of these classes, cut at the pivots."""
        wanted = self.keep.table(sigs.join(self.classes.select("sig", "k", "th"), "sig"), f"wanted_{name}")
        if wanted.count() <= BROADCAST_TEXTS:
            wanted = F.broadcast(wanted)
        order, gram = self.order, self.gram

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            o = _Order(*order.value)
            for batch in batches:
                sig, out = batch.column(0).to_pylist(), []
                for row, s in sets_of(batch.column(1), gram):
                    keys = o.keys(s)
                    s, keys = s[keys >= U(1 << 56)], keys[keys >= U(1 << 56)]
                    f = np.searchsorted(o.pivots, keys, "right")
                    out += [(sig[row], int(x), s[f == x].view(np.int64)) for x in np.unique(f)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.list_(pa.int64()))], names=["sig", "f", "part"])

        texts = self.first.join(wanted, ["k", "th"]).select("sig", "text")
        return self.keep.table(texts.mapInArrow(cut, "sig long, f int, part array<long>"), f"fragments_{name}")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The written table (a, b, overlap) of the pairs (a, b, na, nb) that are links."""
        name = str(self.verifications)
        self.verifications += 1
        pairs = self.keep.table(pairs, f"pairs_{name}")
        parts = self._fragments(pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct(), name)
        x = parts.select(F.col("sig").alias("a"), "f", F.col("part").alias("x"))
        y = parts.select(F.col("sig").alias("b"), "f", F.col("part").alias("y"))
        each = pairs.join(x, "a").join(y, ["b", "f"]).select("a", "b", "na", "nb", "f", F.size(F.array_intersect("x", "y")).alias("c"))
        # a row that stands twice has its fragments twice
        sums = each.groupBy("a", "b", "na", "nb", "f").agg(F.max("c").alias("c")).groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("overlap"))
        links = sums.where(f"100 * overlap >= {self.percent} * (na + nb - overlap)").select("a", "b", "overlap")
        links = self.keep.table(links, f"links_{name}")
        for spent in ("wanted", "fragments"):
            self.keep.drop(f"{spent}_{name}")
        return links

    def links(self) -> DataFrame:
        """Every link (a, b, overlap) between two classes."""
        lists = self._lists().withColumn("c", F.col("sig"))
        return self.verified(self._met(lists, lists))

    def _star(self, lists: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
        """The lists with a hub each, and the pairs of hubs with members of other components."""
        score = F.expr("1000000L * a div n") if turn == 0 else F.xxhash64("sig", F.lit(turn))
        hubs = lists.groupBy("h").agg(F.min(F.struct(score.alias("score"), (-F.col("n")).alias("less"), "sig", "n", "i", "a", "c")).alias("o")).select("h", *(F.col(f"o.{c}").alias(n) for c, n in (("sig", "hub"), ("n", "ny"), ("i", "iy"), ("a", "ay"), ("c", "cy"))))
        j = lists.join(hubs, "h")
        near = j.withColumnsRenamed({"n": "nx", "i": "ix", "a": "ax"}).where(f"c <> cy and {self._fits('x', 'y')}")
        ordered = F.col("sig") < F.col("hub")
        pairs = near.select(F.least("sig", "hub").alias("a"), F.greatest("sig", "hub").alias("b"), F.when(ordered, F.col("nx")).otherwise(F.col("ny")).alias("na"), F.when(ordered, F.col("ny")).otherwise(F.col("nx")).alias("nb"))
        return j.select("h", "i", "n", "a", "sig", "hub"), pairs.distinct()

    def labels(self) -> DataFrame:
        """(node, component) of the classes that have a link."""
        keep, lists = self.keep, self._lists().withColumn("c", F.col("sig"))
        most, links, tried = lists.count(), None, None
        for turn in range(MOST_ROUNDS):
            with_hub, star = self._star(lists, turn)
            with_hub = keep.table(with_hub, f"hubs_{turn}")
            if tried is not None:
                star = star.join(tried, ["a", "b"], "left_anti")
            new = self.verified(star)
            pairs = self.spark.read.parquet(f"{keep.root}/pairs_{turn}").select("a", "b")
            links, tried = (new, pairs) if links is None else (links.unionByName(new), tried.unionByName(pairs))
            found = components(keep, links, f"star_{turn}")
            lists = with_hub.join(found, F.col("sig") == F.col("node"), "left").withColumn("c", F.coalesce("component", "sig")).drop("node", "component")
            lists = keep.table(lists, f"grouped_{turn}")
            keep.drop(f"hubs_{turn}")
            mixed = lists.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max(F.when(F.col("sig") == F.col("hub"), F.col("c"))).alias("hc")).where("lo <> hi").select("h", "hc")
            lists = lists.drop("hub").join(mixed, "h")
            away, home = lists.where("c <> hc"), lists.where("c = hc")
            rest = self._met(away, lists).unionByName(self._met(home, away)).distinct().join(tried, ["a", "b"], "left_anti")
            rest = keep.table(rest, f"rest_{turn}")
            left = rest.count()
            if left == 0:
                return found
            if left <= most or new.isEmpty():
                break
            lists = lists.drop("hc")
        return components(keep, links.unionByName(self.verified(rest)), "all")


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, k, th, n_shingles, component_id, class), one row for each input row.

    A set is the distinct ``gram``-word shingles of the lower-cased (A-Z) text,
    of a shorter text its whole sequence.  Texts link when 100 * intersection >=
    percent * union; component_id is the least id that links reach.  Null and
    empty texts have no set and reach only themselves; a null id counts as the
    largest and is returned as null.  ``class`` tells components apart that have
    the same least id; it is null for texts without a set.  Other columns are
    not read.
    """
    base = keyed(docs, id_col, text_col)
    join = Join(spark, base, gram, percent)
    classes = join.classes.join(join.labels(), F.col("sig") == F.col("node"), "left").select("sig", "k", F.coalesce("component", "sig").alias("c"))
    first = classes.groupBy("c").agg(F.min("k").alias("least"))
    ids = classes.join(first, "c").select("sig", "least", "c")
    t = join.texts
    whole = t.where("n > 0").join(ids, "sig").select("k", "th", "n", "least", "c").unionByName(t.where("n = 0").select("k", "th", "n", F.col("k").alias("least"), F.lit(None).cast("long").alias("c")))
    null = lambda c: F.when(F.col(c) != 9223372036854775807, F.col(c))
    return whole.select(null("k").alias("doc_id"), "k", "th", F.col("n").cast("long").alias("n_shingles"), null("least").alias("component_id"), F.col("c").alias("class"))

"""Removal of byte strings that stand earlier in the corpus, by suffix arrays.

Strings of ``length`` bytes fall into runs with one fingerprint, as in
``substring_dedup``; a sketch of all anchors leaves out the runs that cannot
repeat, and of equal runs in one chunk of documents only the first is sent on,
as the others stand later.  What is left is sharded by fingerprint:

* runs are cut to the strings whose hash repeats in the shard, and of parts
  that are equal then only the first stays;
* per shard, a suffix array by Larsson-Sadakane refinement (only groups that
  are not sorted yet are refined, by the rank of the suffix ``h`` further on),
  and common prefixes from the permuted form of Kasai's recurrence: only where
  the bytes before two neighbours differ are bytes compared at all;
* neighbours that share ``length`` bytes form a class, whose least place stays;
* a fingerprint with more than ``shard_bytes`` of distinct runs is split into
  several shards.  Their classes are then merged: sorted by the string's hash,
  each is found in the merged order by binary search, and the least place stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rolling, sketch
from .scratch import Scratch
from .substring_dedup import keyed, merge_spans

GRAM = 24
#: Rows of split fingerprints (16 bytes each) up to which they are broadcast.
BROADCAST_PRINTS = 500_000
_FOUND = "fp long, k long, th long, s long, e long, w long, kind int"
_FOUND_ARROW = pa.schema([("fp", pa.int64()), ("k", pa.int64()), ("th", pa.int64()), ("s", pa.int64()), ("e", pa.int64()), ("w", pa.int64()), ("kind", pa.int32())])


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of a byte array, in order."""
    n = len(t)
    key = np.zeros(n + 7, np.uint64)
    wide = np.zeros(n + 7, np.uint64)
    wide[:n] = t.astype(np.uint64) + np.uint64(1)  # the end is less than any byte
    for j in range(7):
        key[:n] |= wide[j : n + j] << np.uint64(9 * (6 - j))
    key = key[:n]
    order = np.argsort(key)
    new = np.ones(n, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.zeros(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    single = new & np.append(new[1:], True)
    left, h = np.flatnonzero(~single), 7
    while len(left):
        sub = order[left]
        ahead = sub + h
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        pair = rank[sub] << 32 | second
        turn = np.argsort(pair)
        sub, pair = sub[turn], pair[turn]
        order[left] = sub
        new = np.ones(len(left), bool)
        new[1:] = pair[1:] != pair[:-1]
        rank[sub] = np.maximum.accumulate(np.where(new, left, 0))
        left = left[~(new & np.append(new[1:], True))]
        h *= 2
    return order


def common_prefixes(t: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each suffix of ``order`` shares with the one before it (the first: 0)."""
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    # elsewhere the value is one less than at the place before
    fresh = (place == 0) | (before <= 0)
    fresh[1:] |= t[place[1:] - 1] != t[np.maximum(before[1:], 1) - 1]
    a = np.flatnonzero(fresh & (before >= 0))
    b = before[a]
    wide = np.zeros(n + 8, np.uint64)
    wide[:n] = t
    eight = np.zeros(n + 1, np.uint64)
    for j in range(8):
        eight |= wide[j : n + 1 + j] << np.uint64(8 * j)
    most = n - np.maximum(a, b)
    same = np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    while len(open_):
        x = eight[a[open_] + same[open_]] ^ eight[b[open_] + same[open_]]
        done = x != 0
        low = x[done] & (~x[done] + np.uint64(1))
        same[open_[done]] += (np.log2(low.astype(np.float64)) / 8).astype(np.int64)
        open_ = open_[~done]
        same[open_] += 8
        open_ = open_[same[open_] < most[open_]]
    value = np.zeros(n, np.int64)
    value[a] = np.minimum(same, most)
    value = np.maximum.accumulate(np.where(fresh, value + place, 0)) - place
    return value[order]


def _later(keys: list[np.ndarray], places: list[np.ndarray]) -> np.ndarray:
    """For rows sorted by keys, then places: whether a row's place is beyond the first of its key. A row that stands twice is at one place."""
    n = len(keys[0])
    new = np.ones(n, bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in keys], axis=0)
    heads = np.flatnonzero(new)
    head = heads[np.searchsorted(heads, np.arange(n), "right") - 1]
    return np.any([x != x[head] for x in places], axis=0)


def candidates(bodies: list[bytes], start: np.ndarray, whole: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bodies cut to the part whose strings may repeat in the shard, by their hashes: first byte in the joined bodies, size, body, start, and a hash of its strings; those of ``whole`` as they are."""
    t = np.frombuffer(b"".join(bodies), np.uint8)
    sizes = np.array([len(x) for x in bodies], np.int64)
    offsets, n = np.append(0, np.cumsum(sizes)), sizes - length + 1
    body = np.repeat(np.arange(len(bodies)), n)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    h = rolling.fold(rolling.BYTE_HASH[t], length)[offsets[body] + inner]
    turn = np.argsort(h)
    same = h[turn[1:]] == h[turn[:-1]]
    some = whole[body]
    some[turn[1:][same]] = True
    some[turn[:-1][same]] = True
    at = np.flatnonzero(some)
    if not len(at):
        return at, at, at, start[:0], h[:0]
    of = body[at]
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    last = np.append(first[1:], len(of)) - 1
    which, low = of[first], inner[at[first]]
    size = inner[at[last]] - low + length
    # by every string and its place: a sum of the strings' hashes is no more than the first one's where a part is one string
    return offsets[which] + low, size, which, start[which] + low, rolling.stretches(h, at[first], at[last] - at[first] + 1)


def repeats_in_shard(t: np.ndarray, sizes: np.ndarray, k: np.ndarray, start: np.ndarray, th: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each string in the bodies, which lie one after another in ``t``: body, start in it, whether an earlier one is equal, and its hash."""
    offsets, n = np.append(0, np.cumsum(sizes)), sizes - length + 1
    body = np.repeat(np.arange(len(sizes)), n)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = offsets[body] + inner
    order = suffix_array(t)
    group = np.zeros(len(t), np.int64)
    group[order] = np.cumsum(common_prefixes(t, order) < length)
    turn = np.lexsort((th[body], start[body] + inner, k[body], group[at]))
    later = np.zeros(len(at), bool)
    later[turn] = _later([group[at][turn]], [k[body][turn], (start[body] + inner)[turn], th[body][turn]])
    return body, inner, later, rolling.fold(rolling.BYTE_HASH[t], length)[at]


def _spans(fp: np.ndarray, k: np.ndarray, th: np.ndarray, s: np.ndarray, length: int) -> pa.RecordBatch:
    """Removal rows of single strings; neighbours in one text join."""
    if not len(s):
        return pa.RecordBatch.from_pylist([], schema=_FOUND_ARROW)
    new = np.ones(len(s), bool)
    new[1:] = (k[1:] != k[:-1]) | (th[1:] != th[:-1]) | (s[1:] != s[:-1] + 1) | (fp[1:] != fp[:-1])
    cut = np.flatnonzero(new)
    last = np.append(cut[1:], len(s)) - 1
    zero = np.zeros(len(cut), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (fp[cut], k[cut], th[cut], s[cut], s[last] + length, zero, zero.astype(np.int32))], schema=_FOUND_ARROW)


def repeated_spans(spark: SparkSession, docs: DataFrame, length: int = 100, sketch_bits: int | None = None, shard_bytes: int = 1 << 20) -> DataFrame:
    """(k, th, spans): byte ranges covered by a string of ``length`` bytes that also starts earlier; ``docs`` as from ``substring_dedup.keyed``."""
    gram = max(1, min(GRAM, length // 2))
    text = docs.select("text")
    bits = sketch_bits or sketch.bits_for(text)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[np.ndarray]:
            for batch in batches:
                for _, data, offsets in rolling.text_chunks(batch.column(0)):
                    yield rolling.runs(rolling.BYTE_HASH[data], offsets, length, gram, anchors=True)["anchors"]

        yield from sketch.partial_rows(each(), bits)

    seen = sketch.merged(spark, text.mapInArrow(prints, sketch.ROWS), bits)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = sketch.repeated(seen.value, bits)
        for batch in batches:
            k, th = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for first, data, offsets in rolling.text_chunks(batch.column(2)):
                units = rolling.BYTE_HASH[data]
                r = rolling.runs(units, offsets, length, gram)
                at = np.flatnonzero(ask(r["fp"]))
                if not len(at):
                    continue
                fp, start, size = r["fp"][at], r["start"][at], (r["n"][at] + length - 1).astype(np.int64)
                row = r["row"][at] + first
                # of equal runs in the chunk only the first travels with its bytes; the others go whole
                # equal in every string: the first and last don't tell what lies between them
                strings = rolling.stretches(rolling.fold(units, length), r["at"][at], r["n"][at])
                turn = np.lexsort((th[row], start, k[row], size, strings, fp))
                again = np.zeros(len(at), bool)
                again[turn] = _later([x[turn] for x in (fp, strings, size)], [x[turn] for x in (k[row], start, th[row])])
                body = rolling.slices(data, r["at"][at], np.where(again, 0, size))
                yield pa.RecordBatch.from_arrays([rolling.signed(fp), pa.array(k[row]), pa.array(th[row]), pa.array(start), pa.array(size), body], names=["fp", "k", "th", "start", "size", "body"])

    keep = Scratch(spark)
    found = keep.table(docs.select("k", "th", "text").mapInArrow(emit, "fp long, k long, th long, start long, size long, body binary"), "runs", "zstd")
    seen.destroy()
    again = F.length("body") == 0
    whole = found.where(again).select("k", "th", F.col("start").alias("s"), (F.col("start") + F.col("size")).alias("e"))
    sizes = found.where(~again).groupBy("fp").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > F.lit(shard_bytes))
    sizes = keep.table(sizes.select("fp", F.ceil(F.col("bytes") / F.lit(shard_bytes)).cast("int").alias("split")), "split")
    if sizes.count() <= BROADCAST_PRINTS:  # at most the bytes of all runs by shard_bytes
        sizes = F.broadcast(sizes)
    salted = found.where(~again).join(sizes, "fp", "left")
    salted = salted.select("fp", F.coalesce(F.pmod(F.xxhash64("k", "start"), F.col("split")), F.lit(0)).alias("salt"), F.col("split").isNotNull().alias("many"), "k", "start", "th", "body")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def solve() -> Iterator[pa.RecordBatch]:
            fp, _, many, k, start, th, bodies = zip(*held, strict=True)
            fp, many, k, start, th = (np.array(x) for x in (fp, many, k, start, th))
            place, sizes, which, start, strings = candidates(list(bodies), start, many, length)
            if not len(sizes):
                return
            fp, many, k, th = (x[which] for x in (fp, many, k, th))
            # of equal parts only the first goes on; what is left are different texts that share strings
            turn = np.lexsort((th, start, k, sizes, strings, fp))
            again = np.zeros(len(turn), bool)
            again[turn] = _later([x[turn] for x in (fp, strings, sizes)], [x[turn] for x in (k, start, th)])
            zero = np.zeros(int(again.sum()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (fp[again], k[again], th[again], start[again], start[again] + sizes[again], zero, zero.astype(np.int32))], schema=_FOUND_ARROW)
            fp, many, k, th, start, sizes, place = (x[~again] for x in (fp, many, k, th, start, sizes, place))
            t, _ = rolling.joined(sizes, place, np.frombuffer(b"".join(bodies), np.uint8))
            body, inner, later, w = repeats_in_shard(t, sizes, k, start, th, length)
            out = body[later]
            yield _spans(fp[out], k[out], th[out], start[out] + inner[later], length)
            if (first := many[body] & ~later).any():
                b, s = body[first], (start[body] + inner)[first]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (fp[b], k[b], th[b], s, s + length, w[first].view(np.int64), np.ones(len(b), np.int32))], schema=_FOUND_ARROW)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][:2] != row[:2] and (size >= shard_bytes or row[2] or held[-1][2]):
                    yield from solve()
                    held, size = [], 0
                held.append(row)
                size += len(row[-1])
        if held:
            yield from solve()

    solved = keep.table(salted.repartition(parts, "fp", "salt").sortWithinPartitions("fp", "salt").mapInArrow(shards, _FOUND), "solved")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = None  # key and place of the last class
        for batch in batches:
            fp, k, th, s, _, w, _ = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if least and (fp[0], w[0]) == least[0]:  # a class may go on in the next batch
                fp, w, k, s, th = (np.append(v, x) for v, x in zip((*least[0], *least[1]), (fp, w, k, s, th), strict=True))
            later = _later([fp, w], [k, s, th])
            at = np.searchsorted(np.cumsum(np.append(True, (fp[1:] != fp[:-1]) | (w[1:] != w[:-1]))), np.sum((fp[1:] != fp[:-1]) | (w[1:] != w[:-1])) + 1)
            least = ((fp[at], w[at]), (k[at], s[at], th[at]))
            yield _spans(*(x[later] for x in (fp, k, th, s)), length)

    split = solved.where("kind = 1").repartition(parts, "fp", "w").sortWithinPartitions("fp", "w", "k", "s", "th").mapInArrow(merge, _FOUND)
    cuts = whole.unionByName(solved.where("kind = 0").select("k", "th", "s", "e")).unionByName(split.select("k", "th", "s", "e"))
    return cuts.groupBy("k", "th").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def remove_repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, sketch_bits: int | None = None, shard_bytes: int = 1 << 20) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): ``kept`` is the remaining bytes, which may cut a character.

    Null is an empty text.  Places are ordered by id (null last), then start;
    of rows that share an id, the text with the lesser hash comes first at an
    equal start.  Repeated rows are one text and are returned repeated.  Other
    columns of ``docs`` are not read.  An empty table gives no rows.
    """
    base = keyed(docs, id_col, text_col)
    spans = repeated_spans(spark, base, length, sketch_bits, shard_bytes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, removed, n_spans, kept = [], [], [], []
            for text, ranges in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text = text or b""
                cuts = merge_spans([(r["s"], r["e"]) for r in ranges or ()])
                size.append(len(text))
                n_spans.append(len(cuts))
                edges = [0, *(x for c in cuts for x in c), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if cuts else text)
                removed.append(size[-1] - len(kept[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (size, removed, n_spans)), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = base.join(spans, ["k", "th"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")

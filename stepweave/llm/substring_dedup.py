"""Removal of word passages that another document has already.

A window is ``length`` consecutive white-space words.  Windows fall into runs
with the same fingerprint (the least hash of their word grams, see
``rolling.runs``); equal windows have equal fingerprints.

1. Every task sketches its fingerprints; the merged count-min sketch
   overestimates how often each occurs, so a window that occurs in two
   documents is never estimated as single.
2. A second pass emits the runs that are estimated repeated and groups them
   exactly: first whole runs (an interior of a shared passage or of a copy is
   one row per document, combined before the shuffle), then the single windows
   of runs that differ under one fingerprint, which are the edges of passages.

Each grouping is a sum-like ``min`` with map-side combination, so a passage in a
third of all documents costs one row per task there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rolling, sketch
from .scratch import Scratch
from .words import MAX_LONG

GRAM = 24
_RUNS = "fp long, k long, th long, start long, n int, body array<long>"


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k: the id, null last; th: hash of the text, so that rows which share an id are told apart."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(MAX_LONG)).alias("k"), F.xxhash64(text_col).alias("th"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted maximal runs of half-open spans; touching ones join."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def repeated_spans(spark: SparkSession, docs: DataFrame, length: int = 50, sketch_bits: int | None = None) -> DataFrame:
    """(k, th, spans): word ranges covered by a window that also starts in a document with a smaller id; ``docs`` as from ``keyed``."""
    gram = max(1, min(GRAM, length // 2))
    text = docs.select("text")
    bits = sketch_bits or sketch.bits_for(text)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[np.ndarray]:
            for batch in batches:
                for _, data, offsets in rolling.text_chunks(batch.column(0)):
                    h, _, _, bounds = rolling.word_hashes(data, offsets)
                    yield rolling.runs(h, bounds, length, gram)["fp"]

        yield from sketch.partial_rows(each(), bits)

    seen = sketch.merged(spark, text.mapInArrow(prints, sketch.ROWS), bits)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = sketch.repeated(seen.value, bits)
        for batch in batches:
            k, th = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for first, data, offsets in rolling.text_chunks(batch.column(2)):
                h, _, _, bounds = rolling.word_hashes(data, offsets)
                r = rolling.runs(h, bounds, length, gram)
                at = np.flatnonzero(ask(r["fp"]))
                if not len(at):
                    continue
                n, row = r["n"][at], r["row"][at] + first
                flat, offs = rolling.joined(n, r["at"][at], rolling.fold(h, length))
                body = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), rolling.signed(flat))
                yield pa.RecordBatch.from_arrays([rolling.signed(r["fp"][at]), pa.array(k[row]), pa.array(th[row]), pa.array(r["start"][at]), pa.array(n.astype(np.int32)), body], names=["fp", "k", "th", "start", "n", "body"])

    keep = Scratch(spark)
    found = keep.table(docs.select("k", "th", "text").mapInArrow(emit, _RUNS).withColumn("run", F.xxhash64("body")), "runs")
    seen.destroy()
    kinds = keep.table(found.groupBy("fp", "body").agg(F.min("k").alias("k0")).withColumn("run", F.xxhash64("body")), "kinds")
    several = kinds.groupBy("fp").agg(F.count("*").alias("c"), F.min("k0").alias("least")).where("c > 1")
    later = kinds.join(several, "fp").select("fp", "run", "k0", "body", "least")
    windows = later.select("fp", "run", "k0", "least", F.posexplode("body").alias("at", "w"))
    least = windows.groupBy("fp", "w").agg(F.min("k0").alias("first"))
    partly = windows.where("k0 > least").join(least, ["fp", "w"]).where("first < k0").groupBy("fp", "run", "k0").agg(F.collect_list("at").alias("ats"))
    found = found.select("fp", "run", "k", "th", "start", "n")
    # both whole runs and single windows hang on (fp, run): one join decides each run
    verdict = kinds.select("fp", "run", "k0").join(partly, ["fp", "run", "k0"], "left")
    j = found.join(verdict, ["fp", "run"]).where("k0 < k or ats is not null")

    def span(s: Column, e: Column) -> Column:
        return F.struct(s.alias("s"), e.alias("e"))

    whole = F.array(span(F.col("start"), F.col("start") + F.col("n") + F.lit(length - 1)))
    some = F.transform("ats", lambda a: span(F.col("start") + a, F.col("start") + a + F.lit(length)))
    j = j.select("k", "th", F.when(F.col("k0") < F.col("k"), whole).otherwise(some).alias("spans"))
    return j.groupBy("k", "th").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def remove_repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, sketch_bits: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): ``kept`` is the binary text of the remaining words, joined by one space.

    Null and empty texts have no words and nothing removed.  Rows that share an
    id are one document with several texts: neither removes words of the other.
    A null id counts as the largest.  Repeated rows are returned repeated.
    Other columns of ``docs`` are not read.  An empty table gives no rows.
    """
    base = keyed(docs, id_col, text_col)
    spans = repeated_spans(spark, base, length, sketch_bits)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, spans = (batch.column(i) for i in range(3))
            words, removed, kept = [], [], []
            for text, ranges in zip(texts.cast(pa.binary()).to_pylist(), spans.to_pylist(), strict=True):
                w = (text or b"").split()
                words.append(len(w))
                if ranges:
                    cuts = merge_spans([(r["s"], r["e"]) for r in ranges])
                    for s, e in reversed(cuts):
                        del w[s:e]
                removed.append(words[-1] - len(w))
                kept.append(b" ".join(w))
            yield pa.RecordBatch.from_arrays([ids, pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])

    joined = base.join(spans, ["k", "th"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept binary")

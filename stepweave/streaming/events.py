"""Structured Streaming over arrivals: windowed counts with late data, and merging of graphs as chunks come."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import merge


def windowed_counts(events: DataFrame, ts: str = "ts", by: str = "event_type", size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums in tumbling windows; works on a stream and on a table alike."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, ts: str = "ts", user: str = "user_id", gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), user).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), user, "n")


def merged_steps(graphs: DataFrame, threshold: float = merge.THRESHOLD) -> DataFrame:
    """(doc, chunker, id, text): new steps as graphs of (doc, chunker, chunk_idx, steps) arrive; state is the last kept steps only."""

    def add(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, last = (state.get[0], json.loads(state.get[1])) if state.exists else (0, [])
        out = []
        for f in frames:
            for _, row in f.sort_values("chunk_idx").iterrows():
                before = [merge.bag(t) for t in last[-merge.LAST_STEPS :]]
                for s in row.steps if row.steps is not None else ():
                    if all(merge.similar(merge.bag(s["text"]), b) < threshold for b in before):
                        out.append({"doc": key[0], "chunker": key[1], "id": f"c{seen}_{s['id']}", "text": s["text"]})
                        last.append(s["text"])
                seen += 1
        state.update((seen, json.dumps(last[-merge.LAST_STEPS :])))
        yield pd.DataFrame(out, columns=["doc", "chunker", "id", "text"])

    return graphs.groupBy("doc", "chunker").applyInPandasWithState(add, "doc string, chunker string, id string, text string", "seen long, last string", "append", "NoTimeout")

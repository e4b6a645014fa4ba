"""Union of the graphs of a cell's chunks, without near duplicates.

What is a duplicate depends on what was kept before, so a cell is one ordered
fold.  A cell's graphs travel as one row, and the fold is a map over rows: no
shuffle happens here, and a cell is bounded by the chunks that are extracted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import schemas

THRESHOLD, LAST_STEPS, LAST_CLAUSES = 0.78, 12, 30
_RESULT = (
    f"doc string, chunker string, steps array<struct<id:string,ordinal:int,text:string,page:int,_chunk:int>>, preconditions array<struct<id:string,text:string,_chunk:int>>, "
    f"constraints array<struct<id:string,text:string,kind:string,_chunk:int>>, edges {schemas.EDGES}, duplicate_count int, dropped_edge_count int"
)


def bag(s: str | None) -> frozenset[str]:
    return frozenset(re.findall(r"\w+", (s or "").lower()))


def similar(a: frozenset[str], b: frozenset[str]) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def merge_graphs(graphs: list[dict], threshold: float = THRESHOLD) -> dict:
    """Graphs in chunk order to one; ids become c<position>_<id>."""
    alias: dict[str, str] = {}
    kept: dict[str, list[tuple[dict, frozenset]]] = {"steps": [], "preconditions": [], "constraints": []}
    edges: list[tuple[str, str, str]] = []
    repeats = 0
    for at, g in enumerate(graphs):
        new_id = lambda x, i, at=at: f"c{at}_{x.get('id') or i}"
        own = {new_id(x, f"{name[0]}?") for name in kept for x in g.get(name) or ()}
        before = kept["steps"][-LAST_STEPS:]
        for s in g.get("steps") or ():
            b, name = bag(s.get("text")), new_id(s, "s?")
            # the best of the last steps; of equal ones the oldest
            best = max(enumerate(before), key=lambda x: (similar(b, x[1][1]), -x[0]), default=None)
            if best and similar(b, best[1][1]) >= threshold:
                alias[name] = best[1][0]["id"]
                repeats += 1
            else:
                kept["steps"].append(({"id": name, "text": s.get("text") or "", "page": s.get("page"), "_chunk": at}, b))
        for name, blank in (("preconditions", "p?"), ("constraints", "c?")):
            for c in g.get(name) or ():
                b, cid = bag(c.get("text")), new_id(c, blank)
                twin = next((k for k, other in reversed(kept[name][-LAST_CLAUSES:]) if similar(b, other) >= threshold), None)
                if twin:
                    alias[cid] = twin["id"]
                else:
                    kept[name].append(({"id": cid, "text": c.get("text") or "", "kind": c.get("kind") or "other", "_chunk": at}, b))
        for e in g.get("edges") or ():
            ends = [f"c{at}_{e.get(x)}" if f"c{at}_{e.get(x)}" in own else e.get(x) or "" for x in ("from", "to")]
            edges.append((e.get("type") or "", *ends))
    steps = [{**s, "ordinal": i} for i, (s, _) in enumerate(kept["steps"], 1)]
    out = dict.fromkeys(("precedes", a["id"], b["id"]) for a, b in zip(steps, steps[1:], strict=False))
    known = {s["id"] for name in kept for s, _ in kept[name]}
    dropped = 0
    for kind, a, b in edges:
        a, b = alias.get(a, a), alias.get(b, b)
        if a in known and b in known:
            out[kind, a, b] = None
        else:
            dropped += 1
    strip = lambda rows, keys: [{k: r[k] for k in keys} for r, _ in rows]
    return {
        "steps": [{k: s[k] for k in ("id", "ordinal", "text", "page", "_chunk")} for s in steps], "preconditions": strip(kept["preconditions"], ("id", "text", "_chunk")),
        "constraints": strip(kept["constraints"], ("id", "text", "kind", "_chunk")), "edges": [{"type": t, "from": a, "to": b} for t, a, b in out], "duplicate_count": repeats, "dropped_edge_count": dropped,
    }


def _plain(x):
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)) or type(x).__name__ == "ndarray":
        return [_plain(v) for v in x]
    if isinstance(x, float) and x != x:
        return None
    return int(x) if isinstance(x, float) and x == int(x) else x


def merge_cells(cells: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc, chunker, graphs) to merged graphs; ``graphs`` has chunk_idx and graph."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for doc, chunker, graphs in zip(f.doc, f.chunker, f.graphs, strict=True):
                ordered = sorted(_plain(graphs if graphs is not None else []), key=lambda g: g["chunk_idx"])
                rows.append({"doc": doc, "chunker": chunker, **merge_graphs([g["graph"] or {} for g in ordered], threshold)})
            yield pd.DataFrame(rows, columns=["doc", "chunker", "steps", "preconditions", "constraints", "edges", "duplicate_count", "dropped_edge_count"])

    return cells.select("doc", "chunker", "graphs").mapInPandas(run, _RESULT)


def gather(extracted: DataFrame) -> DataFrame:
    """(doc, chunker, chunk_idx, graph) rows to cells; at most as many graphs as chunks are sampled."""
    return extracted.groupBy("doc", "chunker").agg(F.collect_list(F.struct("chunk_idx", "graph")).alias("graphs"))


def normalise(graph: Column) -> Column:
    """Absent lists as empty ones."""
    parts = (("steps", schemas.STEPS), ("preconditions", schemas.PRECONDITIONS), ("constraints", schemas.CONSTRAINTS), ("edges", schemas.EDGES))
    return F.struct(*(F.coalesce(graph[n], F.array().cast(kind)).alias(n) for n, kind in parts))


def sweep(cells: DataFrame, thresholds: tuple[float, ...] = (0.65, 0.70, 0.78, 0.85, 0.90)) -> DataFrame:
    """(threshold, chunker, mean_steps, retention): the merge at several thresholds."""
    n_in = F.aggregate(F.transform("graphs", lambda g: F.coalesce(F.size(g["graph"]["steps"]), F.lit(0))), F.lit(0), lambda a, x: a + x)
    counts = cells.select("doc", "chunker", n_in.alias("n_in"))
    out = None
    for t in thresholds:
        m = merge_cells(cells, t).select("doc", "chunker", F.size("steps").alias("n")).join(counts, ["doc", "chunker"])
        m = m.groupBy("chunker").agg(F.avg("n").alias("mean_steps"), (F.sum("n") / F.sum("n_in")).alias("retention")).withColumn("threshold", F.lit(t))
        out = m if out is None else out.unionByName(m)
    return out

"""Sampling of chunks, and extraction of a graph from each by a provider."""

from __future__ import annotations

import json
import random
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import schemas
from . import chunkers

SAMPLE, SEED = 20, 0
RESULT = f"doc string, chunker string, chunk_idx int, graph {schemas.GRAPH}, error string, input_tokens int, output_tokens int, cached_tokens int"
# Messages after which a call is made once more, and words that tell a constraint's kind.
RETRY = "overload|rate|timeout|timed out|connection"
KINDS = {"ppe": "ppe|gloves|goggles|respirator|wear", "lockout": "lockout|tagout|loto|isolat", "hazard": "hazard|warning|danger|caution"}
PROMPT = "Extract the procedure in the text as JSON with steps, preconditions, constraints and edges."


def drawn(n: int, k: int = SAMPLE, seed: int = SEED) -> list[int]:
    """Which of n chunks are taken, drawn by the standard generator anew for each n."""
    return list(range(n)) if n <= k else sorted(random.Random(seed).sample(range(n), k))


def sample_chunks(chunks: DataFrame, k: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """At most k chunks of each document, in order.

    Counts above k need a draw each.  A window counts a document's chunks, so
    that they are made once, and a draw is kept for each distinct count of a batch.
    """

    @F.pandas_udf("array<long>")
    def draw(n: pd.Series) -> pd.Series:
        return n.map({x: drawn(int(x), k, seed) if x > k else [] for x in n.unique()})

    counted = chunks.where(F.col("doc").isNotNull()).withColumn("n", F.count("*").over(Window.partitionBy("doc")))
    return counted.where((F.col("n") <= k) | F.array_contains(draw("n"), F.col("idx").cast("long"))).drop("n")


def lenient_json(s: str | None) -> dict | None:
    """The whole string, a fenced block, or the first balanced braces (counted without regard to quotes)."""
    fence = re.search(r"```(?:json)?\s*(.*?)```", s or "", re.DOTALL)
    tries = [s or "", fence[1] if fence else ""]
    depth, start = 0, None
    for i, c in enumerate(s or ""):
        if c == "{":
            start = i if not depth else start
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                tries.append(s[start : i + 1])
                break
    for t in tries:
        try:
            if isinstance(x := json.loads(t), dict):
                return x
        except ValueError:
            pass
    return None


def shaped(x: dict | None) -> dict:
    x = x if isinstance(x, dict) else {}
    return {k: x[k] if isinstance(x.get(k), list) else [] for k in ("steps", "preconditions", "constraints", "edges")}


def parsed(reply: Column) -> Column:
    """The graph in a reply, with every list present; empty lists where there is none. Batches go to Python by Arrow."""

    @F.pandas_udf("string")
    def tidy(s: pd.Series) -> pd.Series:
        return s.map(lambda x: json.dumps(shaped(lenient_json(x))))

    return F.from_json(tidy(reply), schemas.struct(f"graph {schemas.GRAPH}").fields[0].dataType)


def prompt(title: Column, text: Column) -> Column:
    return F.concat_ws("\n\n", F.lit(PROMPT), F.concat(F.lit("Title: "), F.coalesce(title, F.lit(""))), F.concat(F.lit("Text:\n"), text))


Provider = Callable[[str, int, str], dict]
PROVIDERS: dict[str, Provider] = {}


def provider(name: str) -> Callable[[Provider], Provider]:
    def put(f: Provider) -> Provider:
        PROVIDERS[name] = f
        return f

    return put


@provider("dry_run")
def dry_run(text: str, idx: int, title: str) -> dict:
    return {"graph": shaped(None)}


@provider("rules")
def rules(text: str, idx: int, title: str) -> dict:
    """Paragraph kinds as a graph: clauses hold for the next step. Our own; no claim to match a language model."""
    g, waiting = shaped(None), []
    order = (("HEADING", chunkers.HEADING), ("STEP", chunkers.STEP), ("SAFETY", chunkers.SAFETY), ("PRECONDITION", chunkers.PRECONDITION))
    for para in filter(None, (p.strip() for p in re.split(r"\n\s*\n", re.sub(T.PAGE_BREAK, "", text)))):
        line = para.splitlines()[0]
        word = re.match(r"\s*([A-Za-z]+)", line)
        kind = next((k for k, p in order if re.match(p, line)), "STEP" if len(para) <= chunkers.IMPERATIVE_CHARS and word and word[1].lower() in chunkers.IMPERATIVES else "BODY")
        if kind == "STEP":
            sid = f"s{len(g['steps']) + 1}"
            g["steps"].append({"id": sid, "ordinal": len(g["steps"]) + 1, "text": para, "page": None})
            g["edges"] += [{"type": t, "from": c, "to": sid} for t, c in waiting]
            waiting = []
            if len(g["steps"]) > 1:
                g["edges"].append({"type": "precedes", "from": g["steps"][-2]["id"], "to": sid})
        elif kind == "PRECONDITION":
            g["preconditions"].append({"id": f"p{len(g['preconditions']) + 1}", "text": para})
            waiting.append(("precondition_of", g["preconditions"][-1]["id"]))
        elif kind == "SAFETY":
            what = next((k for k, p in KINDS.items() if re.search(p, line, re.I)), "other")
            g["constraints"].append({"id": f"c{len(g['constraints']) + 1}", "text": para, "kind": what})
            waiting.append(("constrains", g["constraints"][-1]["id"]))
    return {"graph": g}


def extract(chunks: DataFrame, by: str | Provider = "dry_run", wait: float = 2.5) -> DataFrame:
    """(doc, chunker, chunk_idx, graph, error, token counts) of each chunk; errors are a column, a passing one is tried once more."""
    call = PROVIDERS[by] if isinstance(by, str) else by

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for doc, chunker, idx, text, title in f.itertuples(index=False):
                out: dict = {}
                for attempt in (0, 1):
                    try:
                        out = call(text or "", int(idx), title or "")
                        break
                    except Exception as x:
                        out = {"error": str(x)[:500]}
                        if attempt or not re.search(RETRY, str(x), re.I):
                            break
                        time.sleep(wait)
                rows.append({"doc": doc, "chunker": chunker, "chunk_idx": int(idx), "graph": shaped(out.get("graph")), "error": out.get("error"), **{k: out.get(k) for k in ("input_tokens", "output_tokens", "cached_tokens")}})
            frame = pd.DataFrame(rows, columns=[x.split()[0] for x in ("doc", "chunker", "chunk_idx", "graph", "error", "input_tokens", "output_tokens", "cached_tokens")])
            yield frame.astype({k: "Int32" for k in ("input_tokens", "output_tokens", "cached_tokens")})

    title = F.col("title") if "title" in chunks.columns else F.lit("")
    name = F.col("chunker") if "chunker" in chunks.columns else F.col("meta.chunker")
    return chunks.select("doc", name.alias("chunker"), "idx", "text", title.alias("title")).mapInPandas(run, RESULT)


def replay(chunks: DataFrame, recorded: DataFrame) -> DataFrame:
    """Recorded graphs of these chunks, joined by document, chunker and index."""
    r = recorded.select("doc", "chunker", F.explode("graphs").alias("g")).select("doc", "chunker", F.col("g.chunk_idx").alias("chunk_idx"), "g.graph", "g.error", "g.input_tokens", "g.output_tokens", "g.cached_tokens")
    return chunks.select("doc", F.col("meta.chunker").alias("chunker"), F.col("idx").cast("int").alias("chunk_idx")).join(r, ["doc", "chunker", "chunk_idx"])


def accounting(extracted: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or ["doc", "chunker"]
    z = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c)
    return extracted.groupBy(*by).agg(z("input_tokens"), z("output_tokens"), z("cached_tokens"), F.count_if(F.col("error").isNotNull()).alias("n_errors"))

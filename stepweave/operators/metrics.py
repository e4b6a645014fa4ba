"""Alignment of a predicted graph with a gold graph, and six measures of it.

A pair of graphs is one row with two struct columns.  The alignment is computed
once a row, as an array of (sim, g, p); everything else derives from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

JACCARD, COSINE = 0.55, 0.65
MEASURES = ("step_order_tau", "step_precision", "step_count_fidelity", "precondition_recall", "constraint_f1", "orphan_constraint_rate")
PAIR = "struct<sim:double,g:string,p:string>"


def let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def greedy(pairs: Column) -> Column:
    """One-to-one matches, best first: by similarity, then ids as strings, all descending."""
    free = lambda acc, x: ~F.exists(acc, lambda m: (m["g"] == x["g"]) | (m["p"] == x["p"]))
    return F.aggregate(F.sort_array(pairs, asc=False), F.array().cast(f"array<{PAIR}>"), lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(x))).otherwise(acc))


def _pairs(gold: Column, pred: Column, sim, least: float) -> Column:
    each = F.flatten(F.transform(gold, lambda g: F.transform(pred, lambda p: F.struct(sim(g, p).cast("double").alias("sim"), g["id"].alias("g"), p["id"].alias("p")))))
    return F.filter(F.coalesce(each, F.array().cast(f"array<{PAIR}>")), lambda x: x["sim"] >= least)


def align_words(gold: Column, pred: Column, least: float = JACCARD) -> Column:
    """Matches of nodes by the words they share."""
    bags = lambda xs: F.transform(xs, lambda x: F.struct(x["id"].alias("id"), T.word_bag(x["text"]).alias("bag")))
    return let(F.struct(bags(gold).alias("g"), bags(pred).alias("p")), lambda b: greedy(_pairs(b["g"], b["p"], lambda g, p: T.jaccard(g["bag"], p["bag"]), least)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def align_vectors(gold: Column, pred: Column, least: float = COSINE) -> Column:
    """Matches of nodes (id, vec) with unit vectors."""
    return greedy(_pairs(gold, pred, lambda g, p: dot(g["vec"], p["vec"]), least))


def _image(matches: Column, gold_id: Column) -> Column:
    return F.get(F.filter(matches, lambda m: m["g"] == gold_id), F.lit(0))["p"]


def tau(gold_steps: Column, pred_steps: Column, matches: Column) -> Column:
    """Signed share of gold step pairs in order; a step without a match counts as behind all predicted ones. Under two steps: 1."""
    ordered = F.transform(F.sort_array(F.transform(gold_steps, lambda s, i: F.struct(s["ordinal"].alias("o"), i.alias("i"), s["id"].alias("id")))), lambda s: s["id"])

    def of(o: Column) -> Column:
        seq = F.transform(o, lambda g: let(_image(matches, g), lambda p: F.when(p.isNull(), F.size(pred_steps)).otherwise(F.array_position(F.transform(pred_steps, lambda s: s["id"]), p).cast("int") - 1)))
        n = F.size(o)

        def score(s: Column) -> Column:
            row = lambda i: F.aggregate(F.slice(s, i + 2, F.size(s)), F.lit(0), lambda a, x: a + F.signum(x - F.get(s, i)).cast("int"))
            return F.aggregate(F.sequence(F.lit(0), n - 2), F.lit(0), lambda a, i: a + row(i)) / (n * (n - 1) / 2)

        return F.when(n < 2, 1.0).otherwise(let(seq, score))

    return let(ordered, of)


def _of_type(edges: Column, kind: str) -> Column:
    return F.transform(F.filter(edges, lambda e: e["type"] == kind), lambda e: F.struct(e["from"].alias("a"), e["to"].alias("b")))


def measures(pairs: DataFrame, gold: str = "gold", pred: str = "pred", vacuous: str = "one") -> DataFrame:
    """Adds the six measures and four counts. ``vacuous``: what recall is without gold preconditions, "one" or "null"."""
    g, p = F.col(gold), F.col(pred)
    d = pairs.withColumn("_steps", align_words(g["steps"], p["steps"]))
    d = d.withColumn("_pre", align_words(g["preconditions"], p["preconditions"])).withColumn("_con", align_words(g["constraints"], p["constraints"]))
    n_gold, n_pred = F.size(g["steps"]), F.size(p["steps"])
    # a clause and a step may share an id: an edge's source is mapped as a clause, its target as a step
    # what is used more than once, or for each edge, is bound, as Spark would compute it anew in each place
    both = lambda clauses: F.struct(F.col(clauses).alias("a"), F.col("_steps").alias("b"))
    image = lambda edges, m: F.transform(edges, lambda e: F.struct(_image(m["a"], e["a"]).alias("a"), _image(m["b"], e["b"]).alias("b")))
    whole = lambda e: e["a"].isNotNull() & e["b"].isNotNull()
    gold_pre, pred_pre = _of_type(g["edges"], "precondition_of"), _of_type(p["edges"], "precondition_of")
    found = F.size(let(pred_pre, lambda known: let(both("_pre"), lambda m: F.filter(image(gold_pre, m), lambda e: whole(e) & F.array_contains(known, e)))))
    none = F.lit(1.0) if vacuous == "one" else F.lit(None).cast("double")
    gold_con, pred_con = F.array_distinct(_of_type(g["edges"], "constrains")), F.array_distinct(_of_type(p["edges"], "constrains"))

    def score(x: Column) -> Column:
        tp, fp = F.size(F.array_intersect(x["projected"], x["pred"])), F.size(F.array_except(x["pred"], x["projected"]))
        fn = F.size(F.array_except(x["projected"], x["pred"])) + F.size(x["gold"]) - F.size(x["projected"])
        return let(F.struct(tp.alias("tp"), fp.alias("fp"), fn.alias("fn")), lambda n: F.when(n["tp"] == 0, 0.0).otherwise(2 * n["tp"] / (2 * n["tp"] + n["fp"] + n["fn"])))

    f1 = let(F.struct(gold_con.alias("gold"), pred_con.alias("pred"), both("_con").alias("m")), lambda x: let(F.struct(F.filter(image(x["gold"], x["m"]), whole).alias("projected"), x["gold"].alias("gold"), x["pred"].alias("pred")), score))
    sources = F.transform(F.filter(p["edges"], lambda e: e["type"] == "constrains"), lambda e: e["from"])
    orphans = F.size(F.filter(p["constraints"], lambda c: ~F.array_contains(sources, c["id"])))
    return d.withColumns({
        "step_order_tau": tau(g["steps"], p["steps"], F.col("_steps")),
        "step_precision": F.when(n_pred == 0, 1.0).otherwise(F.size(F.array_distinct(F.transform("_steps", lambda m: m["p"]))) / n_pred),
        "step_count_fidelity": F.when((n_gold == 0) & (n_pred == 0), 1.0).otherwise(1 - F.abs(n_pred - n_gold) / F.greatest(n_pred, n_gold)),
        "precondition_recall": F.when(F.size(gold_pre) == 0, none).otherwise(found / F.size(gold_pre)),
        "constraint_f1": f1,
        "orphan_constraint_rate": F.when(F.size(p["constraints"]) == 0, 0.0).otherwise(orphans / F.size(p["constraints"])),
        "n_gold_steps": n_gold.cast("long"), "n_pred_steps": n_pred.cast("long"), "n_gold_constraints": F.size(g["constraints"]).cast("long"), "n_pred_constraints": F.size(p["constraints"]).cast("long"),
    }).drop("_steps", "_pre", "_con")


# The same measures over relations, for tables too large for one row a document.


def tau_by(steps: DataFrame, key: str, order: list[str], rank: Column) -> DataFrame:
    """(key, n, tau): concordant less discordant pairs of ``rank`` in the given order, by pairs of rows that share the key."""
    each = steps.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, rank.alias("_r")))).alias("s")).select(key, F.transform("s", lambda x: x["_r"]).alias("s"))
    pairs = lambda s: F.aggregate(F.sequence(F.lit(0), F.size(s) - 2), F.lit(0), lambda a, i: a + F.aggregate(F.slice(s, i + 2, F.size(s)), F.lit(0), lambda b, x: b + F.signum((x - F.get(s, i)).cast("double")).cast("int")))
    n = F.size("s")
    return each.select(key, n.cast("long").alias("n"), F.when(n < 2, 1.0).otherwise(let(F.col("s"), pairs) / (n * (n - 1) / 2)).alias("tau"))

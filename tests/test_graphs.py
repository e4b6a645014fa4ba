import math
import random

from pyspark.sql import functions as F

from stepweave.operators import extract, merge, metrics, stats
from stepweave.plans import experiment
from stepweave.sources import files, schemas


def g(steps=(), pre=(), con=(), edges=()):
    return {"steps": [{"id": i, "ordinal": n, "text": t, "page": None} for n, (i, t) in enumerate(steps, 1)], "preconditions": [{"id": i, "text": t} for i, t in pre], "constraints": [{"id": i, "text": t, "kind": "other"} for i, t in con], "edges": [{"type": t, "from": a, "to": b} for t, a, b in edges]}


def test_merge_duplicates_ties_windows_and_dangling_edges():
    same = "turn the main valve off now"
    m = merge.merge_graphs([g([("s1", same), ("s2", same)]), g([("s1", same)], edges=[("precedes", "s1", "nowhere"), ("precedes", "s1", "s1")])])
    assert [s["id"] for s in m["steps"]] == ["c0_s1", "c0_s2"] and m["duplicate_count"] == 1 and m["dropped_edge_count"] == 1  # none inside a chunk; the oldest of equals
    assert [(e["from"], e["to"]) for e in m["edges"]] == [("c0_s1", "c0_s2"), ("c0_s1", "c0_s1")]
    far = merge.merge_graphs([g([("s0", same), *((f"x{i}", f"words number{i} of kind{i}") for i in range(12))]), g([("s1", same)])])
    assert far["duplicate_count"] == 0  # the 13th last is out of reach
    c = merge.merge_graphs([g(con=[("c1", "wear blue gloves"), ("c2", "wear blue gloves")], pre=[("c1", "power is off")])])
    assert [x["id"] for x in c["constraints"]] == ["c0_c1"] and len(c["preconditions"]) == 1
    blank = merge.merge_graphs([{"steps": [{"text": "a"}], "edges": None}])
    assert blank["steps"][0]["id"] == "c0_s?" and merge.merge_graphs([])["steps"] == []


def measured(spark, gold, pred, **options):
    d = spark.createDataFrame([(gold, pred)], f"gold {schemas.GRAPH}, pred {schemas.GRAPH}")
    return metrics.measures(d, **options).first()


def test_measures(spark):
    texts = [f"alpha{i} beta{i} gamma{i}" for i in range(10)]
    gold = g([(f"s{i}", t) for i, t in enumerate(texts)])
    r = measured(spark, gold, g([(f"p{i}", t) for i, t in enumerate(texts[:5])]))
    assert abs(r.step_order_tau - 35 / 45) < 1e-9 and r.step_precision == 1 and r.step_count_fidelity == 0.5 and r.precondition_recall == 1 and r.constraint_f1 == 0 and r.orphan_constraint_rate == 0
    r = measured(spark, gold, g(), vacuous="null")
    assert r.step_order_tau == 0 and r.step_precision == 1 and r.precondition_recall is None
    assert measured(spark, g([("a", "x y")]), g()).step_order_tau == 1
    a = g([("s", "open valve one")], [("p", "power is off")], [("c", "wear gloves here"), ("d", "no fire around")], [("precondition_of", "p", "s"), ("precondition_of", "p", "s"), ("constrains", "c", "s"), ("constrains", "d", "s")])
    b = g([("1", "open valve one")], [("2", "power is off")], [("3", "wear gloves here"), ("4", "unrelated words only")], [("precondition_of", "2", "1"), ("constrains", "3", "1")])
    r = measured(spark, a, b)
    assert r.precondition_recall == 1 and abs(r.constraint_f1 - 2 / 3) < 1e-9 and r.orphan_constraint_rate == 0.5


def test_greedy_ties_go_by_ids_as_strings(spark):
    pairs = [(0.9, "s10", "x"), (0.9, "s2", "x"), (0.9, "s2", "y"), (0.7, "s10", "y"), (0.6, "s10", "z")]
    d = spark.createDataFrame([(pairs,)], f"p array<{metrics.PAIR}>")
    assert [tuple(m) for m in d.select(metrics.greedy(F.col("p"))).first()[0]] == [(0.9, "s2", "y"), (0.9, "s10", "x")]


def test_wilcoxon_matches_a_direct_count(spark):
    rnd = random.Random(2)
    rows = [(k, float(rnd.choice([-2, -1, 0, 0, 1, 3]))) for k in "ab" for _ in range(15)] + [("zero", 0.0), ("one", 0.5)]
    got = {r.k: r for r in stats.wilcoxon(spark.createDataFrame(rows, "k string, delta double"), ["k"]).collect()}
    assert (got["zero"].n, got["zero"].w, got["zero"].p) == (0, 0, 1) and (got["one"].n, got["one"].w) == (1, 0)
    for k in "ab":
        d = sorted((x for kk, x in rows if kk == k and x), key=abs)
        rank = {v: sum(i + 1 for i, x in enumerate(d) if abs(x) == v) / sum(abs(x) == v for x in d) for v in {abs(x) for x in d}}
        n, w = len(d), min(sum(rank[abs(x)] for x in d if x > 0), sum(rank[abs(x)] for x in d if x < 0))
        z = (w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
        assert got[k].n == n and got[k].w == w and abs(got[k].p - math.erfc(abs(z) / math.sqrt(2))) < 1e-12
    assert abs(spark.range(1).select(stats.sign_test(F.lit(8), F.lit(2))).first()[0] - 2 * (1 + 10 + 45) / 1024) < 1e-12


def test_sampling_providers_and_json(spark):
    d = spark.createDataFrame([("d", i, "text", ("pac",)) for i in range(30)] + [("e", 0, "Warning: hot\n\n1. Open it\n\nBefore use, check\n\n2. Close it", ("pac",))], "doc string, idx long, text string, meta struct<chunker:string>")
    got = extract.sample_chunks(d)
    assert sorted(r.idx for r in got.where("doc = 'd'").collect()) == sorted(random.Random(0).sample(range(30), 20)) and got.where("doc = 'e'").count() == 1
    r = extract.extract(d.where("doc = 'e'"), "rules").first()
    assert [(e.type, e["from"], e.to) for e in r.graph.edges] == [("constrains", "c1", "s1"), ("precedes", "s1", "s2"), ("precondition_of", "p1", "s2")] or [(e.type, e["from"], e.to) for e in r.graph.edges] == [("constrains", "c1", "s1"), ("precondition_of", "p1", "s2"), ("precedes", "s1", "s2")]

    def failing(text, idx, title):
        raise RuntimeError("no such model")

    assert extract.extract(d.limit(1), failing).first().error == "no such model"
    assert extract.lenient_json('x ```json\n{"a": 1}\n```') == {"a": 1} and extract.lenient_json('so {"a": {"b": 2}} there') == {"a": {"b": 2}} and extract.lenient_json('{"a": "}"} z') is None and extract.lenient_json(None) is None


def test_resume_and_files(spark, tmp_path):
    work = spark.createDataFrame([(i, i * i) for i in range(5)], "k long, v long")
    ran = []

    def run(d):
        ran.append(d.count())
        return d

    path = str(tmp_path / "out")
    files.resume(spark, work.where("k < 3"), path, ["k"], run)
    assert files.resume(spark, work, path, ["k"], run).count() == 5 and ran == [3, 2]
    (tmp_path / "m.csv").write_text('url,source,domain,title,page_count,estimated_steps,length_bucket,language,has_steps,has_safety_clauses,license,redistribute_ok,bytes,sha256\nu,osha,food,"a ""b"", c",3,4,short,en,True,False,x,yes,10,ab\n')
    r = files.manifest(spark, str(tmp_path / "m.csv")).first()
    assert r.title == 'a "b", c' and r.page_count == 3 and r.has_steps is True


def test_sign_test_of_many_pairs_does_not_overflow(spark):
    d = spark.createDataFrame([(2600, 2400), (0, 0), (4, 4), (0, 3)], "w long, l long")
    p = [r[0] for r in d.select(stats.sign_test(F.col("w"), F.col("l"))).collect()]
    assert abs(p[0] - 0.004894) < 1e-4 and p[1:3] == [1.0, 1.0] and abs(p[3] - 0.25) < 1e-12


def test_replies_of_every_kind_are_parsed(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "no json {"), (4, '{"steps": [{"id": "s1", "text": "a"}]}'), (5, '```json\n{"steps": 3}\n```'), (6, 'x {"steps": [{"id": "s1", "text": "b"}], "edges": []} y')], "i int, s string")
    found = {r.i: (len(r.g.steps), len(r.g.edges)) for r in d.select("i", extract.parsed(F.col("s")).alias("g")).collect()}
    assert found == {1: (0, 0), 2: (0, 0), 3: (0, 0), 4: (1, 0), 5: (0, 0), 6: (1, 0)}


def test_edges_of_steps_and_clauses_that_share_ids(spark):
    """A clause end is mapped among clauses, a step end among steps, though ids are the same."""
    graph = lambda steps, con, edges: (steps, [], con, edges)
    gold = graph([("x1", 1, "open the main valve", None), ("x2", 2, "close the drain now", None)], [("x1", "wear thick gloves always", "ppe")], [("constrains", "x1", "x2")])
    pred = graph([("y1", 1, "open the main valve", None), ("y2", 2, "close the drain now", None)], [("y2", "wear thick gloves always", "ppe")], [("constrains", "y2", "y2")])
    kind = f"struct<steps:{schemas.STEPS},preconditions:{schemas.PRECONDITIONS},constraints:{schemas.CONSTRAINTS},edges:{schemas.EDGES}>"
    (r,) = metrics.measures(spark.createDataFrame([(gold, pred)], f"gold {kind}, pred {kind}")).collect()
    assert r.constraint_f1 == 1.0 and r.orphan_constraint_rate == 0.0


def test_bootstrap_of_means(spark):
    rows = [(d, g, float((d * 7) % 10) + x) for d in range(200) for g, x in (("a", 0.0), ("b", 3.0))] + [(900, "a", None)]
    cells = spark.createDataFrame(rows, "doc long, chunker string, m double")
    got = {r.chunker: r for r in stats.bootstrap_ranks(cells, "m", rounds=400).collect()}
    again = {r.chunker: r for r in stats.bootstrap_ranks(cells.repartition(7), "m", rounds=400).collect()}
    for g, mean in (("a", 4.5), ("b", 7.5)):
        spread = 8.25**0.5 / 200**0.5  # of a mean of 200 values
        assert abs(got[g]["mean"] - mean) < 0.3 * spread and got[g].low < mean < got[g].high
        assert 0.8 < (got[g].high - got[g].low) / (2 * 1.96 * spread) < 1.2
        assert abs(got[g].low - again[g].low) < 1e-9 and abs(got[g].high - again[g].high) < 1e-9
    assert (got["a"].rank_1_share, got["b"].rank_1_share) == (0.0, 1.0)
    w = spark.range(20000).select(stats.poisson_weight(F.lit(1), F.col("id")).alias("w")).groupBy("w").count().collect()
    share = {r.w: r["count"] / 20000 for r in w}
    assert all(abs(share[k] - x) < 0.015 for k, x in enumerate((0.3679, 0.3679, 0.1839, 0.0613)))


def test_experiment_chunks_only_documents_that_are_scored(spark):
    steps = "1. Open the valve\n\nWarning: hot\n\n2. Close the valve"
    rows = [(1, steps), (2, "no step in here"), (3, None), (4, "a second row has the step"), (4, steps), (None, steps), (5, "\n\n".join(f"{i}. Turn wheel {'x' * 2000} {i}" for i in range(1, 40)))]
    docs = spark.createDataFrame(rows, "doc long, text string")
    chunks = spark.sparkContext.accumulator(0)

    def counted(text, idx, title):
        if idx >= 0 and "no step" in text:
            chunks.add(1)
        return extract.rules(text, idx, title)

    show = lambda d: sorted(str(r) for r in d.select(*sorted(d.columns)).collect())
    got = show(experiment.run(docs, counted))
    assert chunks.value == 0 and len(got) == 5 * 3
    assert got == show(experiment.evaluate(experiment.cells(docs, counted), experiment.gold(docs, counted))) and chunks.value > 0

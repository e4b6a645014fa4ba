import ast
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from stepweave import queries
from stepweave.operators import profile
from stepweave.sources import files
from stepweave.streaming import events

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM read_parquet('{t}')")
    return c


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([None if r[i] is None else round(float(r[i]), 5) if isinstance(r[i], float) or "Decimal" in type(r[i]).__name__ else r[i] for i in order] for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, con, name):
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.SQL[name])
    columns = [x[0] for x in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


def test_nothing_else_imports_the_training_data_operators():
    for f in (ROOT / "stepweave").rglob("*.py"):
        if "llm" not in f.parts:
            for node in ast.walk(ast.parse(f.read_text())):
                assert "llm" not in (getattr(node, "module", None) or "") and not any("llm" in a.name for a in getattr(node, "names", []) if hasattr(a, "name"))


def test_links_of_every_form(spark):
    html = '<a href="#x"><a class="c" href="mailto:a@b.c"><a href="https://other.org/p"><a href="/d/Doc.PDF#p2"><A HREF=\'sub/page\'><a href="//h.example/z?q=1">'
    d = spark.createDataFrame([(1, "https://h.example/a/b", html), (2, None, None)], "page_id long, url string, html string")
    assert sorted((r.link, r.kind) for r in profile.links(d).collect()) == [("https://h.example/a/sub/page", "html"), ("https://h.example/d/Doc.PDF", "pdf"), ("https://h.example/z?q=1", "html")]
    two = spark.createDataFrame([(1, "u1", "u2", "html"), (1, "u1", "x.pdf", "pdf"), (2, "u2", "y.pdf", "pdf")], "page_id long, url string, link string, kind string")
    assert sorted(tuple(r) for r in profile.two_hops(two).collect()) == [(1, "x.pdf", 1), (1, "y.pdf", 2), (2, "y.pdf", 1)]


def test_streams_give_the_batch_result(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    q = events.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.start, r.event_type): r.n for r in spark.table("counts").collect()}
    assert got == {(r.start, r.event_type): r.n for r in events.windowed_counts(e).collect()} and got


def test_profile_edges(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "Step 1\n2. Wash\n(3) Dry\na) end; first then next")], "doc long, text string")
    got = {r.doc: r for r in profile.profile(d).collect()}
    assert got[1].length_bucket == "unknown" and got[2].estimated_steps == 0 and (got[3].step_hits, got[3].has_steps) == (4, True)
    title = spark.range(1).select(profile.title_of(F.lit("https://x.org/a/lab_safety-guide.pdf?x=1"))).first()[0]
    assert title == "Lab Safety Guide"


def test_titles_capitalise_after_every_non_letter(spark):
    urls = ["https://x.org/a/o'neil_3rd-ed.v2.pdf#p", "https://x.org", "https://x.org/.hidden", None, "https://x.org/dir/"]
    d = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")
    assert {r.i: r.t for r in d.select("i", profile.title_of(F.col("url")).alias("t")).collect()} == {0: "O'Neil 3Rd Ed.V2", 1: "", 2: ".Hidden", 3: None, 4: "Dir"}


def test_locating_copies_gives_one_file_each(spark):
    wanted = spark.createDataFrame([("h", "a")] * 3 + [("h", "b"), ("none", "a")], "sha256 string, source string")
    there = spark.createDataFrame([("h", "/z/a/1"), ("h", "/y/c/2")], "sha256 string, path string")
    assert sorted(map(tuple, files.locate(wanted, there).collect())) == [("h", "a", "/z/a/1"), ("h", "b", "/y/c/2")]


def test_experiment_measures_run_every_chunker(spark, tmp_path):
    from stepweave.operators import chunkers

    text = "1. Open the valve before the pump starts.\n2. Check that the pressure is below 5 bar.\n3. Close the valve."
    spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["experiment_measures"](spark, str(tmp_path)).select("chunker").collect()
    assert sorted(r.chunker for r in got) == sorted(chunkers.CHUNKERS) and len(got) == 5


def test_bootstrap_rank_draws_2000_rounds(spark, monkeypatch):
    import inspect

    whole, asked = queries.stats.bootstrap_ranks, []
    monkeypatch.setattr(queries.stats, "bootstrap_ranks", lambda *a, **b: asked.append(inspect.signature(whole).bind(*a, **b)))
    queries.bootstrap_rank(spark, SF)
    asked[0].apply_defaults()
    assert asked[0].arguments["rounds"] == 2000

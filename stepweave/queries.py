"""Queries over the tables of a data folder, each with SQL for DuckDB where SQL can say it.

``orders`` and ``lineitem`` stand in for documents and steps: order key =
document, line number = gold order, ship date = predicted order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators import chunkers, extract, merge, metrics, profile, stats
from .plans import experiment
from .sources import files
from .streaming import events as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
LINE = "\n"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text", "source")


def _long(*names: str):
    return [F.col(n).cast("long").alias(n) for n in names]


_FIXED = """SELECT doc_id AS doc, source, s, substr(text, s + 1, 2048) AS x FROM (SELECT *, unnest(generate_series(0, length(text) - 1, 1792)) AS s FROM documents WHERE length(text) > 0)"""
_NOT_BLANK = r"regexp_matches(x, '[^\s]')"


@query(f"""SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY s) - 1 AS idx, s AS char_start, s + length(x) AS char_end, greatest(1, length(x) // 4) AS approx_tokens, md5(x) AS digest FROM ({_FIXED}) WHERE {_NOT_BLANK}""")
def chunk_fixed(spark, sf):
    c = chunkers.fixed(docs(spark, sf))
    return c.select(F.col("doc").cast("long"), "idx", "meta.char_start", "meta.char_end", "meta.approx_tokens", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"""SELECT source, count(*) AS n_chunks, round(avg(greatest(1, length(x) // 4)), 4) AS mean_tokens FROM ({_FIXED}) WHERE {_NOT_BLANK} GROUP BY source""")
def chunk_fixed_summary(spark, sf):
    c = chunkers.fixed(docs(spark, sf), doc_col="source")
    return c.groupBy(F.col("doc").alias("source")).agg(F.count("*").alias("n_chunks"), F.round(F.avg("meta.approx_tokens"), 4).alias("mean_tokens"))


def _chunks(name: str):
    def run(spark, sf):
        c = chunkers.get(name)(docs(spark, sf), **({"paragraph_sep": LINE} if name in ("layout_aware", "pac") else {}))
        return c.select("doc", "idx", F.length("text").cast("long").alias("n_chars"), "meta.approx_tokens", "start_block", "end_block", F.md5(F.col("text").cast("binary")).alias("digest"))

    run.__name__ = f"chunk_{name.split('_')[0]}"
    return run


for _n in ("recursive", "semantic", "pac"):
    query()(_chunks(_n))

query(r"""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i, x, greatest(1, length(x) // 4) AS c FROM (SELECT doc_id, pos, regexp_replace(x, '^\s+|\s+$', '', 'g') AS x FROM l) WHERE x <> ''),
f(doc_id, i, idx, used) AS (SELECT doc_id, i, 0::BIGINT, c FROM p WHERE i = 0
  UNION ALL SELECT p.doc_id, p.i, f.idx + CASE WHEN f.used + p.c > 512 THEN 1 ELSE 0 END, CASE WHEN f.used + p.c > 512 THEN p.c ELSE f.used + p.c END FROM f JOIN p ON p.doc_id = f.doc_id AND p.i = f.i + 1)
SELECT doc_id::VARCHAR AS doc, idx, length(body) AS n_chars, approx_tokens, start_block, end_block, md5(body) AS digest FROM (
  SELECT f.doc_id, f.idx, string_agg(x, chr(10) || chr(10) ORDER BY f.i) AS body, sum(c)::BIGINT AS approx_tokens, min(f.i)::INTEGER AS start_block, max(f.i)::INTEGER AS end_block FROM f JOIN p ON p.doc_id = f.doc_id AND p.i = f.i GROUP BY 1, 2)""")(_chunks("layout_aware"))

_SENT = r"regexp_replace(text, '([.!?])\s+([A-Z0-9(])', '\1' || chr(1) || '\2', 'g')"


@query(f"""SELECT doc_id AS doc, count(*) AS n, max(length(x)) AS longest, cast(sum(length(x)) AS BIGINT) AS chars FROM (SELECT doc_id, regexp_replace(unnest(string_split({_SENT}, chr(1))), '^\\s+|\\s+$', '', 'g') AS x FROM documents) WHERE x <> '' GROUP BY doc_id""")
def sentence_split(spark, sf):
    s = docs(spark, sf).select("doc", F.explode(T.sentences(F.col("text"))).alias("x"))
    return s.groupBy("doc").agg(F.count("*").alias("n"), F.max(F.length("x")).cast("long").alias("longest"), F.sum(F.length("x")).alias("chars"))


@query(r"""
WITH p AS (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') AS x FROM documents),
k AS (SELECT doc_id, CASE WHEN regexp_matches(x, '(?i)^\s*(section\s+\d+|chapter\s+\d+|appendix\s+[A-Z]|part\s+[IVX]+)') THEN 'HEADING'
  WHEN regexp_matches(x, '(?i)^\s*(step\s+\d+[.:]?\s*|\d+\.\s+[A-Z]|\d+\)\s+[A-Z]|\(\d+\)\s+[A-Z]|[A-Z]\.\s+[A-Z]|[A-Z]\)\s+[A-Z])') THEN 'STEP'
  WHEN regexp_matches(x, '(?i)^\s*(warning|caution|danger|note|important|ppe|personal protective equipment|lockout|tagout|loto|isolat\w+|hazard|wear\s+(gloves|goggles|respirator)|emergency\s+stop|e[-\s]*stop)[\s:.—\-]') THEN 'SAFETY'
  WHEN regexp_matches(x, '(?i)^\s*(before\s+\w+|prior\s+to\b|ensure\s+that\b|verify\s+that\b|confirm\s+that\b|if\s+.+,\s+(skip|do not|do)|only\s+(if|when|after)\b)') THEN 'PRECONDITION'
  WHEN length(x) <= 240 AND lower(regexp_extract(x, '^\s*([A-Za-z]+)', 1)) IN ('open','close','turn','press','hold','release','wait','check','verify','confirm','record','measure','set','remove','replace','install','connect','disconnect','wear','don','doff','isolate','lockout','tagout','drain','fill','rinse','clean','wipe','apply','begin','stop','start','shut','energize','deenergize') THEN 'STEP'
  ELSE 'BODY' END AS kind, length(x) AS n FROM p WHERE x <> '')
SELECT kind, count(*) AS n, cast(sum(n) AS BIGINT) AS chars FROM k GROUP BY kind""")
def paragraph_spans(spark, sf):
    s = docs(spark, sf).select(F.explode(chunkers.spans_of(F.col("text"), LINE)).alias("s")).where("s.text <> ''")
    return s.groupBy("s.kind").agg(F.count("*").alias("n"), F.sum(F.length("s.text")).alias("chars"))


# A document: 100 vectors in a row, each a sentence's.
_DIST = "SELECT vec_id // 100 AS doc, vec_id, 1 - list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), list_transform(lead(embedding) OVER (PARTITION BY vec_id // 100 ORDER BY vec_id), lambda x: x::DOUBLE)) AS d FROM embeddings"


def _distances(spark, sf):
    w = Window.partitionBy("doc").orderBy("vec_id")
    nxt = F.lead("embedding").over(w)
    return t(spark, sf, "embeddings").withColumn("doc", F.expr("vec_id div 100")).withColumn("nxt", nxt).select("doc", "vec_id", (1 - metrics.dot(F.col("embedding"), F.col("nxt"))).alias("d"))


@query(f"""WITH e AS ({_DIST}), q AS (SELECT doc, quantile_cont(d, 0.95) AS th FROM e WHERE d IS NOT NULL GROUP BY doc) SELECT e.doc, vec_id, round(d, 6) AS d, round(th, 6) AS th FROM e JOIN q USING (doc) WHERE d >= th""")
def semantic_breakpoints(spark, sf):
    d = _distances(spark, sf).where("d is not null")
    th = d.groupBy("doc").agg(F.percentile("d", F.lit(0.95)).alias("th"))
    return d.join(th, "doc").where("d >= th").select("doc", "vec_id", F.round("d", 6).alias("d"), F.round("th", 6).alias("th"))


@query(f"""WITH e AS ({_DIST}), q AS (SELECT doc, quantile_cont(d, 0.95) AS th FROM e WHERE d IS NOT NULL GROUP BY doc),
c AS (SELECT e.doc, vec_id, CASE WHEN d >= th THEN 1 ELSE 0 END AS cut FROM e JOIN q USING (doc)),
i AS (SELECT doc, vec_id, coalesce(sum(cut) OVER (PARTITION BY doc ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM c)
SELECT doc, cast(island AS BIGINT) AS island, count(*) AS n, min(vec_id) AS first, max(vec_id) AS last FROM i GROUP BY doc, island""")
def semantic_islands(spark, sf):
    d = _distances(spark, sf)
    th = d.groupBy("doc").agg(F.percentile("d", F.lit(0.95)).alias("th"))
    before = Window.partitionBy("doc").orderBy("vec_id").rowsBetween(Window.unboundedPreceding, -1)
    i = d.join(th, "doc").withColumn("island", F.coalesce(F.sum(F.when(F.col("d") >= F.col("th"), 1).otherwise(0)).over(before), F.lit(0)))
    return i.groupBy("doc", F.col("island").cast("long").alias("island")).agg(F.count("*").alias("n"), F.min("vec_id").alias("first"), F.max("vec_id").alias("last"))


_SIM = "list_dot_product(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE))"


@query(f"""WITH RECURSIVE s AS (SELECT a.vec_id // 20 AS doc, a.vec_id::VARCHAR AS g, b.vec_id::VARCHAR AS p, {_SIM} AS sim FROM embeddings a JOIN embeddings b ON a.vec_id // 20 = b.vec_id // 20 AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY sim DESC, g DESC, p DESC) AS r FROM s WHERE sim >= 0.05),
a(doc, r, g, p, sim, ok, used) AS (SELECT doc, r, g, p, sim, TRUE, [g, p] FROM o WHERE r = 1
  UNION ALL SELECT o.doc, o.r, o.g, o.p, o.sim, NOT list_has_any(used, [o.g, o.p]), CASE WHEN list_has_any(used, [o.g, o.p]) THEN used ELSE list_concat(used, [o.g, o.p]) END FROM a JOIN o ON o.doc = a.doc AND o.r = a.r + 1)
SELECT doc, g, p, round(sim, 5) AS sim FROM a WHERE ok""")
def cosine_align(spark, sf):
    """One-to-one matches in documents of 20 consecutive vectors: the even ids are gold nodes, the odd ones predicted."""
    node = F.struct(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vec"))
    of = lambda side: F.collect_list(F.when(F.col("vec_id") % 2 == side, node))
    pairs = t(spark, sf, "embeddings").groupBy(F.expr("vec_id div 20").alias("doc")).agg(of(0).alias("gold"), of(1).alias("pred"))
    m = pairs.select("doc", F.explode(metrics.align_vectors(F.col("gold"), F.col("pred"), 0.05)).alias("m"))
    return m.select("doc", "m.g", "m.p", F.round("m.sim", 5).alias("sim"))


_FLOW = r"len(regexp_extract_all(text, '(?i)\b(first|then|next|finally|afterwards|prior to|before|after)\b'))"
_STEPS = r"len(regexp_extract_all(text, '(?im)^\s*(step\s+\d+|\d+\.\s+\w|\(\d+\)\s*\w|[a-z]\)\s*\w)'))"
_SAFE = r"len(regexp_extract_all(text, '(?i)\b(ppe|personal protective equipment|lockout|tagout|lock\s*out|tag\s*out|loto|hazard|warning|caution|danger|spill|isolation|emergency stop|e[-\s]*stop|ventilation|respirator|goggles|gloves|fume hood|hazmat|msds|sds|safety data sheet)\b'))"
_PROFILE = f"SELECT doc_id AS doc, source, text, {_STEPS} AS step_hits, {_FLOW} AS flow_hits, {_SAFE} AS safety_hits FROM documents"
_EST = "CASE WHEN step_hits > 0 THEN step_hits ELSE flow_hits // 2 END"
_BUCKET = f"CASE WHEN coalesce(text, '') = '' THEN 'unknown' WHEN {_EST} < 20 THEN 'short' WHEN {_EST} <= 40 THEN 'medium' ELSE 'long' END"


@query(f"SELECT doc, step_hits, flow_hits, safety_hits, {_EST} AS estimated_steps, {_EST} >= 3 AS has_steps, safety_hits >= 1 AS has_safety_clauses, {_BUCKET} AS length_bucket FROM ({_PROFILE})")
def doc_profile(spark, sf):
    return profile.profile(docs(spark, sf)).drop("text", "source")


@query(f"SELECT source, {_BUCKET} AS length_bucket, count(*) AS n FROM ({_PROFILE}) GROUP BY ALL")
def length_bucket_counts(spark, sf):
    return profile.profile(docs(spark, sf)).groupBy("source", "length_bucket").agg(F.count("*").alias("n"))


@query(f"SELECT source, cast(sum(safety_hits) AS BIGINT) AS hits, count(*) FILTER (safety_hits > 0) AS n FROM ({_PROFILE}) GROUP BY source")
def safety_terms_by_source(spark, sf):
    return docs(spark, sf).withColumn("h", profile.safety_terms(F.col("text"))).groupBy("source").agg(F.sum("h").alias("hits"), F.count_if(F.col("h") > 0).alias("n"))


@query("SELECT CASE " + " ".join(f"WHEN regexp_matches(b, '{w}') THEN '{n}'" for n, w in profile.DOMAINS.items()) + " ELSE 'general' END AS domain, count(*) AS n FROM (SELECT lower(source || ' ' || '' || ' ' || text) AS b FROM documents) GROUP BY 1")
def domain_counts(spark, sf):
    return docs(spark, sf).select(profile.domain(F.col("source"), F.lit(""), F.col("text")).alias("domain")).groupBy("domain").agg(F.count("*").alias("n"))


_LINKS = r"""SELECT DISTINCT page_id, link, CASE WHEN ends_with(lower(regexp_extract(link, '^[^?#]*')), '.pdf') THEN 'pdf' ELSE 'html' END AS kind FROM (
SELECT page_id, base, regexp_replace(CASE WHEN regexp_matches(href, '^[a-zA-Z]+://') THEN href WHEN starts_with(href, '//') THEN regexp_extract(base, '^([a-zA-Z]+:)', 1) || href WHEN starts_with(href, '/') THEN base || href
  ELSE regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '([^/:])/[^/]*$', '\1/') || href END, '#.*$', '') AS link
FROM (SELECT page_id, url, regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) AS base, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1)) AS href FROM pages)
WHERE href <> '' AND NOT regexp_matches(lower(href), '^(#|mailto:|tel:|javascript:)')) WHERE lower(regexp_extract(link, '^[a-zA-Z]+://([^/?#]*)', 1)) = lower(regexp_extract(base, '^[a-zA-Z]+://([^/?#]*)', 1))"""


@query(_LINKS)
def page_links(spark, sf):
    return profile.links(t(spark, sf, "pages"))


@query(f"SELECT lower(regexp_extract(link, '^[a-zA-Z]+://([^/?#]*)', 1)) AS host, count(*) AS n_links, count(DISTINCT page_id) AS n_pages FROM ({_LINKS}) GROUP BY 1")
def page_link_hosts(spark, sf):
    return profile.links(t(spark, sf, "pages")).groupBy(F.lower(F.regexp_extract("link", "^[a-zA-Z]+://([^/?#]*)", 1)).alias("host")).agg(F.count("*").alias("n_links"), F.count_distinct("page_id").alias("n_pages"))


_HOST = "regexp_extract({}, '^[a-zA-Z]+://[^/?#]*')"


@query(f"""WITH l AS (SELECT DISTINCT x.page_id, {_HOST.format("p.url")} AS url, CASE WHEN regexp_matches(link, '[aeiou]$') THEN 'pdf' ELSE 'html' END AS kind, CASE WHEN regexp_matches(link, '[aeiou]$') THEN link ELSE {_HOST.format("link")} END AS link FROM ({_LINKS}) x JOIN pages p USING (page_id)),
h AS (SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY link) AS r FROM l WHERE kind = 'html')
SELECT page_id, link, min(hop) AS hop FROM (SELECT page_id, link, 1 AS hop FROM l WHERE kind = 'pdf' UNION ALL SELECT h.page_id, l.link, 2 FROM h JOIN l ON h.link = l.url WHERE l.kind = 'pdf' AND r <= 30) GROUP BY ALL""")
def two_hop(spark, sf):
    """The tables link neither to PDF nor to each other: links that end in a vowel stand in for PDF, and a host for its pages."""
    p = t(spark, sf, "pages")
    host = lambda c: F.regexp_extract(c, "^[a-zA-Z]+://[^/?#]*", 0)
    paper = F.col("link").rlike("[aeiou]$")
    found = profile.links(p).join(p.select("page_id", "url"), "page_id")
    return profile.two_hops(found.select("page_id", host("url").alias("url"), F.when(paper, F.col("link")).otherwise(host("link")).alias("link"), F.when(paper, "pdf").otherwise("html").alias("kind")).distinct())


@query(r"""SELECT item_id, len(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS n_words, greatest(1, length(text) // 4) AS approx_tokens FROM benchmark""")
def word_bag_stats(spark, sf):
    return t(spark, sf, "benchmark").select("item_id", F.size(T.word_bag(F.col("text"))).cast("long").alias("n_words"), T.token_estimate(F.col("text")).alias("approx_tokens"))


@query(r"""WITH b AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM conversations),
j AS (SELECT x.conv_id, x.turn AS g, y.turn AS p, len(list_intersect(x.w, y.w)) AS i, len(x.w) + len(y.w) AS s, len(x.w) * len(y.w) AS m FROM b x JOIN b y ON x.conv_id = y.conv_id AND x.turn < y.turn)
SELECT conv_id, g, p, round(i / (s - i), 6) AS sim FROM j WHERE m > 0 AND i / (s - i) >= 0.08""")
def jaccard_pairs(spark, sf):
    """Pairs of turns of one conversation."""
    b = t(spark, sf, "conversations").select("conv_id", "turn", T.word_bag(F.col("text")).alias("w"))
    x, y = b.select("conv_id", F.col("turn").alias("g"), F.col("w").alias("a")), b.select("conv_id", F.col("turn").alias("p"), F.col("w").alias("b"))
    j = x.join(y, "conv_id").where("g < p").withColumn("sim", T.jaccard(F.col("a"), F.col("b"))).where("sim >= 0.08")
    return j.select("conv_id", "g", "p", F.round("sim", 6).alias("sim"))


_RANKED = "SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate) AS o, l_shipdate AS r FROM lineitem"


@query(f"""WITH s AS ({_RANKED}), p AS (SELECT a.k, sum(sign(epoch_us(b.r) - epoch_us(a.r))) AS c FROM s a JOIN s b ON a.k = b.k AND (a.o < b.o) GROUP BY a.k), n AS (SELECT k, count(*) AS n FROM s GROUP BY k)
SELECT n.k AS l_orderkey, n, CASE WHEN n < 2 THEN 1.0 ELSE round(c / (n * (n - 1) / 2), 6) END AS tau FROM n LEFT JOIN p USING (k)""")
def step_order_tau(spark, sf):
    d = metrics.tau_by(t(spark, sf, "lineitem"), "l_orderkey", ["l_linenumber"], F.unix_micros(F.col("l_shipdate").cast("timestamp")))
    return d.withColumn("tau", F.round("tau", 6))


@query(f"""WITH s AS ({_RANKED}), p AS (SELECT a.k, sum(sign(epoch_us(b.r) - epoch_us(a.r))) AS c FROM s a JOIN s b ON a.k = b.k AND (a.o < b.o) GROUP BY a.k), n AS (SELECT k, count(*) AS n FROM s GROUP BY k)
SELECT o_orderpriority, count(*) AS n, round(avg(CASE WHEN n < 2 THEN 1.0 ELSE c / (n * (n - 1) / 2) END), 5) AS mean_tau FROM n LEFT JOIN p USING (k) JOIN orders ON o_orderkey = n.k GROUP BY 1""")
def tau_by_priority(spark, sf):
    d = metrics.tau_by(t(spark, sf, "lineitem"), "l_orderkey", ["l_linenumber"], F.unix_micros(F.col("l_shipdate").cast("timestamp")))
    return d.join(t(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg("tau"), 5).alias("mean_tau"))


def _line_graphs(spark, sf):
    """Each order as a gold and a predicted graph (``gold``, ``pred``).

    Lines of more than 10 are gold steps, lines of less than 40 predicted ones,
    by ship date.  Each step has a precondition and a constraint with an edge to
    it; predicted constraints of returned lines lack theirs.
    """
    q = F.col("l_quantity")
    lines = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("n"))
    lines = lines.agg(F.max("l_shipdate").alias("ship"), F.max(q > 10).alias("g"), F.max(q < 40).alias("p"), F.max(F.col("l_returnflag") == "R").alias("r"))
    rows = lines.groupBy("doc").agg(F.collect_list(F.struct("n", "ship", "g", "p", "r")).alias("x"))
    gold = F.sort_array(F.filter("x", lambda x: x["g"]))
    pred = F.sort_array(F.transform(F.filter("x", lambda x: x["p"]), lambda x: F.struct(x["ship"].alias("ship"), x["n"].alias("n"), x["r"].alias("r"))))

    def graph(of, tied):
        name = lambda kind, x: F.concat(F.lit(kind), x["n"].cast("string"))
        nodes = lambda kind, word: F.transform(of, lambda x: F.struct(name(kind, x).alias("id"), x["n"].cast("int").alias("ordinal"), name(word, x).alias("text")))
        edge = lambda kind, source: lambda x: F.struct(F.lit(kind).alias("type"), name(source, x).alias("from"), name("s", x).alias("to"))
        edges = F.concat(F.transform(of, edge("precondition_of", "b")), F.transform(F.filter(of, tied), edge("constrains", "c")))
        return F.struct(nodes("s", "do step ").alias("steps"), nodes("b", "have ").alias("preconditions"), nodes("c", "keep limit ").alias("constraints"), edges.alias("edges"))

    return rows.select("doc", graph(gold, lambda x: F.lit(True)).alias("gold"), graph(pred, lambda x: ~x["r"]).alias("pred"))


_MEASURES = """WITH l AS (SELECT l_orderkey AS doc, l_linenumber AS n, max(l_shipdate) AS ship, bool_or(l_quantity > 10) AS g, bool_or(l_quantity < 40) AS p, bool_or(l_returnflag = 'R') AS r FROM lineitem GROUP BY 1, 2),
o AS (SELECT *, CASE WHEN p THEN row_number() OVER (PARTITION BY doc, p ORDER BY ship, n) - 1 ELSE count(*) FILTER (p) OVER (PARTITION BY doc) END AS pos FROM l),
turns AS (SELECT a.doc, sum(sign(b.pos - a.pos)) AS s FROM o a JOIN o b ON a.doc = b.doc AND a.n < b.n AND a.g AND b.g GROUP BY 1),
c AS (SELECT doc, count(*) FILTER (g) AS gold, count(*) FILTER (p) AS pred, count(*) FILTER (g AND p) AS hit, count(*) FILTER (p AND r) AS orphans, count(*) FILTER (g AND p AND NOT r) AS tp, count(*) FILTER (p AND NOT r AND NOT g) AS fp FROM l GROUP BY 1),
m AS (SELECT c.doc, gold, pred, CASE WHEN gold < 2 THEN 1.0 ELSE s / (gold * (gold - 1) / 2) END AS step_order_tau, CASE WHEN pred = 0 THEN 1.0 ELSE hit / pred END AS step_precision,
  CASE WHEN gold + pred = 0 THEN 1.0 ELSE 1 - abs(pred - gold) / greatest(pred, gold) END AS step_count_fidelity, CASE WHEN gold = 0 THEN 1.0 ELSE hit / gold END AS precondition_recall,
  CASE WHEN tp = 0 THEN 0.0 ELSE 2 * tp / (tp + fp + gold) END AS constraint_f1, CASE WHEN pred = 0 THEN 0.0 ELSE orphans / pred END AS orphan_constraint_rate FROM c LEFT JOIN turns ON c.doc = turns.doc)
"""


def _measured(spark, sf):
    return metrics.measures(_line_graphs(spark, sf))


@query(f"{_MEASURES} SELECT doc, round(step_order_tau, 6) AS step_order_tau, round(step_precision, 6) AS step_precision, round(step_count_fidelity, 6) AS step_count_fidelity, round(precondition_recall, 6) AS precondition_recall, round(constraint_f1, 6) AS constraint_f1, round(orphan_constraint_rate, 6) AS orphan_constraint_rate FROM m")
def graph_measures(spark, sf):
    return _measured(spark, sf).select("doc", *(F.round(m, 6).alias(m) for m in metrics.MEASURES))


@query(f"{_MEASURES} SELECT doc AS l_orderkey, pred AS n_pred, gold AS n_gold, round(step_count_fidelity, 6) AS fidelity, round(step_precision, 6) AS step_precision FROM m")
def step_count_fidelity(spark, sf):
    return _measured(spark, sf).select(F.col("doc").alias("l_orderkey"), F.col("n_pred_steps").alias("n_pred"), F.col("n_gold_steps").alias("n_gold"), F.round("step_count_fidelity", 6).alias("fidelity"), F.round("step_precision", 6).alias("step_precision"))


@query(f"{_MEASURES} SELECT o_orderpriority, count(*) AS n, round(avg(orphan_constraint_rate), 5) AS orphan_rate FROM m JOIN orders ON o_orderkey = doc GROUP BY 1")
def orphan_rate(spark, sf):
    j = _measured(spark, sf).select("doc", "orphan_constraint_rate").join(t(spark, sf, "orders"), F.col("doc") == F.col("o_orderkey"))
    return j.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg("orphan_constraint_rate"), 5).alias("orphan_rate"))


@query(f"{_MEASURES} SELECT doc AS l_orderkey, gold AS n_gold, pred AS n_pred, round(constraint_f1, 6) AS f1 FROM m")
def constraint_f1(spark, sf):
    return _measured(spark, sf).select(F.col("doc").alias("l_orderkey"), F.col("n_gold_constraints").alias("n_gold"), F.col("n_pred_constraints").alias("n_pred"), F.round("constraint_f1", 6).alias("f1"))


@query(f"{_MEASURES} SELECT doc AS o_orderkey, gold AS n_gold, CASE WHEN gold > 0 THEN round(precondition_recall, 6) END AS recall FROM m")
def precondition_recall(spark, sf):
    """Null where there is none to recall."""
    m = metrics.measures(_line_graphs(spark, sf), vacuous="null")
    return m.select(F.col("doc").alias("o_orderkey"), F.col("n_gold_steps").alias("n_gold"), F.round("precondition_recall", 6).alias("recall"))


def _order_cells(spark, sf, step: str, edges):
    """Each order as a cell of one graph, whose steps are the distinct values of ``step``."""
    steps = F.transform(F.sort_array(F.collect_set(F.expr(step).cast("long"))), lambda x, i: F.struct(x.cast("string").alias("id"), (i + 1).alias("ordinal"), F.concat(F.lit("line "), x.cast("string")).alias("text"), F.lit(None).cast("int").alias("page")))
    g = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("doc")).agg(steps.alias("steps"), edges.cast(merge.schemas.EDGES).alias("edges"))
    none = [F.array().cast(k).alias(n) for n, k in (("preconditions", merge.schemas.PRECONDITIONS), ("constraints", merge.schemas.CONSTRAINTS))]
    graph = merge.normalise(F.struct("steps", *none, "edges"))
    return merge.gather(g.select("doc", F.lit("order").alias("chunker"), F.lit(0).alias("chunk_idx"), graph.alias("graph")))


@query("SELECT doc, n AS source, target FROM (SELECT doc, n, lead(n) OVER (PARTITION BY doc ORDER BY n) AS target FROM (SELECT DISTINCT l_orderkey AS doc, l_linenumber::BIGINT AS n FROM lineitem)) WHERE target IS NOT NULL")
def precedes_edges(spark, sf):
    """The order that merging puts the steps of a cell in."""
    m = merge.merge_cells(_order_cells(spark, sf, "l_linenumber", F.array()))
    line = lambda end: F.regexp_extract(F.col(f"e.{end}"), "^c0_(.+)$", 1).cast("long")
    return m.select(F.col("doc").cast("long").alias("doc"), F.explode("edges").alias("e")).where("e.type = 'precedes'").select("doc", line("from").alias("source"), line("to").alias("target"))


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS doc, l_partkey % 50 AS a, l_suppkey % 50 AS b FROM lineitem), known AS (SELECT DISTINCT l_orderkey AS doc, l_partkey % 50 AS id FROM lineitem)
SELECT count(*) AS n_kept, (SELECT count(*) FROM e) - count(*) AS n_dropped FROM e WHERE EXISTS (SELECT 1 FROM known WHERE known.doc = e.doc AND id = a) AND EXISTS (SELECT 1 FROM known WHERE known.doc = e.doc AND id = b)""")
def edge_remap(spark, sf):
    """Edges whose ends a merged cell holds, and those dropped."""
    edge = F.struct(F.lit("constrains").alias("type"), F.expr("l_partkey % 50").cast("string").alias("from"), F.expr("l_suppkey % 50").cast("string").alias("to"))
    m = merge.merge_cells(_order_cells(spark, sf, "l_partkey % 50", F.collect_set(edge)))
    kept = F.size(F.filter("edges", lambda e: e["type"] == "constrains"))
    return m.agg(F.sum(kept).alias("n_kept"), F.sum("dropped_edge_count").cast("long").alias("n_dropped"))


def _orders(spark, sf):
    return t(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderpriority").alias("chunker"), F.col("o_orderstatus").alias("stratum"), F.col("o_totalprice").alias("m"))


@query("SELECT o_orderpriority AS chunker, count(*) AS n_cells, round(avg(o_totalprice), 4) AS m_mean, round(median(o_totalprice), 4) AS m_median FROM orders GROUP BY 1")
def group_mean_median(spark, sf):
    return stats.summary(_orders(spark, sf), measures=("m",))


@query("SELECT o_orderpriority AS chunker, o_orderstatus AS stratum, count(*) AS n, round(avg(o_totalprice), 4) AS m FROM orders GROUP BY GROUPING SETS ((o_orderpriority, o_orderstatus), (o_orderpriority))")
def stratum_rollup(spark, sf):
    return stats.strata(_orders(spark, sf), "stratum", "chunker", ("m",)).withColumn("m", F.round("m", 4))


@query("""WITH c AS (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = (SELECT count(DISTINCT o_orderstatus) FROM orders))
SELECT 'm' AS metric, o_orderstatus AS extractor, round(avg(o_totalprice) FILTER (o_orderpriority = '1-URGENT'), 4) AS urgent, round(avg(o_totalprice) FILTER (o_orderpriority = '5-LOW'), 4) AS low FROM orders WHERE o_custkey IN (SELECT o_custkey FROM c) GROUP BY 2""")
def extractor_pivot(spark, sf):
    p = stats.cross_extractor(_orders(spark, sf).withColumnRenamed("stratum", "extractor"), measures=("m",), groups=["1-URGENT", "5-LOW"])
    return p.select("metric", "extractor", F.round("1-URGENT", 4).alias("urgent"), F.round("5-LOW", 4).alias("low"))


_CELLS = "SELECT o_custkey AS doc, o_orderpriority AS chunker, round(avg(o_totalprice), 2) AS m FROM orders GROUP BY 1, 2"
_DELTAS = f"SELECT b.doc, b.chunker AS baseline, p.m - b.m AS delta FROM ({_CELLS}) b JOIN ({_CELLS}) p ON b.doc = p.doc WHERE p.chunker = '1-URGENT' AND b.chunker <> '1-URGENT'"


def _deltas(spark, sf):
    c = _orders(spark, sf).groupBy("doc", "chunker").agg(F.round(F.avg("m"), 2).alias("m"))
    return stats.paired(c, "1-URGENT", measures=("m",)).drop("metric")


@query(f"SELECT baseline, count(*) AS n_paired, count(*) FILTER (delta > 0) AS wins, count(*) FILTER (delta = 0) AS ties, count(*) FILTER (delta < 0) AS losses, round(avg(delta), 2) AS mean_delta FROM ({_DELTAS}) GROUP BY 1")
def paired_win_tie_loss(spark, sf):
    return stats.wins(_deltas(spark, sf), ["baseline"]).withColumn("mean_delta", F.round("mean_delta", 2))


@query(f"""WITH r AS (SELECT baseline, delta, rank() OVER (PARTITION BY baseline ORDER BY abs(delta)) + (count(*) OVER (PARTITION BY baseline, abs(delta)) - 1) / 2.0 AS r FROM ({_DELTAS}) WHERE delta <> 0),
s AS (SELECT baseline, count(*) AS n, least(sum(CASE WHEN delta > 0 THEN r ELSE 0 END), sum(CASE WHEN delta < 0 THEN r ELSE 0 END))::DOUBLE AS w FROM r GROUP BY 1)
SELECT baseline, n, w, round((w - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0), 6) AS z FROM s""")
def wilcoxon_w(spark, sf):
    return stats.wilcoxon_w(_deltas(spark, sf), ["baseline"]).withColumn("z", F.round("z", 6))


def _erfc_sql(x: str) -> str:
    """erfc of a positive x by its power series."""
    return f"1 - 2 / sqrt(pi()) * list_sum(list_transform(generate_series(0, 200), lambda k: (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * k + 1) * ln({x}) - lgamma(k + 1.0)) / (2 * k + 1)))"


_WILCOXON = f"""WITH r AS (SELECT baseline, delta, rank() OVER (PARTITION BY baseline ORDER BY abs(delta)) + (count(*) OVER (PARTITION BY baseline, abs(delta)) - 1) / 2.0 AS r FROM ({_DELTAS}) WHERE delta <> 0),
s AS (SELECT baseline, count(*) AS n, least(sum(CASE WHEN delta > 0 THEN r ELSE 0 END), sum(CASE WHEN delta < 0 THEN r ELSE 0 END))::DOUBLE AS w FROM r GROUP BY 1),
z AS (SELECT baseline, n, w, (w - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0) AS z FROM s)
SELECT baseline, n, w, z, {_erfc_sql("greatest(abs(z), 1e-12) / sqrt(2)")} AS p FROM z"""


@query(f"SELECT baseline, n, w, round(z, 6) AS z, round(p, 6) AS p FROM ({_WILCOXON})")
def wilcoxon_p(spark, sf):
    return stats.wilcoxon(_deltas(spark, sf), ["baseline"]).withColumns({"z": F.round("z", 6), "p": F.round("p", 6)})


_WINS = f"SELECT baseline, count(*) AS n_paired, avg(delta) AS mean_delta, count(*) FILTER (delta > 0) AS wins, count(*) FILTER (delta = 0) AS ties, count(*) FILTER (delta < 0) AS losses FROM ({_DELTAS}) GROUP BY 1"


@query(f"SELECT baseline, 'm' AS metric, printf('%-14s %-24s %+8.4f  %d/%d/%d  p=%.4f %s', baseline, 'm', round(mean_delta, 2), wins, ties, losses, p, CASE WHEN p < 0.05 THEN '*' ELSE ' ' END) AS line FROM ({_WINS}) JOIN ({_WILCOXON}) USING (baseline)")
def headline_lines(spark, sf):
    c = _orders(spark, sf).groupBy("doc", "chunker").agg(F.round(F.avg("m"), 2).alias("m"))
    return stats.headline(stats.comparison(c, "1-URGENT", measures=("m",)).withColumn("mean_delta", F.round("mean_delta", 2)))


@query(f"""SELECT baseline, wins, losses, round(least(1.0, 2 * list_sum(list_transform(generate_series(0, least(wins, losses)), lambda i: exp(lgamma(wins + losses + 1.0) - lgamma(i + 1.0) - lgamma(wins + losses - i + 1.0) - (wins + losses) * ln(2))))), 6) AS p FROM ({_WINS})""")
def sign_test_p(spark, sf):
    return stats.wins(_deltas(spark, sf), ["baseline"]).select("baseline", "wins", "losses", F.round(stats.sign_test(F.col("wins"), F.col("losses")), 6).alias("p"))


_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("WITH c AS (SELECT o_custkey AS doc, count(DISTINCT o_orderdate) AS whole, count(DISTINCT o_orderstatus) AS thorough, " + ", ".join(f"count(*) FILTER (o_orderpriority = '{p}') AS c{i}" for i, p in enumerate(_PRIORITIES)) + " FROM orders GROUP BY 1) SELECT *, round((" + " + ".join(f"c{i}" for i in range(5)) + ") / 5 / whole, 6) AS ratio FROM c")
def idempotency_table(spark, sf):
    """Counts of the chunkers (here: priorities) beside those of the whole document (here: customer)."""
    o = t(spark, sf, "orders")
    whole = o.groupBy(F.col("o_custkey").alias("doc")).agg(F.count_distinct("o_orderdate").alias("whole"), F.count_distinct("o_orderstatus").alias("thorough"))
    each = o.groupBy(F.col("o_custkey").alias("doc"), F.col("o_orderpriority").alias("chunker")).agg(F.count("*").alias("n_steps"))
    wide = stats.idempotency(each.join(whole, "doc"), list(_PRIORITIES))
    return wide.select("doc", "whole", "thorough", *(F.coalesce(F.col(f"`{p}`"), F.lit(0)).alias(f"c{i}") for i, p in enumerate(_PRIORITIES)), F.round("ratio", 6).alias("ratio"))


@query()
def bootstrap_rank(spark, sf):
    c = _orders(spark, sf).groupBy("doc", "chunker").agg(F.avg("m").alias("m"))
    whole = c.groupBy("doc").agg(F.count("*").alias("n")).where("n = 5").select("doc")
    return stats.bootstrap_ranks(c.join(whole, "doc", "left_semi"), "m")


@query("""SELECT event_id, user_id, coalesce(last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS page,
coalesce(first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), -1) AS following FROM events""")
def page_tag_asof(spark, sf):
    """The last mark at or before a row, and the next one behind it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    mark = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return t(spark, sf, "events").select("event_id", "user_id", F.coalesce(F.last(mark, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(-1)).alias("page"), F.coalesce(F.first(mark, True).over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(-1)).alias("following"))


@query("SELECT sha256(text) AS sha256, min(doc_id) AS doc FROM documents GROUP BY 1")
def hash_dedup(spark, sf):
    return profile.first_by_hash(docs(spark, sf), "text", ["doc"]).select("sha256", "doc")


@query("SELECT doc_id AS doc, length(text) AS n_chars, length(text) > 400000 AS truncated, md5(substr(text, 1, 400000)) AS digest FROM documents")
def truncating_scan(spark, sf):
    return files.truncated(docs(spark, sf)).select("doc", "n_chars", "truncated", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT conv_id, turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn = c.turn AND d.role = 'assistant')")
def resume_pending(spark, sf):
    c = t(spark, sf, "conversations")
    return files.pending(c.select("conv_id", "turn"), c.where("role = 'assistant'"), ["conv_id", "turn"])


@query("SELECT conv_id, count(*) AS n_turns, count(DISTINCT regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g')) AS n_distinct FROM conversations GROUP BY 1")
def turn_merge(spark, sf):
    return t(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.count_distinct(T.strip(F.lower("text"))).alias("n_distinct"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_events(spark, sf):
    return streaming.windowed_counts(t(spark, sf, "events")).withColumn("total", F.round("total", 4))


@query()
def chunk_sampling(spark, sf):
    c = extract.sample_chunks(chunkers.fixed(docs(spark, sf)))
    return c.select("doc", "idx")


def _turn_graphs(spark, sf):
    """Each turn as a graph of one step: a cell is a conversation."""
    step = F.struct(F.lit("s1").alias("id"), F.lit(1).alias("ordinal"), F.col("text"), F.lit(None).cast("int").alias("page"))
    g = merge.normalise(F.struct(F.array(step).alias("steps"), *(F.lit(None).cast(k).alias(n) for n, k in (("preconditions", merge.schemas.PRECONDITIONS), ("constraints", merge.schemas.CONSTRAINTS), ("edges", merge.schemas.EDGES)))))
    return t(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("doc"), F.col("role").alias("chunker"), F.col("turn").cast("int").alias("chunk_idx"), g.alias("graph"))


def _merged_sql(threshold: str = "(SELECT 0.78 AS th)") -> str:
    """Steps kept of each cell: one step a turn, compared with the last 12 kept."""
    same = "CASE WHEN len(b.bag) = 0 OR len(t.bag) = 0 THEN 0 ELSE len(list_intersect(b.bag, t.bag)) / (len(b.bag) + len(t.bag) - len(list_intersect(b.bag, t.bag))) END"
    twin = f"coalesce(list_max(list_transform(f.kept[-12:], lambda b: {same})), 0) >= f.th"
    return rf"""t AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS i, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS bag FROM conversations),
f(th, conv_id, role, i, kept) AS (SELECT th, conv_id, role, i, [{{'id': 'c0_s1', 'bag': bag}}] FROM t, {threshold} WHERE i = 0
  UNION ALL SELECT f.th, t.conv_id, t.role, t.i, CASE WHEN {twin} THEN f.kept ELSE list_append(f.kept, {{'id': 'c' || t.i || '_s1', 'bag': t.bag}}) END FROM f JOIN t ON t.conv_id = f.conv_id AND t.role = f.role AND t.i = f.i + 1),
m AS (SELECT th, conv_id, role, max(i) + 1 AS n_in, arg_max(kept, i) AS kept FROM f GROUP BY 1, 2, 3)"""


@query(f"WITH RECURSIVE {_merged_sql()} SELECT conv_id::VARCHAR AS doc, role AS chunker, len(kept)::INTEGER AS n_steps, (len(kept) - 1)::INTEGER AS n_edges, (n_in - len(kept))::INTEGER AS duplicate_count, 0 AS dropped_edge_count FROM m")
def merge_graphs(spark, sf):
    m = merge.merge_cells(merge.gather(_turn_graphs(spark, sf)))
    return m.select("doc", "chunker", F.size("steps").alias("n_steps"), F.size("edges").alias("n_edges"), "duplicate_count", "dropped_edge_count")


@query(f"WITH RECURSIVE {_merged_sql('(SELECT unnest([0.65, 0.70, 0.78, 0.85, 0.90])::DOUBLE AS th)')} SELECT th AS threshold, role AS chunker, round(avg(len(kept)), 6) AS mean_steps, round(sum(len(kept)) / sum(n_in), 6) AS retention FROM m GROUP BY 1, 2")
def merge_sweep(spark, sf):
    return merge.sweep(merge.gather(_turn_graphs(spark, sf))).withColumns({"mean_steps": F.round("mean_steps", 6), "retention": F.round("retention", 6)})


@query(f"""WITH RECURSIVE {_merged_sql()},
g AS (SELECT conv_id, unnest(kept) AS x FROM m WHERE role = 'user'), p AS (SELECT conv_id, unnest(kept) AS y FROM m WHERE role = 'assistant'),
s AS (SELECT conv_id, x.id AS g, y.id AS p, len(list_intersect(x.bag, y.bag)) / (len(x.bag) + len(y.bag) - len(list_intersect(x.bag, y.bag))) AS sim FROM g JOIN p USING (conv_id) WHERE len(x.bag) > 0 AND len(y.bag) > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY sim DESC, g DESC, p DESC) AS r FROM s WHERE sim >= 0.1),
a(conv_id, r, g, p, sim, ok, gs, ps) AS (SELECT conv_id, r, g, p, sim, TRUE, [g], [p] FROM o WHERE r = 1
  UNION ALL SELECT o.conv_id, o.r, o.g, o.p, o.sim, NOT (list_contains(gs, o.g) OR list_contains(ps, o.p)), CASE WHEN list_contains(gs, o.g) OR list_contains(ps, o.p) THEN gs ELSE list_append(gs, o.g) END,
  CASE WHEN list_contains(gs, o.g) OR list_contains(ps, o.p) THEN ps ELSE list_append(ps, o.p) END FROM a JOIN o ON o.conv_id = a.conv_id AND o.r = a.r + 1)
SELECT conv_id::VARCHAR AS doc, g, p, round(sim, 6) AS sim FROM a WHERE ok""")
def greedy_match(spark, sf):
    m = merge.merge_cells(merge.gather(_turn_graphs(spark, sf))).select("doc", "chunker", "steps")
    j = m.where("chunker = 'user'").select("doc", F.col("steps").alias("g")).join(m.where("chunker = 'assistant'").select("doc", F.col("steps").alias("p")), "doc")
    return j.select("doc", F.explode(metrics.align_words(F.col("g"), F.col("p"), 0.1)).alias("m")).select("doc", "m.g", "m.p", F.round("m.sim", 6).alias("sim"))


@query(f"SELECT doc_id AS doc, md5(concat_ws(chr(10) || chr(10), '{extract.PROMPT}', 'Title: ' || coalesce(source, ''), 'Text:' || chr(10) || text)) AS digest FROM documents")
def prompt_digest(spark, sf):
    return docs(spark, sf).select("doc", F.md5(extract.prompt(F.col("source"), F.col("text")).cast("binary")).alias("digest"))


@query("SELECT conv_id, turn, role, 1 AS n_steps, turn::VARCHAR AS step FROM conversations")
def reply_parse(spark, sf):
    """Replies that are JSON, JSON in a fence, or JSON within prose, each with one step."""
    body = F.concat(F.lit('{"steps": [{"id": "s1", "text": "'), F.col("turn").cast("string"), F.lit('"}]}'))
    reply = F.when(F.col("role") == "assistant", F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\n"))).when(F.col("role") == "user", F.concat(F.lit("Found "), body, F.lit(" {in} all."))).otherwise(body)
    g = t(spark, sf, "conversations").select("conv_id", "turn", "role", extract.parsed(reply).alias("g"))
    return g.select("conv_id", "turn", "role", F.size("g.steps").alias("n_steps"), F.col("g.steps")[0]["text"].alias("step"))


@query("SELECT conv_id AS doc, role AS chunker, sum(coalesce(length(text) // 4, 0))::BIGINT AS input_tokens, sum(turn)::BIGINT AS output_tokens, 0::BIGINT AS cached_tokens, count(*) FILTER (text IS NULL OR length(text) > 200) AS n_errors FROM conversations GROUP BY 1, 2")
def token_accounting(spark, sf):
    """Tokens and errors of the calls of each cell; a turn stands for a call."""
    c = t(spark, sf, "conversations").select(F.col("conv_id").alias("doc"), F.col("role").alias("chunker"), F.expr("length(text) div 4").alias("input_tokens"), F.col("turn").alias("output_tokens"), F.lit(None).cast("long").alias("cached_tokens"), F.when(F.col("text").isNull() | (F.length("text") > 200), "too long").alias("error"))
    return extract.accounting(c)


_NAMED = r"regexp_replace(regexp_extract(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '([^/]*)/*$', 1), '(.)\.[^.]+$', '\1')"


@query(rf"SELECT page_id, substr(coalesce(array_to_string(list_transform(regexp_extract_all(regexp_replace(translate({_NAMED}, '_-', '  '), '^\s+|\s+$', '', 'g'), '\p{{L}}+|\P{{L}}+'), lambda x: upper(x[1]) || lower(x[2:])), ''), ''), 1, 200) AS title FROM pages")
def page_titles(spark, sf):
    return t(spark, sf, "pages").select("page_id", profile.title_of(F.col("url")).alias("title"))


@query("SELECT coalesce(nullif(lang, 'en'), CASE " + " ".join(f"WHEN regexp_matches(b, '{w}') THEN '{n}'" for n, w in profile.DOMAINS.items()) + " ELSE 'general' END) AS domain, count(*) AS n FROM (SELECT lang, lower(source || ' ' || '' || ' ' || text) AS b FROM documents) GROUP BY 1")
def domain_hints(spark, sf):
    """Languages other than English stand for the domains that a source gives itself."""
    d = t(spark, sf, "documents").select(F.expr("nullif(lang, 'en')").alias("hint"), profile.domain(F.col("source"), F.lit(""), F.col("text")).alias("domain"))
    return profile.with_hints(d, "hint", "domain").groupBy("domain").agg(F.count("*").alias("n"))


@query("SELECT doc_id AS doc, md5(array_to_string(string_split(text, chr(10))[1:40], chr(10))) AS digest FROM documents")
def first_pages(spark, sf):
    """Text of the first 40 pages; a line stands for a page."""
    return docs(spark, sf).select("doc", F.md5(profile.first_pages(F.split("text", LINE, -1)).cast("binary")).alias("digest"))


_STORED = "SELECT sha256(text) AS sha256, source, '/store/' || CASE WHEN lang = 'en' THEN source ELSE lang END || '/' || doc_id AS path FROM documents"


@query(f"""SELECT sha256, source, path FROM (SELECT w.sha256, w.source, f.path, row_number() OVER (PARTITION BY w.sha256, w.source ORDER BY CASE WHEN contains(f.path, '/' || w.source || '/') THEN 0 ELSE 1 END, f.path) AS r
FROM (SELECT DISTINCT sha256, source FROM ({_STORED})) w JOIN ({_STORED}) f ON f.sha256 = w.sha256) WHERE r = 1""")
def locate_by_hash(spark, sf):
    """The file of each wanted content, from the source's own folder where it has one."""
    d = t(spark, sf, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), "source", F.concat(F.lit("/store/"), F.when(F.col("lang") == "en", F.col("source")).otherwise(F.col("lang")), F.lit("/"), F.col("doc_id").cast("string")).alias("path"))
    return files.locate(d.select("sha256", "source"), d.select("sha256", "path")).select("sha256", "source", "path")


_GOLD = "SELECT conv_id, count(*) FILTER (role = 'user') AS s, count(*) FILTER (role = 'system') AS p, min(role) AS kind FROM conversations GROUP BY 1"


def _golds(spark, sf):
    """A conversation as a gold graph: the user's turns are steps, the system's are preconditions."""
    row = F.struct(F.col("turn").cast("string").alias("id"), "text")
    of = lambda r: F.collect_list(F.when(F.col("role") == r, row))
    g = t(spark, sf, "conversations").groupBy("conv_id").agg(of("user").alias("steps"), of("system").alias("preconditions"), F.min("role").alias("kind"))
    return g.select(F.col("conv_id").alias("doc"), "kind", F.struct("steps", "preconditions").alias("gold"))


@query(f"SELECT kind, count(*) AS n, round(avg(s), 6) AS mean_steps, count(*) FILTER (s = 0) AS n_empty, round(avg(p), 6) AS mean_preconditions, count(*) FILTER (p > 0) AS n_with_precondition FROM ({_GOLD}) GROUP BY 1")
def oracle_profile(spark, sf):
    p = stats.oracle_profile(_golds(spark, sf), ["kind"])
    return p.withColumns({"mean_steps": F.round("mean_steps", 6), "mean_preconditions": F.round("mean_preconditions", 6)})


@query(f"SELECT conv_id AS doc, s::INTEGER AS n_steps FROM ({_GOLD}) WHERE s > 0")
def scored_golds(spark, sf):
    return stats.scored(_golds(spark, sf)).select("doc", F.size("gold.steps").alias("n_steps"))


@query(f"""SELECT source AS chunker, round(sum(least(n, 20)) / sum(n), 6) AS coverage FROM (SELECT doc, source, count(*) AS n FROM ({_FIXED}) WHERE {_NOT_BLANK} GROUP BY 1, 2) GROUP BY 1""")
def sampling_coverage(spark, sf):
    """Share of the chunks that the samples take, by source."""
    c = chunkers.fixed(docs(spark, sf)).groupBy("doc").agg(F.count("*").alias("n_chunks"))
    cells = c.join(docs(spark, sf).select(F.col("doc").cast("string").alias("doc"), F.col("source").alias("chunker")), "doc").withColumn("n_sampled", F.least("n_chunks", F.lit(extract.SAMPLE)))
    return stats.sampling_coverage(cells).withColumn("coverage", F.round("coverage", 6))


@query("SELECT source, count(*) FILTER (length(text) > 200) AS ok, count(*) FILTER (text IS NULL) AS miss, count(*) FILTER (length(text) <= 200) AS err FROM documents GROUP BY 1")
def extraction_outcomes(spark, sf):
    """Outcomes of reading; a text of 200 characters or fewer stands for a failure."""
    return stats.outcome_counts(docs(spark, sf).withColumn("status", F.when(F.col("text").isNull(), "miss").when(F.length("text") > 200, "ok").otherwise("err")), ["source"])


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g)
SELECT min(ts) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def session_events(spark, sf):
    return streaming.sessions(t(spark, sf, "events"))


@query()
def experiment_measures(spark, sf):
    """Chunk, sample, extract by rules, merge, and compare with the whole text's graph."""
    d = docs(spark, sf).select("doc", F.regexp_replace("text", "\n", "\n\n").alias("text"))
    return experiment.run(d)

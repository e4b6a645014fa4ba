"""One query per operator, under the driver's column contracts, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard_join, license_scan, mixing, pii, quality, substring_dedup, suffix_dedup, token_counts, url_filter

TOKENIZER = "byte_bpe_50k.json"
TOKEN_LIMIT = 1024
#: The first four are the contract's; the others are the method's own.
URL_RULES = [
    url_filter.prefix_rule("block", "net/"),
    url_filter.prefix_rule("allow", "example.net/en/"),
    url_filter.prefix_rule("block", "example.com/de/"),
    url_filter.prefix_rule("allow", "org/fr/"),
    *url_filter.word_rules("block", url_filter.BLOCKED),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), slop=decontaminate.SLOP)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"), F.size("near").cast("long").alias("n_near"), F.sha2(F.concat_ws(",", "near").cast("binary"), 256).alias("near_sha256"),
    )


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(spark, _table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(spark, _table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(spark, _table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), pii.session_key(spark))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(spark, _table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = token_counts.token_counts(_table(spark, sf_dir, "documents"), str(public_tokenizers.path(TOKENIZER)))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(spark, _table(spark, sf_dir, "pages"), URL_RULES)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_ = (op1_decontamination, op2_ngram_jaccard, op3_substring_dedup, op4_suffix_dedup, op5_pii, op6_license_scan, op7_mixing, op8_quality_rules, op9_token_counts, op10_url_filter, pipeline)
    return {f.__name__: f for f in all_}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_PLAIN = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def oracle_sql() -> dict[str, str]:
    """For DuckDB. op2 (components), op4 (each byte), op5, op6, op9 (libraries, chains and keys) and pipeline are tested by brute force."""
    return {
        "op1_decontamination": f"""
WITH d AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
i AS (SELECT cast(item_id AS VARCHAR) AS item, w, least(len(w), 13) AS k FROM (SELECT item_id, {_PLAIN} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item, k, list_slice(w, s, s + k - 1) AS g FROM (SELECT item, k, w, unnest(generate_series(1, len(w) - k + 1)) AS s FROM i)),
ks AS (SELECT DISTINCT k FROM i),
dw AS (SELECT doc_id, k, s, list_slice(w, s, s + k - 1) AS g FROM (SELECT doc_id, k, w, unnest(generate_series(1, len(w) - k + 1)) AS s FROM d, ks WHERE len(w) >= k)),
m AS (SELECT DISTINCT dw.doc_id, dw.s, dw.k, iw.item FROM dw JOIN iw ON dw.g = iw.g AND dw.k = iw.k),
h AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(s, s + k - 1)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id),
dp AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS pos FROM d),
ip AS (SELECT item, k, r, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS p, len(w) AS n FROM (SELECT *, row_number() OVER () AS r FROM i)),
ic AS (SELECT ip.*, coalesce(c.f, 0) AS f FROM ip LEFT JOIN (SELECT x, count(*) AS f FROM dp GROUP BY x) c ON ip.x = c.x),
win AS (SELECT r, s, arg_min(p, f * 1000000 + p) AS a FROM (SELECT *, unnest(generate_series(greatest(0, p - k + 1), least(p, n - k))) AS s FROM ic) GROUP BY r, s),
pl AS (SELECT DISTINCT doc_id, win.r, s, pos - a AS delta FROM win JOIN ip ON ip.r = win.r AND ip.p = a JOIN dp ON dp.x = ip.x),
nr AS (SELECT pl.doc_id, item FROM pl JOIN ip ON ip.r = pl.r AND p BETWEEN s AND s + k - 1 JOIN dp ON dp.doc_id = pl.doc_id AND dp.x = ip.x AND abs(dp.pos - delta - p) <= 4 GROUP BY pl.doc_id, item, pl.r, s, delta, k HAVING count(DISTINCT p) = k),
nt AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM nr) GROUP BY doc_id)
SELECT cast(coalesce(nt.n, 0) AS BIGINT) AS n_near, sha256(coalesce(nt.s, '')) AS near_sha256, d.doc_id, cast(len(w) AS BIGINT) AS n_words, cast(coalesce(h.n, 0) AS BIGINT) AS n_hit, cast(coalesce(t.n, 0) AS BIGINT) AS n_items, sha256(coalesce(t.s, '')) AS items_sha256,
  coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id LEFT JOIN nt ON d.doc_id = nt.doc_id""",
        "op3_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, s, md5(array_to_string(list_slice(w, s, s + 49), ' ')) AS h FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS s FROM d WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS first FROM g GROUP BY h),
r AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + 49)) AS p FROM g JOIN f USING (h) WHERE first < doc_id),
u AS (SELECT doc_id, unnest(w) AS x, unnest(generate_series(1, len(w))) AS p FROM d),
k AS (SELECT u.doc_id, string_agg(x, ' ' ORDER BY u.p) AS t, count(*) AS n FROM u LEFT JOIN r ON u.doc_id = r.doc_id AND u.p = r.p WHERE r.p IS NULL GROUP BY u.doc_id)
SELECT d.doc_id, cast(len(w) AS BIGINT) AS n_words, cast(len(w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id""",
        "op7_mixing": r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, cast(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
o AS (SELECT *, 3 * source_size AS cap, row_number() OVER (ORDER BY 3 * source_size / w, source NULLS LAST) AS r FROM s),
l AS (SELECT *, (SELECT sum(source_size) FROM o) - coalesce(sum(cap) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  (SELECT sum(w) FROM o) - coalesce(sum(w) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_w FROM o),
v AS (SELECT arg_min(cast(rest AS DOUBLE) / cast(rest_w AS DOUBLE), r) AS level FROM l WHERE cast(rest AS DOUBLE) / cast(rest_w AS DOUBLE) <= cast(cap AS DOUBLE) / cast(w AS DOUBLE)),
t AS (SELECT o.source, source_size, CASE WHEN source_size = 0 THEN 0.0 ELSE least(cast(cap AS DOUBLE), coalesce(cast(w AS DOUBLE) * level, cast(cap AS DOUBLE))) END AS target FROM o, v),
q AS (SELECT source, source_size, target, cast(least(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END), 3) AS BIGINT) AS whole FROM t),
h AS (SELECT d.doc_id, d.size, q.*, cast(floor(target - cast(whole * source_size AS DOUBLE)) AS BIGINT) AS quota, md5('17:' || d.doc_id || ':' || md5(d.text)) AS m FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
u AS (SELECT *, quota - coalesce(sum(size) OVER (PARTITION BY source ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM h)
SELECT doc_id, size, source_size, target, cast(CASE WHEN size = 0 THEN 0 ELSE whole * size + greatest(0, least(rest, size)) END AS BIGINT) AS taken FROM u""",
        "op8_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
l AS (SELECT doc_id, host, md5(t) AS th, x, trim(regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[\x20\x09-\x0D]+', ' ', 'g')) AS n,
  len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words FROM (SELECT *, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
hosts AS (SELECT host, count(DISTINCT md5(t)) AS documents FROM d GROUP BY host),
common AS (SELECT l.host, l.n FROM l JOIN hosts USING (host) GROUP BY l.host, l.n, documents HAVING count(DISTINCT th) > 20 AND count(DISTINCT th) > documents * 0.3),
gone AS (SELECT doc_id, sum(words) AS g FROM l JOIN common ON l.host = common.host AND l.n = common.n GROUP BY doc_id),
dup AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM l GROUP BY doc_id),
tri AS (SELECT doc_id, i, list_slice(w, i, i + 2) AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 3)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice WHERE c > 1) GROUP BY doc_id),
s AS (SELECT d.doc_id, cast(len(w) AS BIGINT) AS n_words, cast(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars, cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  cast(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, cast(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(gone.g, 0) AS g
  FROM d LEFT JOIN dup ON d.doc_id = dup.doc_id LEFT JOIN rep ON d.doc_id = rep.doc_id LEFT JOIN gone ON d.doc_id = gone.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - g >= n_words * 0.3 AS kept FROM s""",
        "op10_url_filter": r"""
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM a),
c AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM b),
r(rule, verdict) AS (VALUES ('net/', 'block'), ('example.net/en/', 'allow'), ('example.com/de/', 'block'), ('org/fr/', 'allow')),
f AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM c, r
  WHERE (host = regexp_extract(rule, '^[^/]*') OR ends_with(host, '.' || regexp_extract(rule, '^[^/]*'))) AND starts_with(path, substr(rule, instr(rule, '/'))) GROUP BY page_id)
SELECT c.page_id, host, path, f.rule, coalesce(f.verdict, CASE WHEN regexp_matches(host, '(^|\.)(' || words || ')(-|\.|$)') OR regexp_matches(path, '/(' || words || ')(/|$)') THEN 'block' ELSE 'allow' END) AS verdict FROM c CROSS JOIN (SELECT '"""
        + "|".join(url_filter.BLOCKED)
        + """' AS words) LEFT JOIN f ON c.page_id = f.page_id""",
    }

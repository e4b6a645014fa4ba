"""Summaries and non-parametric statistics over measures of cells."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import MEASURES

LOWER_IS_BETTER = ("orphan_constraint_rate",)
ALPHA = 0.05


def scored(gold: DataFrame) -> DataFrame:
    """Gold graphs with a step; others are left out of every statistic."""
    return gold.where(F.size("gold.steps") > 0)


def summary(cells: DataFrame, by: str = "chunker", measures: tuple[str, ...] = MEASURES, digits: int = 4) -> DataFrame:
    """Mean and exact median of each measure."""
    return cells.groupBy(by).agg(F.count("*").alias("n_cells"), *(f for m in measures for f in (F.round(F.avg(m), digits).alias(f"{m}_mean"), F.round(F.median(m), digits).alias(f"{m}_median"))))


def strata(cells: DataFrame, stratum: str, by: str, measures: tuple[str, ...]) -> DataFrame:
    """Means by stratum and group, with the totals of each group where the stratum is null."""
    return cells.rollup(by, stratum).agg(F.count("*").alias("n"), *(F.avg(m).alias(m) for m in measures)).where(F.col(by).isNotNull())


def long_form(cells: DataFrame, keys: list[str], measures: tuple[str, ...]) -> DataFrame:
    return cells.unpivot(keys, list(measures), "metric", "value")


def paired(cells: DataFrame, base: str, doc: str = "doc", by: str = "chunker", measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """(doc, baseline, metric, delta): ``base`` less each other group on the same document, sign turned where lower is better."""
    x = long_form(cells, [doc, by], measures)
    ours = x.where(F.col(by) == base).select(doc, "metric", F.col("value").alias("v"))
    others = x.where(F.col(by) != base).select(doc, "metric", F.col(by).alias("baseline"), F.col("value").alias("b"))
    sign = F.when(F.col("metric").isin(*LOWER_IS_BETTER), -1.0).otherwise(1.0)
    return others.join(ours, [doc, "metric"]).select(doc, "baseline", "metric", (sign * (F.col("v") - F.col("b"))).alias("delta"))


def wins(deltas: DataFrame, keys: list[str]) -> DataFrame:
    return deltas.groupBy(*keys).agg(F.count("*").alias("n_paired"), F.avg("delta").alias("mean_delta"), F.count_if(F.col("delta") > 0).alias("wins"), F.count_if(F.col("delta") == 0).alias("ties"), F.count_if(F.col("delta") < 0).alias("losses"))


def erfc(x: Column) -> Column:
    """Neither Spark nor SQL has it; one value a group."""
    return F.pandas_udf(_erfc, "double")(x)


def _erfc(x: pd.Series) -> pd.Series:
    return x.map(math.erfc)


def wilcoxon_w(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, w, z): signed ranks without zeros, ties with their mean rank, no correction."""
    d = deltas.where("delta <> 0").withColumn("_a", F.abs("delta"))
    w = Window.partitionBy(*keys)
    rank = F.rank().over(w.orderBy("_a")) + (F.count("*").over(Window.partitionBy(*keys, "_a")) - 1) / 2
    r = d.withColumn("_r", rank).groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.when(F.col("delta") > 0, F.col("_r")).otherwise(0.0)).alias("up"), F.sum(F.when(F.col("delta") < 0, F.col("_r")).otherwise(0.0)).alias("down"))
    n = F.col("n")
    found = r.select(*keys, "n", F.least("up", "down").alias("w"))
    found = found.withColumn("z", (F.col("w") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24))
    return deltas.select(*keys).distinct().join(found, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("w", F.lit(0.0)).alias("w"), F.coalesce("z", F.lit(0.0)).alias("z"))


def wilcoxon(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the two-sided p; 1 where all differences are zero."""
    return wilcoxon_w(deltas, keys).withColumn("p", F.when(F.col("n") == 0, 1.0).otherwise(erfc(F.abs("z") / math.sqrt(2))))


def comparison(cells: DataFrame, base: str = "pac", **options) -> DataFrame:
    d = paired(cells, base, **options)
    return wins(d, ["baseline", "metric"]).join(wilcoxon(d, ["baseline", "metric"]).drop("n", "z"), ["baseline", "metric"])


def headline(compared: DataFrame) -> DataFrame:
    """One line of text for each comparison, starred below the level."""
    star = F.when(F.col("p") < ALPHA, "*").otherwise(" ")
    return compared.select("baseline", "metric", F.format_string("%-14s %-24s %+8.4f  %d/%d/%d  p=%.4f %s", "baseline", "metric", "mean_delta", "wins", "ties", "losses", "p", star).alias("line"))


def cross_extractor(cells: DataFrame, doc: str = "doc", extractor: str = "extractor", by: str = "chunker", measures: tuple[str, ...] = MEASURES, groups: list[str] | None = None) -> DataFrame:
    """Measures by extractor with a column per group, on documents that every extractor has."""
    n = cells.select(extractor).distinct().count()
    common = cells.groupBy(doc).agg(F.count_distinct(extractor).alias("_n")).where(F.col("_n") == n).select(doc)
    x = long_form(cells.join(common, doc, "left_semi"), [doc, extractor, by], measures)
    return x.groupBy("metric", extractor).pivot(by, groups).agg(F.avg("value"))


def idempotency(counts: DataFrame, groups: list[str]) -> DataFrame:
    """(doc, whole, thorough, one column a group, ratio): chunked counts beside whole-document counts."""
    wide = counts.groupBy("doc", "whole", "thorough").pivot("chunker", groups).agg(F.first("n_steps"))
    mean = sum((F.coalesce(F.col(g), F.lit(0)) for g in groups), F.lit(0)) / len(groups)
    return wide.withColumn("ratio", F.when(F.col("whole") > 0, mean / F.col("whole")))


def oracle_profile(gold: DataFrame, by: list[str]) -> DataFrame:
    s, p = F.size("gold.steps"), F.size("gold.preconditions")
    return gold.groupBy(*by).agg(F.count("*").alias("n"), F.avg(s).alias("mean_steps"), F.count_if(s == 0).alias("n_empty"), F.avg(p).alias("mean_preconditions"), F.count_if(p > 0).alias("n_with_precondition"))


def poisson_weight(*keys: Column) -> Column:
    """A draw from the Poisson distribution of mean 1, by a hash of the keys: how often a document stands in a resample."""
    u = F.shiftrightunsigned(F.xxhash64(*keys), 11) / F.lit(float(1 << 53))
    below = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(16)]
    return reduce(lambda a, c: a + (u >= F.lit(c)).cast("int"), below, F.lit(0))


def bootstrap_ranks(cells: DataFrame, measure: str, rounds: int = 2000, seed: int = 0, doc: str = "doc", by: str = "chunker") -> DataFrame:
    """(group, mean, low, high, rank_1_share): documents resampled, the same draw for all groups of a round.

    A document's times in a round are a Poisson draw by a hash of (seed, round,
    document), so each cell is drawn where it lies and only sums of (round,
    group) are shuffled; the size of a resample varies about the documents'
    number.  Null measures and rounds that draw none of a group are left out.
    """
    drawn = cells.select(F.col(doc).alias("_d"), by, F.col(measure).alias("_m")).where("_m is not null").withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    drawn = drawn.withColumn("_w", poisson_weight(F.lit(seed), F.col("round"), F.col("_d")))
    means = drawn.where("_w > 0").groupBy("round", by).agg((F.sum(F.col("_w") * F.col("_m")) / F.sum("_w")).alias("m"))
    ranked = means.withColumn("r", F.rank().over(Window.partitionBy("round").orderBy(F.desc("m"))))
    return ranked.groupBy(by).agg(F.avg("m").alias("mean"), F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"), F.avg((F.col("r") == 1).cast("int")).alias("rank_1_share"))


def sampling_coverage(cells: DataFrame, by: str = "chunker") -> DataFrame:
    return cells.groupBy(by).agg((F.sum("n_sampled") / F.sum("n_chunks")).alias("coverage"))


def sign_test(wins_: Column, losses: Column) -> Column:
    """Two-sided p of a fair coin: the sum of binomials, each from the last by its logarithm, so that many pairs do not overflow."""
    n, k = (wins_ + losses).cast("double"), F.least(wins_, losses).cast("long")
    first = F.struct((-n * F.lit(math.log(2.0))).alias("l"), F.exp(-n * F.lit(math.log(2.0))).alias("s"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["l"] + F.log((n - i + 1) / i)
        return F.struct(term.alias("l"), (acc["s"] + F.exp(term)).alias("s"))

    tail = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))), first, lambda acc, i: F.when(i > k, acc).otherwise(add(acc, i)), lambda acc: acc["s"])
    return F.least(F.lit(1.0), 2 * tail)


def expected_false(tests: int, alpha: float = ALPHA) -> float:
    return tests * alpha


def detectable_effect(n: int, z_alpha: float = 1.959964, z_power: float = 0.841621) -> float:
    """Least standardised paired difference that n pairs show at that level and power."""
    return (z_alpha + z_power) / math.sqrt(n)


def outcome_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """ok, miss and err of a status column."""
    return rows.groupBy(*by).agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("ok", "miss", "err")))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)

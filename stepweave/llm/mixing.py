"""Mixing sources to target weights, with a bound on repetition.

Targets are filled like water: a source takes its weight's share of all words,
but at most ``max_epochs`` times its own size; what is over is reshared by
weight among the others, until none is above.  The fixed point of that is the
level L with sum(min(w * L, cap)) = total.  With sources in the order of cap / w,
those before some place are capped, so running sums give L without a loop.
Documents are then sampled whole by a seeded draw until their source's target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import MAX_LONG, SPACES, count_words

#: Sources up to which their plan, one row each, is broadcast.
BROADCAST_SOURCES = 200_000


def weights_by_rank(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Sources by code point, null last, weigh ``cycle`` over and over."""
    w = Window.orderBy(F.col("source").isNull(), "source")
    place = F.pmod(F.row_number().over(w) - 1, F.lit(len(cycle)))
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), place + 1).cast("long"))


def targets(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """Adds target to (source, source_size, weight): one row a source, so the running sums are over sources, not documents.

    Weights of 0 or less and empty sources get a target of 0, and what the caps
    of all others leave over stays unused.
    """
    s = sources.withColumn("cap", F.col("source_size") * F.lit(max_epochs)).withColumn("w", F.when((F.col("weight") > 0) & (F.col("source_size") > 0), F.col("weight")).otherwise(F.lit(0).cast("long")))
    all_ = Window.partitionBy()
    order = Window.partitionBy().orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("ratio", F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(F.lit(float("inf"))))
    s = s.withColumn("rest", F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(order), F.lit(0)))
    s = s.withColumn("rest_w", F.sum("w").over(all_) - F.coalesce(F.sum("w").over(order), F.lit(0)))
    # the level if all sources before this one are capped; this one isn't if it is at or below its ratio
    s = s.withColumn("level", F.when((F.col("rest_w") > 0) & (F.col("rest") > 0), F.col("rest") / F.col("rest_w")))
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull().alias("n"), "source", "level"))).over(all_)["level"])
    target = F.when(F.col("w") == 0, 0.0).otherwise(F.least(F.col("cap").cast("double"), F.coalesce(F.col("w") * F.col("level"), F.col("cap").cast("double"))))
    return s.withColumn("target", target).drop("cap", "w", "ratio", "rest", "rest_w", "level")


def draw(seed: int, id_: Column, text: Column) -> Column:
    """A hex number from md5 of the seed, the id and the text: the order in which a source's documents are drawn, the same in every run."""
    whole = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_.cast("long"), F.lit(MAX_LONG)).cast("string"), whole).cast("binary"))


def _plan(sized: DataFrame, max_epochs: int, cycle: tuple[int, ...]) -> DataFrame:
    """The written table of one row a source: source_size, target, whole (times that all its documents are taken), and the last document drawn for the fraction: its ``last`` draw, ``rest`` (words left for it), and of the ``ties`` rows with that draw the ``nth``.

    Buckets are the first three digits of the draw, so the words of a source of
    any size are summed before one task sees the 4096 sums of a source, and only
    sizes of the bucket in which the fraction ends are put in order.
    """
    keep = Scratch(sized.sparkSession)
    sized = sized.select("source", "size", "drawn", F.substring("drawn", 1, 3).alias("bucket"))
    buckets = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    plan = targets(weights_by_rank(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), cycle), max_epochs)
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.withColumn("whole", F.least(F.floor(share), F.lit(max_epochs)).cast("long"))
    plan = plan.withColumn("quota", F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    plan = keep.table(plan.select(F.col("source").alias("of"), "source_size", "target", "whole", "quota"), "sources")
    same = F.col("source").eqNullSafe(F.col("of"))
    below = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = buckets.withColumn("before", F.coalesce(F.sum("words").over(below), F.lit(0)))
    edge = sums.join(plan.select("of", "quota"), same).where("quota > 0 and before < quota and quota <= before + words")
    edge = edge.select("of", F.col("bucket").alias("edge"), (F.col("quota") - F.col("before")).alias("due"))
    near = sized.join(edge, same & (F.col("bucket") == F.col("edge")))
    order, ties = Window.partitionBy("source").orderBy("drawn"), Window.partitionBy("source", "drawn")
    prior = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = near.select("of", "size", F.col("drawn").alias("last"), (F.col("due") - prior).alias("rest"), (F.row_number().over(order) - F.rank().over(order) + 1).alias("nth"), F.count("*").over(ties).alias("ties"))
    last = near.where("rest > 0 and rest <= size").select(F.col("of").alias("end"), "last", "rest", "nth", "ties")
    return keep.table(plan.drop("quota").join(last, F.col("of").eqNullSafe(F.col("end")), "left").drop("end"), "plan")


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with their source's plan, without dealing them by source: one may hold a third of them. Too many sources to broadcast are repeated for each pair of first digits of the draw."""
    same = F.col("source").eqNullSafe(F.col("of"))
    if plan.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(plan), same).drop("of")
    salted = plan.withColumn("salt", F.explode(F.array(*(F.lit(f"{i:02x}") for i in range(256)))))
    return rows.join(salted, same & (F.substring("drawn", 1, 2) == F.col("salt"))).drop("of", "salt")


def _taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows (source, size, drawn and more) with copies, part and taken: a draw before the source's last is taken once more, the last as far as words are left. Only repeated rows that share the last draw are numbered."""
    rows = _with_plan(rows, plan)
    if plan.where("ties > 1").isEmpty():
        rows = rows.withColumn("_turn", F.lit(1))
    else:
        tied = rows.where("ties > 1 and drawn = last").withColumn("_turn", F.row_number().over(Window.partitionBy("source", "drawn").orderBy("size")))
        rows = rows.where("ties is null or ties = 1 or drawn <> last").withColumn("_turn", F.lit(1)).unionByName(tied)
    zero, at_end = F.lit(0).cast("long"), (F.col("drawn") == F.col("last")) & (F.col("_turn") == F.col("nth"))
    before = (F.col("drawn") < F.col("last")) | ((F.col("drawn") == F.col("last")) & (F.col("_turn") < F.col("nth")))
    rows = rows.withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + F.when(before | (at_end & (F.col("rest") >= F.col("size"))), 1).otherwise(0)).otherwise(zero))
    rows = rows.withColumn("part", F.when(at_end & (F.col("rest") < F.col("size")), F.col("rest")).otherwise(zero))
    return rows.drop("_turn", "whole", "last", "rest", "nth", "ties").withColumn("taken", F.col("copies") * F.col("size") + F.col("part"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> tuple[Column, Column, Column]:
    text = F.col(text_col).cast("string")
    return F.col(source_col).cast("string").alias("source"), count_words(text).alias("size"), draw(seed, F.col(id_col), text).alias("drawn")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_epochs: int = 3, seed: int = 17, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, part, taken) of each row.

    All documents of a source are taken floor(target / source_size) times; for
    the fraction that is left, documents are drawn whole in a seeded order until
    its words are reached, and only the last one drawn, one a source at most, is
    cut to its first ``part`` words.  So a source's taken words are its target
    rounded down, and taken = copies * size + part is at most ``max_epochs`` *
    size.  Null and empty texts have size 0 and are not taken; a null source is a
    source, a null id an id; rows that share an id are drawn by their texts,
    repeated rows follow one another.  Other columns are not read.
    """
    sized = Scratch(docs.sparkSession).table(docs.select(F.col(id_col).alias("doc_id"), *_sized(docs, id_col, text_col, source_col, seed)), "sized")
    return _taken(sized, _plan(sized, max_epochs, cycle)).drop("drawn")


def materialise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_epochs: int = 3, seed: int = 17, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as ``mix`` takes it, with ``copy`` from 1; a part as its first words, joined by one space.

    Nulls and repeated rows as in ``mix``; a column named copy is replaced.
    """
    columns = [c for c in docs.columns if c != "copy"]
    row = F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row")
    measures = _sized(docs, id_col, text_col, source_col, seed)
    sized = Scratch(docs.sparkSession).table(docs.select(measures[0], *measures[1:]), "sized")
    taken = _taken(docs.select(row, *measures), _plan(sized, max_epochs, cycle))
    n = F.col("copies") + F.when(F.col("part") > 0, 1).otherwise(0)
    each = taken.where(n > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), n)))
    text = F.col("row")[text_col]
    words = F.split(F.btrim(text.cast("string"), F.lit(SPACES)), "[\\x20\\x09-\\x0D]+")
    cut = F.when(F.col("copy") <= F.col("copies"), text).otherwise(F.array_join(F.slice(words, F.lit(1), F.col("part").cast("int")), " "))
    return each.select(*((cut if c == text_col else F.col("row")[c]).alias(c) for c in columns), "copy")

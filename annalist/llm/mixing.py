"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key ``-ln(u) / quality`` from a hash of its
id, so reruns agree.  Inside a source documents are taken in key order until the
source's token budget is met.  Complete epochs come first: a target of 2.4 times
the source takes every document twice and selects 0.4 of the source by keys.

The order is never a global sort.  Keys are monotonically mapped to
``KEY_BINS`` bins; token sums per (source, bin) are pre-aggregated and
prefix-summed, which settles all bins but the one in which the budget ends; only
that bin's documents are ranked one by one.

Defined results: null or empty texts have size 0 and are taken 0 words; a null
source is a source of its own, ordered last; rows that repeat an id share a key
and are ranked together by size; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

KEY_BINS = 16384
_ADDED = ("size", "source_size", "target", "epochs", "taken")
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """Prose-likeness from 0.25 to 1: highest where words have five characters on average."""
    mean = F.char_length(text) / F.greatest(size, F.lit(1))
    return F.greatest(F.lit(0.25), F.lit(1.0) / (F.lit(1.0) + F.abs(mean - F.lit(6.0)) / F.lit(6.0)))


def uniform(doc_id: Column, seed: int = 0) -> Column:
    """A number in (0, 1) from 52 bits of a digest of the id."""
    digest = F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}"))), 1, 13)
    return (F.conv(digest, 16, 10).cast("double") + F.lit(0.5)) / F.lit(2.0**52)


def targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, take the weights in turn and share the sum
    of all sizes; a target stops at ``most`` times its source and the excess goes
    to the others by weight until none is above.  That is water filling: with
    sources ordered by cap / weight, the saturated ones form a prefix.
    The windows see one row a source, not documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    place = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (place + 1).cast("int")).cast("long")
    t = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most).withColumn("total", F.sum("source_size").over(every))
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    t = t.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward))
    # saturated while the level that the rest would share is above the own cap / weight
    t = t.withColumn("full", F.col("level") * F.col("weight") >= F.col("cap"))
    t = t.withColumn("level", F.max(F.when(~F.col("full"), F.col("level"))).over(every))
    return t.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, seed: int = 0, quality: Column | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Every row of ``docs`` with size, source_size, target, epochs and taken (words the mix takes, repeats counted).

    ``quality``: a positive column that scales the keys; by default ``quality_weight``.
    ``columns``: those of ``docs`` to carry along; leave the text out where it isn't needed.
    Added columns replace those of their names.
    """
    docs = docs.drop(*_ADDED)
    columns = [c for c in (docs.columns if columns is None else columns) if c not in _ADDED]
    kept = F.struct(*[F.col(c) for c in columns or ["doc_id"]])  # in one column, so that no name can clash
    rows = docs.withColumn("size", word_count(F.col("text")))
    weight = quality if quality is not None else quality_weight(F.col("text"), F.col("size"))
    key = -F.log(uniform(F.col("doc_id"), seed)) / F.coalesce(weight, F.lit(0.25))
    rows = rows.select(kept.alias("kept"), "doc_id", "source", "size", key.alias("_key"))
    rows = rows.withColumn("_bin", F.floor((F.lit(1.0) - F.exp(-F.col("_key"))) * KEY_BINS).cast("int"))
    # three steps read these rows: count words once
    return _taken(stored(rows, "sized"), weights, most)


def _taken(rows: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    bins = rows.groupBy("source", "_bin").agg(F.sum("size").alias("bin_size"))
    goal = targets(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, most)
    # a null source must join: compare null-safely on a key that is never null
    key = [F.coalesce(F.col("source"), F.lit("")).alias("_s"), F.col("source").isNull().alias("_n")]
    upto = Window.partitionBy("_s", "_n").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    goal = goal.select(*key, "source_size", "target").withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("budget", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size")))
    plan = bins.select(*key, "_bin", "bin_size").withColumn("before", F.coalesce(F.sum("bin_size").over(upto), F.lit(0))).join(goal, ["_s", "_n"])
    # 1: the whole bin is taken, 0: nothing of it, null: the budget ends inside
    plan = plan.select("_s", "_n", "_bin", "source_size", "target", "epochs", "budget", "before", F.when(F.col("before") + F.col("bin_size") <= F.col("budget"), 1).when(F.col("before") >= F.col("budget"), 0).alias("whole"))
    plan = plan.withColumn("_edge", F.col("whole").isNull())
    marked = rows.withColumns({"_s": F.coalesce(F.col("source"), F.lit("")), "_n": F.col("source").isNull()}).join(plan, ["_s", "_n", "_bin"])
    out = ["kept.*"]
    settled = marked.where(~F.col("_edge")).select(*out, "size", "source_size", "target", "epochs", (F.col("size") * (F.col("epochs") + F.col("whole"))).alias("taken"))
    inside = Window.partitionBy("_s", "_n", "_bin").orderBy("_key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = marked.where("_edge").withColumn("_sum", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    # the document at the end of the budget is taken if more than half of it fits
    edge = edge.select(*out, "size", "source_size", "target", "epochs", (F.col("size") * (F.col("epochs") + (F.col("_sum") + F.col("size") / 2 <= F.col("budget")).cast("int"))).alias("taken"))
    return settled.unionByName(edge)

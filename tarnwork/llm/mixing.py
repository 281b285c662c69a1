"""Mixing sources to target weights by nested hash thresholds.

Every row has a 60-bit hash of its id.  Words are summed by source and leading hash bits; the running sum gives the
bucket in which a source's budget runs out; only that bucket is opened further, 12, then 16, then 32 bits.  What lies
below the threshold is taken: a filter, no sort, and a smaller budget takes a subset of a larger one.

A source whose target exceeds its size gives every document once and, below the threshold, once more.  The document at
the threshold is taken if that brings the sum nearer.  Rows of one id share a hash and fare alike.  Null sources are a
source of their own, last; null ids hash as the empty text; null texts have no words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stage, text_of

#: Leading bits that each level reads; together the hash.
LEVELS = (12, 16, 32)
HASH_BITS = sum(LEVELS)
CYCLE = (3, 1, 2)


def size_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def key_of(id_col: str) -> Column:
    """60 bits of the id's MD5 digest, which other engines can compute alike."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _running(rows: DataFrame, order: tuple, sums: tuple[str, ...] = ()) -> DataFrame:
    """Adds _rank, from 0, and for each column of ``sums`` the sum _before_c of the rows before; sorted and summed by ranges, so no task has all rows."""
    at = stage(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted").withColumn("_part", F.shiftright("_at", 33))
    totals = at.groupBy("_part").agg(F.count("*").alias("_n"), *(F.sum(c).alias(f"_t_{c}") for c in sums))
    ranges = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    zero = lambda c: F.coalesce(c, F.lit(0))
    totals = totals.select("_part", zero(F.sum("_n").over(ranges)).alias("_n"), *(zero(F.sum(f"_t_{c}").over(ranges)).alias(f"_t_{c}") for c in sums))
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    out = at.join(totals, "_part").withColumn("_rank", F.col("_n") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    for c in sums:
        out = out.withColumn(f"_before_{c}", F.col(f"_t_{c}") + zero(F.sum(c).over(inside)))
    return out.drop("_at", "_part", "_n", *(f"_t_{c}" for c in sums))


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code point order, null last, weigh as ``cycle`` says; all share ``share`` times the total.  A target stops
    at ``most`` times its source's size, and the excess goes to the others by weight: target = min(cap, level * weight)
    for the one level at which the targets add up.  However many sources there are, no task has them all.
    """
    nulls = F.col("source").isNull()
    ranked = _running(sizes, (nulls, "source"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in cycle)), (F.col("_rank") % len(cycle) + 1).cast("int"))
    weighed = ranked.select("source", "source_size", weight.alias("weight"), (F.lit(most) * F.col("source_size")).alias("cap"))
    weighed = stage(_running(weighed, (F.col("cap") / F.col("weight"), nulls, "source"), ("cap", "weight")), "weighed")
    whole = weighed.agg((F.lit(share) * F.sum("source_size")).alias("budget"), F.sum("weight").alias("weights"))
    # The level if all sources before this one, by cap per weight, are at their caps; the first that it doesn't overflow counts.
    level = (F.col("budget") - F.col("_before_cap")) / (F.col("weights") - F.col("_before_weight"))
    fits = weighed.join(F.broadcast(whole)).withColumn("level", level).where(F.col("level") <= F.col("cap") / F.col("weight"))
    found = fits.agg(F.max("level").alias("found"))  # one row, as whole is
    target = F.least("cap", F.coalesce(F.col("found") * F.col("weight"), F.col("cap")))
    return weighed.join(F.broadcast(found)).select("source", "source_size", F.round(target, 6).alias("target"))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, cycle: tuple[int, ...] = CYCLE, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size, source_size, target, taken, copies) of every row; taken = copies * size is what the mix takes."""
    sized, goal = _plan(docs, share, most, cycle, id_col, text_col, source_col)
    out = sized.join(goal, F.col("source").eqNullSafe(F.col("goal.source"))).withColumn("copies", _copies(F.col("_h"), most))
    return out.select(F.col("id").alias(id_col), "size", "goal.source_size", "goal.target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def _copies(h: Column, most: float) -> Column:
    """How often a row of this hash is taken, beside its source's ``goal``."""
    below = (h < F.col("goal.edge")) | ((h == F.col("goal.edge")) & F.col("goal.nearer"))
    more = F.when(F.col("goal.edge").isNull(), F.col("goal.rest") > 0).otherwise(below)
    return F.least(F.col("goal.whole") + more.cast("long"), F.lit(int(most)).cast("long"))


def _plan(docs: DataFrame, share: float, most: float, cycle: tuple[int, ...], id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, source, size, _h) of every row, and a row for each source: struct ``goal``."""
    sized = stage(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_of(text_of(text_col)).alias("size"), key_of(id_col).alias("_h")), "sized")
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), share, most, cycle)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    goal = goal.withColumn("whole", whole.cast("long")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    goal = stage(goal, "targets")

    edge = goal.select("source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    used = 0
    for bits in LEVELS:
        inside = sized
        if used:
            inside = sized.join(edge.select(F.col("source").alias("_s"), F.col("prefix").alias("_p")), F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("_h", HASH_BITS - used) == F.col("_p")))
        used += bits
        hist = inside.groupBy("source", F.shiftright("_h", HASH_BITS - used).alias("bucket")).agg(F.sum("size").alias("n"))
        hist = hist.join(edge.select(F.col("source").alias("_s"), "rest", "before"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        upto = F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))
        hist = hist.withColumn("upto", F.col("before") + upto)
        # The bucket where the budget runs out; a source that its budget covers whole has none.
        over = hist.where("upto > rest").groupBy("source", "rest").agg(F.min(F.struct("bucket", "upto", "n")).alias("b"))
        edge = stage(over.select("source", "rest", F.col("b.bucket").alias("prefix"), (F.col("b.upto") - F.col("b.n")).alias("before"), F.col("b.upto").alias("upto")), "edge")
    last = edge.select(F.col("source").alias("_s"), F.col("prefix").alias("edge"), ((F.col("upto") - F.col("rest")) < (F.col("rest") - F.col("before"))).alias("nearer"))
    goal = goal.join(last, F.col("source").eqNullSafe(F.col("_s")), "left")
    return sized, stage(goal.select(F.struct("source", "source_size", "target", "whole", "rest", "edge", "nearer").alias("goal")), "goals")


def apply(docs: DataFrame, share: float = 1.5, most: float = 2.0, cycle: tuple[int, ...] = CYCLE, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mix, all columns, a row for each time one is taken.

    Each row's copies follow from its own hash and source beside the sources' table, so texts aren't shuffled and rows that
    share an id don't multiply.
    """
    _, goal = _plan(docs, share, most, cycle, id_col, text_col, source_col)
    rows = docs.select(F.struct("*").alias("_row"), F.col(source_col).alias("_source"), key_of(id_col).alias("_h"))
    rows = rows.join(goal, F.col("_source").eqNullSafe(F.col("goal.source"))).withColumn("_n", _copies(F.col("_h"), most)).where("_n > 0")
    return rows.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "_n"))).select("_row.*")

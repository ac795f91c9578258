"""Empirical p-values and Benjamini-Hochberg q-values without a window over all rows.

Both reduce to levels (distinct values with counts) first.  Levels are dealt to ``BINS`` ranges; a
window runs within a range, and another over the ranges' totals, of which there are BINS + 1 at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 4096


def _bin(x: Column) -> Column:
    return F.least(F.greatest(F.floor(x * BINS), F.lit(0)), F.lit(BINS))


def _running(levels: DataFrame, by: str, what: str, name: str, descending: bool, inclusive: bool, kind=F.sum, none=0) -> DataFrame:
    """Adds the running ``kind`` of ``what`` along ``by``; levels has a _bin that rises with ``by``."""
    order = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    end = 0 if inclusive else -1
    own = Window.partitionBy("_bin").orderBy(order(by)).rowsBetween(Window.unboundedPreceding, end)
    ranges = levels.groupBy("_bin").agg(kind(what).alias("_all"))
    ranges = ranges.select("_bin", kind("_all").over(Window.orderBy(order("_bin")).rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    joined = levels.join(F.broadcast(ranges), "_bin")
    inside, before = kind(what).over(own), F.col("_before")
    both = F.least(inside, before) if kind is F.min else F.coalesce(inside, F.lit(none)) + F.coalesce(before, F.lit(none))
    return joined.withColumn(name, both).drop("_before")


def empirical_p(scores: DataFrame, null: DataFrame, score: str = "score") -> DataFrame:
    """Adds p_value = (1 + null scores above) / (1 + null scores).  Scores lie in 0..1."""
    rows = scores.groupBy(score).agg(F.lit(0).cast("bigint").alias("n")).unionByName(null.groupBy(score).agg(F.count("*").alias("n")))
    levels = rows.groupBy(score).agg(F.sum("n").alias("n")).withColumn("_bin", _bin(F.col(score)))
    total = levels.agg(F.sum("n").alias("_total"))
    levels = _running(levels, score, "n", "_above", descending=True, inclusive=False).crossJoin(F.broadcast(total))
    return scores.join(levels.select(score, ((F.col("_above") + 1.0) / (F.col("_total") + 1.0)).alias("p_value")), score)


def benjamini_hochberg(rows: DataFrame, p: str = "p_value") -> DataFrame:
    """Adds q_value: p * n / rank, at most 1, and no larger than that of any larger p.  Equal p are one
    level, whose last rank decides."""
    levels = rows.groupBy(p).agg(F.count("*").alias("n")).withColumn("_bin", _bin(F.col(p)))
    total = levels.agg(F.sum("n").alias("_total"))
    levels = _running(levels, p, "n", "_rank", descending=False, inclusive=True).crossJoin(F.broadcast(total))
    levels = levels.withColumn("_raw", F.least(F.col(p) * F.col("_total") / F.col("_rank"), F.lit(1.0)))
    levels = _running(levels, p, "_raw", "q_value", descending=True, inclusive=True, kind=F.min)
    return rows.join(levels.select(p, "q_value"), p)

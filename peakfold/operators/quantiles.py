"""Exact quantiles by distributed selection: count by ranges, keep the range that holds the rank, repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import materialized

#: Distinct values of a group that one task may sort at the end.
FEW = 100_000
#: Ranges into which a round cuts the distinct values that are left of a group.
RANGES = 64
#: Groups whose bounds are broadcast (under 1 kB each); those of more groups are joined.
MOST_GROUPS = 10_000


def exact_quantile(rows: DataFrame, value: str, q: float = 0.5, by: tuple[str, ...] = (), few: int = FEW) -> DataFrame:
    """``by``, n and quantile: the exact quantile of a column, between two values in proportion, for all
    rows (one row) or for each group that has values.

    Nulls in the column do not count; all rows together without values have n 0 and a null quantile.
    NaN is above all numbers.  Null is a group like any other.

    Equal values are counted first, so from then on a value is one row however often it repeats.  A
    round sketches the distinct values that are left of each group, cuts them into ranges of about
    equal size at values of the data, counts the rows of each range and keeps the one that holds the
    rank, so about one in ``RANGES`` goes on whatever the distribution.  The counts are exact, so the
    sketch's error costs time and no result.  A group with at most ``few`` distinct values left is
    sorted.
    """
    if not 0 <= q <= 1:
        raise ValueError("q must be 0 to 1")
    keys = [f"_by{i}" for i in range(len(by))]
    group = [*keys, "_k"]
    levels = rows.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(value).cast("double").alias("_x")).where("_x is not null")
    levels = materialized(levels.groupBy(*keys, "_x").agg(F.count("*").alias("_n")), "levels")
    total = levels.groupBy(*keys).agg(F.sum("_n").alias("n"), F.count("*").alias("_values"))
    total = materialized(total, "sizes")
    place = (F.col("n") - 1) * F.lit(float(q))
    # a target is a group and a rank; _at is the rank among the rows that are left
    targets = total.where("n > 0").select(*keys, "_values", F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))).alias("_k")).withColumn("_at", F.col("_k"))
    left, found = _joined(levels, targets, keys), []
    while True:
        found.append(_sorted(left.where(F.col("_values") <= few), group))
        many = left.where(F.col("_values") > few)
        if many.isEmpty():
            break
        left, done = _round(many.drop("_values"), group)
        found.append(done)
    at_rank = found[0]
    for more in found[1:]:
        at_rank = at_rank.unionByName(more)
    ends = at_rank.groupBy(*keys).agg(F.min_by("_x", "_k").alias("_low"), F.max_by("_x", "_k").alias("_high"))
    out = _joined(total, ends, keys, "left")
    between = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(F.col("_low") + (F.col("_high") - F.col("_low")) * (place - F.floor(place)))
    return out.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], F.coalesce("n", F.lit(0)).alias("n"), between.alias("quantile"))


def _joined(rows: DataFrame, bounds: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Rows with the columns of ``bounds``, null equal to null, broadcast if they are few."""
    few = bounds.limit(MOST_GROUPS + 1).count() <= MOST_GROUPS
    bounds = bounds.select(*[F.col(k).alias(f"{k}_") for k in keys], *[c for c in bounds.columns if c not in keys])
    if few:
        bounds = F.broadcast(bounds)
    if not keys:
        return rows.crossJoin(bounds) if how == "inner" else rows.join(bounds, F.lit(True), how)
    on = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    same = on[0]
    for more in on[1:]:
        same = same & more
    return rows.join(bounds, same, how).drop(*[f"{k}_" for k in keys])


def _holds(at: Column, before: Column, n: Column) -> Column:
    return (before <= at) & (at < before + n)


def _before(n: str, group: list[str], order: str) -> Column:
    return F.coalesce(F.sum(n).over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _sorted(left: DataFrame, group: list[str]) -> DataFrame:
    """The value at each target's rank, of groups that fit into a task."""
    ranked = left.withColumn("_before", _before("_n", group, "_x"))
    return ranked.where(_holds(F.col("_at"), F.col("_before"), F.col("_n"))).select(*group, "_x")


def _round(left: DataFrame, group: list[str]) -> tuple[DataFrame, DataFrame]:
    """The range of each target that holds its rank, and the targets whose range is a single value."""
    x = F.col("_x")
    cuts = left.groupBy(*group).agg(F.array_distinct(F.percentile_approx("_x", [i / RANGES for i in range(RANGES + 1)], 20 * RANGES)).alias("_cuts"))
    # ranges rise: below the first cut, the first cut, between it and the second one, and so on
    spot = F.aggregate("_cuts", F.lit(0), lambda s, c: s + F.when(c < x, 2).when(c == x, 1).otherwise(0))
    placed = _joined(left, materialized(cuts, "cuts"), group).withColumn("_range", spot)
    counts = placed.groupBy(*group, "_at", "_range").agg(F.sum("_n").alias("_rows"), F.count("*").alias("_values"), F.min("_x").alias("_min"), F.max("_x").alias("_max"))
    held = counts.withColumn("_before", _before("_rows", group, "_range")).where(_holds(F.col("_at"), F.col("_before"), F.col("_rows")))
    held = materialized(held.select(*group, (F.col("_at") - F.col("_before")).alias("_new"), "_values", "_min", "_max"), "ranges")
    going = held.where("_min < _max")
    rest = _joined(left, going, group).where("_x BETWEEN _min AND _max").select(*group, "_x", "_n", F.col("_new").alias("_at"), "_values")
    return materialized(rest, "left"), held.where("_min = _max").select(*group, F.col("_min").alias("_x"))

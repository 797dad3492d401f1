"""Exact percentiles by narrowing a range around the wanted rank.

A quantile sketch, whose rank error is bounded, gives each group two values with
the wanted rank between them.  One more pass counts what lies below and, per
value, what lies within.  The task that finishes a group thus holds a fixed
share of its values, not a map of all; counts combine before the shuffle, and a
hot group is spread over tasks by value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rank errors are at most one in ACCURACY of a group's rows; the range is wider by
# MARGIN errors on both sides.
ACCURACY, MARGIN = 20_000, 4


def _same(keys: Sequence[str], place: Sequence[str]) -> Column:
    found = F.lit(True)
    for k, p in zip(keys, place, strict=True):
        found = found & F.col(k).eqNullSafe(F.col(p))
    return found


def narrowed(groups: DataFrame, df: DataFrame, keys: Sequence[str], place: Sequence[str], value: str, share: float,
             accuracy: int) -> DataFrame:
    """Per group, its keys as `place`: how many rows lie below the range (_v null), and
    how many have each value within it.

    `groups` has the keys, _n and the sketch's two values, _range.
    """
    error, large = MARGIN / accuracy, F.col("_n") > accuracy
    # Small groups are counted whole: there an error of less than a rank means little.
    low = F.when(large & F.lit(share > error), F.get("_range", F.lit(0)))
    high = F.when(large & F.lit(share < 1 - error), F.get("_range", F.lit(1)))
    bounds = groups.select(*[F.col(k).alias(p) for k, p in zip(keys, place, strict=True)],
                           low.alias("_low"), high.alias("_high"), "_n")
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")).join(
        bounds, _same(keys, place))
    return rows.where(F.col("_high").isNull() | (F.col("_v") <= F.col("_high"))).groupBy(
        *place, "_n", F.when(F.col("_low").isNull() | (F.col("_v") >= F.col("_low")), F.col("_v")).alias("_v")).agg(
            F.count(F.lit(1)).alias("_count"))


def grouped_percentile(df: DataFrame, keys: Sequence[str], value: str, share: float, name: str,
                       aggregates: Sequence[Column] = (), accuracy: int = ACCURACY) -> DataFrame:
    """Interpolated percentile of a numeric column per group, beside other aggregates.

    Nulls, as values, do not count; a group of nulls alone has null.  Null keys
    are a group.  Values are compared as doubles.
    """
    error, place = MARGIN / accuracy, [f"_k{i}" for i in range(len(keys))]
    around = F.array(F.lit(max(0.0, share - error)), F.lit(min(1.0, share + error)))
    groups = df.groupBy(*keys).agg(*aggregates, F.count(value).alias("_n"),
                                   F.percentile_approx(F.col(value).cast("double"), around, accuracy).alias("_range"))
    # What lies below is the row without a value, which comes first.
    upto = narrowed(groups, df, keys, place, value, share, accuracy).withColumn("_upto", F.sum("_count").over(
        Window.partitionBy(*place).orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0)))
    position = F.lit(share) * (F.col("_n") - 1)

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("_upto") > rank, F.col("_v")))

    found = upto.groupBy(*place, "_n").agg(
        at(F.floor(position)).alias("_before"), at(F.ceil(position)).alias("_after"),
        F.max(F.when(F.col("_v").isNull(), F.col("_count"))).alias("_below"))
    # The sketch keeps its bound; a rank outside of the range must not pass unseen.
    inside = (F.coalesce("_below", F.lit(0)) <= F.floor(position)) & F.col("_after").isNotNull()
    kept = F.when(inside, F.lit(True)).otherwise(F.raise_error("rank outside of the range").cast("boolean"))
    weight = position - F.floor(position)
    between = F.when(weight == 0, F.col("_before")).otherwise((1 - weight) * F.col("_before") + weight * F.col("_after"))
    made = found.select(*place, F.when(kept, between).alias(name))
    return groups.join(made, _same(keys, place), "left").drop(*place, "_n", "_range")

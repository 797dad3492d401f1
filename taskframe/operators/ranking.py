"""Ranks within groups that stay spread out when one group is huge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                  n: int, salt: Sequence[str], salts: int = 64) -> DataFrame:
    """The first `n` rows of every group, exactly.

    The limit is taken per (group, salt) before it is taken per group, so a
    group of any size reaches its last task as at most `salts * n` rows.
    Spark also applies each limit ahead of its shuffle.
    """
    salted = df.withColumn(
        "_salt", F.pmod(F.xxhash64(*salt), F.lit(salts)).cast("int"))
    for parts in ([*keys, "_salt"], list(keys)):
        window = Window.partitionBy(*parts).orderBy(*order)
        salted = (
            salted.withColumn("_rank", F.row_number().over(window))
            .filter(F.col("_rank") <= n).drop("_rank"))
    return salted.drop("_salt")


def positions(df: DataFrame, key: str, order: Sequence[str], name: str,
              hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add the 0-based position of each row within its group.

    Groups up to `hot_rows` rows are numbered whole.  Larger ones are first cut,
    in sort order, into ranges of the two leading order columns (the second must
    be numeric); each range is numbered by itself and shifted by the rows of the
    ranges before it.  One window serves both.
    """
    first, second = order[0], order[1]
    # At most one row for every `hot_rows` rows of `df`, so it is broadcast: the
    # rows need no shuffle to find out whether their group is large, and what is
    # done for large groups alone is not begun without one.
    hot = F.broadcast(
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("_rows"), F.min(second).alias("_low"),
             F.max(second).alias("_high"))
        .filter(F.col("_rows") > hot_rows)
        .withColumn("_width", F.greatest(
            (F.col("_high") - F.col("_low") + 1) / F.ceil(F.col("_rows") / F.lit(hot_rows)), F.lit(1e-9)))
        .select(key, "_low", "_width"))
    cut_at = F.coalesce(F.floor((F.col(second) - F.col("_low")) / F.col("_width")), F.lit(-1))

    # Null outside large groups.  A struct, so that null values of `first` meet each other.
    piece = F.struct(F.col(first).alias("first"), cut_at.alias("range"))
    marked = df.join(hot, key, "left").select(
        *df.columns, F.when(F.col("_width").isNotNull(), piece).alias("_piece"))
    within = Window.partitionBy(key, "_piece").orderBy(*order)
    numbered = marked.withColumn(name, F.row_number().over(within) - 1)

    sizes = df.join(hot, key).groupBy(key, piece.alias("_piece")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(
        key, "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    return numbered.join(shifts, [key, "_piece"], "left").select(
        *df.columns, (F.col(name) + F.coalesce("_shift", F.lit(0))).alias(name))

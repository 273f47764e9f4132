"""Exact medians and bounded prefixes for groups of any size.

A group may hold a third of all rows, so its rows are never gathered in one task: they are first counted per penny
with map-side combine, and the middle is found from those counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titletide.functions.numbers import pennies

def penny_counts(df: DataFrame, keys: list[str], amount: Column) -> DataFrame:
    """How often each amount occurs in each group; the only step that sees every row."""
    return df.groupBy(*keys, pennies(amount).alias("penny")).agg(F.count(F.lit(1)).alias("n"))


def middle_of_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, copies, low, high and ``twice`` the exact median of counted whole numbers (``penny``, ``n``).

    A group is as many rows as it has different values, never as many as the rows behind them; those rows are
    sorted and summed up in passing, and can spill. The row that holds the middle gives the group's, so the groups are
    not gathered again.
    """
    group = Window.partitionBy(*keys)
    ordered = group.orderBy("penny").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (
        counts.withColumn("upto", F.sum("n").over(ordered))
        .withColumn("next", F.lead("penny").over(group.orderBy("penny")))
        .withColumn("copies", F.sum("n").over(group))
        .withColumn("low", F.min("penny").over(group))
        .withColumn("high", F.max("penny").over(group))
    )
    first, second = F.expr("(copies + 1) div 2"), F.expr("(copies + 2) div 2")
    holds = (F.col("upto") - F.col("n") < first) & (F.col("upto") >= first)
    other = F.when(F.col("upto") >= second, F.col("penny")).otherwise(F.col("next"))
    return ranked.where(holds).select(*keys, "copies", "low", "high", (F.col("penny") + other).alias("twice"))


def median_of_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, copies, lowest and median from penny counts; the median is exact, half a penny up. A count without a
    penny gives its copies alone."""
    return middle_of_counts(counts, keys).select(
        *keys, "copies", (F.col("low") / 100.0).alias("lowest"),
        (F.floor((F.col("twice") + 1) / 2) / 100.0).alias("median"))


def group_medians(df: DataFrame, keys: list[str], amount: Column) -> DataFrame:
    """keys, copies, lowest and exact median of an amount per group."""
    return median_of_counts(penny_counts(df, keys, amount), keys)


def keep_first(df: DataFrame, group: Column, n: Column, buckets: list[Column], order: list[Column]) -> DataFrame:
    """The first ``n`` rows of each group (few groups, any size) in the order of ``buckets`` then ``order``.

    No global sort and no single-task window: each bucket (ascending, few distinct values) is
    counted, whole buckets stay or go, and only the bucket on the boundary is split further. The
    last step ranks rows inside one cell of the last bucket. ``df`` is read several times, so it
    should be a table or a checkpoint.
    """
    rows = df.withColumn("_group", group).withColumn("_room", n.cast("bigint"))
    kept = None
    for bucket in buckets:
        tagged = rows.withColumn("_bucket", bucket)
        counts = tagged.groupBy("_group", "_bucket").agg(
            F.count(F.lit(1)).alias("_n"), F.first("_room").alias("_limit"))
        running = Window.partitionBy("_group").orderBy("_bucket").rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        cells = (
            counts.withColumn("_upto", F.sum("_n").over(running))
            .withColumn("_left", F.col("_limit") - (F.col("_upto") - F.col("_n")))
            .where(F.col("_left") > 0)
            .select("_group", "_bucket", F.col("_n").alias("_cell"), "_left")
        )
        joined = tagged.join(cells, ["_group", "_bucket"]).drop("_bucket")
        whole = joined.where(F.col("_cell") <= F.col("_left")).drop("_cell", "_left", "_room")
        kept = whole if kept is None else kept.unionByName(whole)
        rows = (
            joined.where(F.col("_cell") > F.col("_left"))
            .drop("_room", "_cell")
            .withColumnRenamed("_left", "_room")
        )
    last = (
        rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_group").orderBy(*order)))
        .where(F.col("_rank") <= F.col("_room"))
        .drop("_rank", "_room")
    )
    return (last if kept is None else kept.unionByName(last)).drop("_group")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group. Spark trims each group before the shuffle, so a hot group
    costs ``k`` rows a task."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(
        F.col(rank) <= k)

"""Sets and multisets of rows or features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from trivane.functions.states import ratio


def dedupe_first(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """The first row by position of each key."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(pos))).where("_r = 1").drop("_r")


def multiset(items: DataFrame, unit: str, item: str, side: str, left: str, right: str) -> DataFrame:
    """Per unit and item its counts on both sides, in one aggregation."""
    count = lambda s: F.count(F.when(F.col(side) == s, F.lit(1)))
    return items.where(F.col(side).isin(left, right)).groupBy(unit, item).agg(count(left).alias("n_left"), count(right).alias("n_right"))


def multiset_sizes(counts: DataFrame, unit: str) -> DataFrame:
    """Per unit the sizes of both multisets, their intersection and what right lacks of left and left of right."""
    low = F.least("n_left", "n_right")
    return counts.groupBy(unit).agg(
        F.sum("n_left").alias("left"), F.sum("n_right").alias("right"), F.sum(low).alias("common"), F.sum(F.col("n_left") - low).alias("left_only"), F.sum(F.col("n_right") - low).alias("right_only")
    )


def recall(counts: DataFrame, unit: str) -> DataFrame:
    """Share of the right multiset that the left one has; with nothing on the right 1 if the left is empty too, else 0."""
    s = multiset_sizes(counts, unit)
    return s.select(unit, "left", "right", "common", F.coalesce(ratio("common", "right"), F.when(F.col("left") == 0, 1.0).otherwise(0.0)).alias("recall"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def key_algebra(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: sizes of the union, the intersection and both differences of two key sets; one shuffle of keys."""
    x = a.select(key, F.lit(1).alias("_a"), F.lit(0).alias("_b")).union(b.select(key, F.lit(0), F.lit(1)))
    k = x.groupBy(key).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    n = lambda c: F.count(F.when(c, F.lit(1)))
    p, q = F.col("_a") == 1, F.col("_b") == 1
    return k.agg(F.count(F.lit(1)).alias("n_union"), n(p & q).alias("n_both"), n(p & ~q).alias("n_left_only"), n(~p & q).alias("n_right_only"))

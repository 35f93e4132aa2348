"""Checks as queries: each returns the rows that break a rule, and nothing if all is well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def table_differences(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float = 1e-12) -> DataFrame:
    """Cells in which two tables differ, by key: column, left and right as text. Equal are equal values, two nulls, two NaN,
    and numbers within tolerance; a row on one side alone differs in the column '(row)'."""
    values = [c for c in a.columns if c not in keys]
    if sorted(values) != sorted(c for c in b.columns if c not in keys):
        raise ValueError("the tables have different columns")
    kinds = dict(a.dtypes)
    x = a.withColumn("_a", F.lit(True)).alias("x").join(b.withColumn("_b", F.lit(True)).alias("y"), keys, "full_outer")

    def differs(c: str) -> Column:
        l, r = F.col(f"x.{c}"), F.col(f"y.{c}")  # noqa: E741
        same = l.eqNullSafe(r)
        if kinds[c] in ("double", "float") or kinds[c].startswith("decimal"):
            same = same | F.coalesce(F.abs(l - r) <= tolerance, F.lit(False))
        return ~same

    both = F.col("_a") & F.col("_b")
    cells = [F.when(F.coalesce(both, F.lit(False)) & differs(c), F.struct(F.lit(c).alias("column"), F.col(f"x.{c}").cast("string").alias("left"), F.col(f"y.{c}").cast("string").alias("right"))) for c in values]
    row = F.when(~F.coalesce(both, F.lit(False)), F.struct(F.lit("(row)").alias("column"), F.col("_a").cast("string").alias("left"), F.col("_b").cast("string").alias("right")))
    return x.select(*keys, F.explode(F.array_compact(F.array(row, *cells))).alias("_d")).select(*keys, "_d.*")


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each row and rule that doesn't hold; an unknown outcome counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return df.select(key, F.explode(broken).alias("rule"))


def coverage_gaps(df: DataFrame, config: list[str], task: str) -> DataFrame:
    """Configurations that don't have each task exactly once: rows, tasks and the tasks there are."""
    every = df.agg(F.countDistinct(task).alias("all_tasks"))
    per = df.groupBy(*config).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(task).alias("tasks"))
    return per.crossJoin(F.broadcast(every)).where((F.col("rows") != F.col("tasks")) | (F.col("tasks") != F.col("all_tasks")))


def score_mismatches(wide: DataFrame, key: str, long: DataFrame, metrics: list[str], tolerance: float = 1e-12) -> DataFrame:
    """Scores shown in a wide sheet that differ from those in the records (key, metric, score)."""
    shown = wide.select(key, *[F.col(f"{m}_score").alias(m) for m in metrics]).unpivot([key], metrics, "metric", "shown")
    x = shown.join(long.select(key, "metric", "score"), [key, "metric"], "full_outer")
    same = F.col("shown").eqNullSafe(F.col("score")) | F.coalesce(F.abs(F.col("shown") - F.col("score")) <= tolerance, F.lit(False))
    return x.where(~same)


def stratified_first(df: DataFrame, strata: list[str], order: str) -> DataFrame:
    """The first row of each stratum, for audits."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*strata).orderBy(order))).where("_r = 1").drop("_r")


def conserved(df: DataFrame, parts: list[str], total: str) -> DataFrame:
    """Rows whose parts don't add up to their total."""
    return df.where(reduce(lambda a, b: a + b, [F.col(p) for p in parts]) != F.col(total))

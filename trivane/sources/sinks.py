"""Sinks: tables that are never overwritten by chance, numbers that never leave as NaN, wide score sheets, caches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trivane.functions.states import finite_or_null


def write_new(df: DataFrame, path: str, columns: list[str], fmt: str = "csv") -> None:
    """Exactly these columns, in this order, to a path that must not exist."""
    w = df.select(*columns).write.mode("errorifexists")
    w.csv(path, header=True, nullValue="") if fmt == "csv" else w.format(fmt).save(path)


def without_nan(df: DataFrame) -> DataFrame:
    """NaN and infinities as null in all floating columns, so that they are written as empty cells."""
    return df.withColumns({c: finite_or_null(c) for c, t in df.dtypes if t in ("double", "float")})


def union_of_keys(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames under the union of their columns, in the order of first appearance."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; the committer moves files into place only when all tasks are done."""
    df.write.mode("errorifexists").json(path)


def wide_scores(long: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """One row per key: <metric>_score for all metrics, then <metric>_status; the metrics are given, so no extra pass."""
    g = long.groupBy(key).pivot("metric", metrics).agg(F.first("score", ignorenulls=True).alias("score"), F.first("status", ignorenulls=True).alias("status"))
    return g.select(key, *[f"{m}_score" for m in metrics], *[f"{m}_status" for m in metrics])


def thousands(x: Column) -> Column:
    return F.format_number(x, 0)


def percent(x: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", 100 * x)


def latex_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of a LaTeX table as text in a column row."""
    return df.select(F.concat(F.concat_ws(" & ", *[F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("--")), r"([%&_#$])", r"\\\\$1") for c in columns]), F.lit(r" \\")).alias("row"))


def cache_misses(requests: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Requests that the cache can't answer, each key once."""
    return requests.dropDuplicates([key]).join(cache.select(key), key, "left_anti")


def cached(requests: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    return requests.join(cache, key, "left")


def append(df: DataFrame, path: str) -> None:
    """Append-only tables: manifests, caches, ledgers."""
    df.write.mode("append").parquet(path)


def file_safe(name: Column) -> Column:
    """A name usable as a file name: :: and / are replaced."""
    return F.replace(F.replace(name, F.lit("::"), F.lit("__")), F.lit("/"), F.lit("_"))


def last_segment(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)

"""Ranked and running operators, each over a stated order; caps of groups use rank filters that Spark limits early."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window as W

from trivane.session import ship, stored


def _ranked(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def first_qualifying(df: DataFrame, keys: list[str], order: list, cond: Column) -> DataFrame:
    return _ranked(df.where(cond), keys, order).where("_rank = 1").drop("_rank")


def first_n(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """At most n rows per group in order, with their rank from 1."""
    return _ranked(df, keys, order).where(F.col("_rank") <= n).withColumn("rank", F.col("_rank").cast("long")).drop("_rank")


def capped(df: DataFrame, inner: list[str], outer: list[str], order: list, per_inner: int, per_outer: int) -> DataFrame:
    """At most per_inner rows of an inner group, and of these at most per_outer of an outer one."""
    return first_n(first_n(df, inner, order, per_inner).drop("rank"), outer, order, per_outer)


def budget_sample(df: DataFrame, family: str, order: list, per_family: int, total: int, unit: list[str]) -> DataFrame:
    """Per unit the first per_family rows of each family, then rows round-robin over the families up to total.

    In round-robin order a row's turn is its rank in its family, so both parts are one order: (chosen first, turn, family)."""
    r = _ranked(df, [*unit, family], order).withColumnRenamed("_rank", "turn")
    late = F.when(F.col("turn") > per_family, 1).otherwise(0)
    out = _ranked(r, unit, [late, "turn", family]).withColumnRenamed("_rank", "picked")
    return out.where(F.col("picked") <= total).withColumn("turn", F.col("turn").cast("long")).withColumn("picked", F.col("picked").cast("long"))


def midranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Ranks in which ties share their average: from the numbers of rows with lower values, summed over distinct values."""
    n = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    low = running_sums(n, keys, [value], {"_less": "_n"})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*keys, value)]
    low = low.select(*[F.col(c).alias(f"_{c}") for c in (*keys, value)], (F.col("_less") + 1 + (F.col("_n") - 1) / 2).alias("midrank"))
    return df.join(low, same).drop(*[f"_{c}" for c in (*keys, value)])


def running_ordinal(df: DataFrame, keys: list[str], order: list[str], counted: Column) -> DataFrame:
    """How many counted rows there are up to each row, by a total order; null for rows that are not counted."""
    out = running_sums(df.withColumn("_c", F.when(counted, 1).otherwise(0)), keys, order, {"_before": "_c"})
    return out.withColumn("ordinal", F.when(F.col("_c") == 1, F.col("_before") + 1).cast("long")).drop("_c", "_before")


def last_k(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The k last rows of each group, 1 being the last; order gives descending keys."""
    return first_n(df, keys, order, k)


def earlier_any(df: DataFrame, keys: list[str], order: list[str], flag: Column) -> DataFrame:
    """Whether the flag held for an earlier row of the group: one that comes after the group's first row with it."""
    first = df.where(flag).groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min(F.struct(*order)).alias("_first"))
    out = df.join(first, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
    return out.withColumn("earlier", F.coalesce(F.struct(*order) > F.col("_first"), F.lit(False))).drop("_first", *[f"_{k}" for k in keys])


def bands(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Alternating bands for rows of equal rank, the last being plain."""
    rank = F.dense_rank().over(W.partitionBy(*keys).orderBy(value))
    return df.withColumn("_d", rank).withColumn("banded", (F.max("_d").over(W.partitionBy(*keys)) - F.col("_d")) % 2 == 1).drop("_d")


def split_point(df: DataFrame, keys: list[str], pos: str, weight: str) -> DataFrame:
    """Where to cut a sequence in two so that the parts' weights differ least; the first such place."""
    run = F.sum(weight).over(W.partitionBy(*keys).orderBy(pos).rowsBetween(W.unboundedPreceding, 0))
    x = df.withColumn("_left", run).withColumn("_all", F.sum(weight).over(W.partitionBy(*keys))).withColumn("difference", F.abs(2 * F.col("_left") - F.col("_all")))
    return _ranked(x, keys, ["difference", pos]).where("_rank = 1").select(*keys, F.col(pos).alias("split"), "difference")


def last_per_version(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Upsert as a query: the newest row of each key."""
    return _ranked(df, keys, order).where("_rank = 1").drop("_rank")


def positions(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """A total order's row numbers from 1 without one task that sees all rows.

    Rows are dealt out by range and sorted in their parts; a row's number is its place in its part plus the rows of the parts
    before. The sorted parts are written once, as a second computation might cut the ranges elsewhere."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    rows = stored(rows, "positions").withColumn("_part", F.shiftright("_id", 33))
    n = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = n.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(before, "_part").withColumn(name, place).drop("_part", "_id", "_before")


def running_sums(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """For each row the sums (by new name, the number summed) over the rows before it in its group, by a total order.

    Rows are dealt out by range of group and order, so that a group of any size is spread over tasks, summed within their part
    and written once. Of the groups of a part only the first can begin in a part before, so what was summed before is one row
    for each part."""
    spark = df.sparkSession
    ship(spark)
    names = list(sums)
    # Names of own columns that no column of the table begins with.
    own = "_"
    while any(c.startswith(own) for c in (*df.columns, *names)):
        own += "_"
    key_, part_, row_ = f"{own}key", f"{own}part", f"{own}row"
    kinds = ["double" if df.schema[c].dataType.simpleString() in ("double", "float") else "long" for c in sums.values()]
    cols = df.withColumn(key_, F.xxhash64(*[F.col(k) for k in keys]) if keys else F.lit(0).cast("long"))
    for i, (c, kind) in enumerate(zip(sums.values(), kinds, strict=True)):
        cols = cols.withColumn(f"{own}v{i}", F.coalesce(F.col(c).cast(kind), F.lit(0).cast(kind)))
    cols = cols.repartitionByRange(*[F.col(c) for c in (*keys, *order)]).sortWithinPartitions(*keys, *order)
    at = len(df.columns)
    schema = StructType([*df.schema.fields, *[StructField(f"{own}v{i}", cols.schema[f"{own}v{i}"].dataType) for i in range(len(names))], *[StructField(n, cols.schema[f"{own}v{i}"].dataType) for i, n in enumerate(names)], StructField(key_, LongType()), StructField(part_, IntegerType()), StructField(row_, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, last, carried = TaskContext.get().partitionId(), 0, None, [0] * len(names)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            key = b.column(at).to_numpy()
            new = np.append(key[0] != last, key[1:] != key[:-1])
            begin = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            made = []
            for i in range(len(names)):
                v = b.column(at + 1 + i).to_numpy()
                before = np.cumsum(v) - v
                # Rows of the group that goes on from the batch before have what it carried.
                before = np.where(begin >= 0, before - before[np.maximum(begin, 0)], before + carried[i])
                carried[i] = before[-1] + v[-1]
                made.append(pa.array(before.astype(v.dtype)))
            last = key[-1]
            rows = [pa.array(np.full(n, part, dtype=np.int32)), pa.array(np.arange(row, row + n))]
            row += n
            yield pa.RecordBatch.from_arrays([*b.columns[:at], *b.columns[at + 1 :], *made, b.column(at), *rows], names=schema.fieldNames())

    rows = stored(cols.mapInArrow(run, schema), "running")
    ends = rows.groupBy(F.col(part_).alias("part")).agg(F.min_by(key_, row_).alias("first"), F.max_by(key_, row_).alias("last"), *[F.max_by(F.col(n) + F.col(f"{own}v{i}"), row_).alias(f"s{i}") for i, n in enumerate(names)])
    carry, before, key = [0] * len(names), [], None
    for r in sorted(ends.collect(), key=lambda r: r["part"]):
        mine = carry if r["first"] == key else [0] * len(names)
        if any(mine):
            before.append((r["part"], r["first"], *mine))
        alone = r["first"] == r["last"]
        carry = [r[f"s{i}"] + (mine[i] if alone else 0) for i in range(len(names))]
        key = r["last"]
    out = rows
    if before:
        parts = spark.createDataFrame(before, StructType([StructField(part_, IntegerType()), StructField(key_, LongType()), *[StructField(f"{own}b{i}", rows.schema[n].dataType) for i, n in enumerate(names)]]))
        out = rows.join(F.broadcast(parts), [part_, key_], "left")
        for i, n in enumerate(names):
            out = out.withColumn(n, F.col(n) + F.coalesce(F.col(f"{own}b{i}"), F.lit(0).cast(kinds[i])))
    return out.select(*df.columns, *names)

"""Sharding by a hierarchical weighted hash tree, with DataFrame functions alone.

A row descends region, rack and shard. At each level every child makes a draw -ln(u) / weight from a hash u of the key
and the child's place, and the smallest draw wins (weighted rendezvous). A child's draw depends on its own weight and on
nothing else, so a change of one weight moves rows only into or out of the subtree it belongs to.

Null keys count as one key of their own, repeated keys share a shard, null texts have no bytes. An empty table gives an
empty result. Extra columns are not read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from trivane.llm.common import stored, unit_interval
from trivane.operators.windows import positions

#: Shards in the complete tree; each shard beyond them is a region with one rack and one shard.
BASE = 40
RACKS, PER_RACK = 4, 5
OVERHEAD = 16


@dataclass(frozen=True)
class Tree:
    """weights[region][rack][shard]; a rack's weight is the sum of its shards', a region's that of its racks'."""

    weights: tuple[tuple[tuple[float, ...], ...], ...]

    def shards(self) -> int:
        return sum(len(k) for r in self.weights for k in r)


def layout(shards: int, base: int = BASE, racks: int = RACKS, per_rack: int = PER_RACK) -> Tree:
    """Equal shards: the first base of them in full regions, every further one in a region of its own.

    So each growth by one adds one subtree at the top, and rows move only into it."""
    out, left = [], min(shards, base)
    while left > 0:
        region = []
        while left > 0 and len(region) < racks:
            region.append((1.0,) * min(per_rack, left))
            left -= per_rack
        out.append(tuple(region))
    return Tree(tuple(out + [((1.0,),)] * max(0, shards - base)))


def _arr(x) -> Column:
    return F.array(*[_arr(y) for y in x]) if isinstance(x, (list, tuple)) else F.lit(x)


def _draw(key: Column, level: str, place: list[Column], child: Column, weight: Column) -> Column:
    u = unit_interval(key, F.lit(level), *place, child) + 2.0**-53
    return F.when(weight > 0, F.struct((-F.log(u) / weight).alias("d"), child.cast("int").alias("c")))


def _pick(key: Column, level: str, place: list[Column], weights: Column) -> Column:
    return F.array_min(F.filter(F.transform(weights, lambda w, i: _draw(key, level, place, i, w)), lambda x: x.isNotNull()))["c"]


def assign(df: DataFrame, key: str, tree: Tree, out: str) -> DataFrame:
    """df with the column out: the shard of each row's key in tree."""
    racks = [[float(sum(k)) for k in r] for r in tree.weights]
    first, at = [], 0
    for r in tree.weights:
        first.append([])
        for k in r:
            first[-1].append(at)
            at += len(k)
    k = F.col(key)
    df = df.withColumn("_region", _pick(k, "region", [], _arr([float(sum(r)) for r in racks])))
    df = df.withColumn("_rack", _pick(k, "rack", [F.col("_region")], F.element_at(_arr(racks), F.col("_region") + 1)))
    leaf = F.element_at(F.element_at(_arr(tree.weights), F.col("_region") + 1), F.col("_rack") + 1)
    df = df.withColumn("_leaf", _pick(k, "shard", [F.col("_region"), F.col("_rack")], leaf))
    start = F.element_at(F.element_at(_arr(first), F.col("_region") + 1), F.col("_rack") + 1)
    return df.withColumn(out, (start + F.col("_leaf")).cast("int")).drop("_region", "_rack", "_leaf")


def shard(documents: DataFrame, shards: int = BASE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (with one shard more) of every row.

    Slots count up from 0 in each shard, by a hash of the key, then the key, checksum and size; rows equal in all of them
    take neighbouring slots in either order. Texts are read once; what is shuffled is a narrow row for each document."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (F.length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = assign(assign(rows, "doc_id", layout(shards), "shard"), "doc_id", layout(shards + 1), "grown_shard")
    # Rows are numbered in one order over all shards, cut by range: a shard, or an id that very many rows share, is spread over tasks.
    rows = stored(rows.withColumn("_u", unit_interval(F.col("doc_id"), F.lit("slot"))).withColumn("_tie", F.monotonically_increasing_id()), "shards")
    placed = positions(rows, ["shard", "_u", "doc_id", "text_crc32", "size", "_tie"], "_position")
    over = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # over one row for each shard
    sizes = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("_n"))
    before = stored(sizes.select("shard", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_before")), "before")
    out = placed.join(F.broadcast(before), "shard")  # as many rows as there are shards
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_position") - 1 - F.col("_before")).cast("long").alias("slot"), "grown_shard")

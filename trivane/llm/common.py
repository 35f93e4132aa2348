"""What the operators of this subpackage share: shared storage, tables, sorted groups, blocked bucket joins, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trivane.session import shared_dir, ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/trivane-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._trivane_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables written by stored() that no later plan reads."""
    for df in frames:
        path = getattr(df, "_trivane_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: str, folds: int, fold: int) -> Column:
    """crc32 of the id written as text, modulo folds, is fold. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == fold


def unit_interval(*cols: Column) -> Column:
    """A uniform number in [0, 1) from the first 52 bits of md5 over the columns as text, joined by '|'."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: list[str], target: int = 4096) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Chunks of whole groups from batches sorted by keys: a table and the offsets of its groups, the end included.

    A chunk has about target rows, or one group if that is larger."""
    pending: list[pa.RecordBatch] = []
    rows = 0

    def bounds(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, dtype=bool)
        new[:1] = True
        for k in keys:
            v = t.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for b in batches:
        if not b.num_rows:
            continue
        pending.append(b)
        rows += b.num_rows
        if rows >= target:
            t = pa.Table.from_batches(pending).combine_chunks()
            at = bounds(t)
            if len(at) > 1:
                yield t.slice(0, at[-1]), at
                t = t.slice(at[-1])
                pending, rows = t.to_batches(), t.num_rows
            else:
                target = 2 * rows
    if rows:
        t = pa.Table.from_batches(pending).combine_chunks()
        yield t, np.append(bounds(t), t.num_rows)


def bucket_sizes(members: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """(keys, _n, _w): rows and weight of the buckets of two rows or more, written out.

    Read back, it is a plain side of a join, so that Spark may split a bucket that holds very many rows among tasks."""
    total = F.sum(weight) if weight else F.lit(0)
    return stored(members.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), total.cast("double").alias("_w")).where("_n > 1"), "sizes")


def in_blocks(members: DataFrame, keys: list[str], spread: Column, block: int, weight: str | None = None, most: int = 1 << 25) -> DataFrame:
    """Deal the rows of each bucket (keys) out to units of at most two blocks, so that any two rows meet in one unit.

    A bucket is cut by the hash spread into blocks of about block rows, and of a weight of about most, if there is one; a
    unit (_i, _j) holds blocks _i and _j, and _b is a row's own block. Buckets of one row are left out: they hold no pair.
    Rows that have their bucket's size already, in _n, aren't counted again."""
    if "_n" not in members.columns:
        members = members.join(bucket_sizes(members, keys, weight), keys)
    else:
        members = members.withColumn("_w", F.lit(0.0))
    nb = F.ceil(F.greatest(F.col("_n") / block, F.col("_w") / most)).cast("int")
    m = members.withColumn("_nb", F.greatest(nb, F.lit(1))).withColumn("_b", F.pmod(spread, F.col("_nb")).cast("int"))
    m = m.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    m = m.withColumn("_i", F.least("_b", "_o")).withColumn("_j", F.greatest("_b", "_o")).drop("_n", "_w", "_nb", "_o")
    unit = [*keys, "_i", "_j"]
    return m.repartition(partitions(m.sparkSession), *unit).sortWithinPartitions(*unit)


def unit_pairs(own: np.ndarray, i: int, j: int, most: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the rows of a unit, about most at a time: all pairs of one block, or those across two."""
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    step = max(1, most // max(1, len(right)))
    for s in range(0, len(left), step):
        a, b = np.repeat(left[s : s + step], len(right)), np.tile(right, len(left[s : s + step]))
        if i == j:
            keep = a < b
            a, b = a[keep], b[keep]
        if len(a):
            yield a, b


def matrix(column: pa.ChunkedArray | pa.Array, dtype, width: int | None = None) -> np.ndarray:
    """A binary column as a matrix, a row for each value."""
    raw = b"".join(column.to_pylist())
    flat = np.frombuffer(raw, dtype=dtype)
    return flat.reshape(len(column), width if width is not None else -1)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of each component of the graph on 0..n-1 with edges a-b."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        keep = ra != rb
        if not keep.any():
            break
        a, b, ra, rb = a[keep], b[keep], ra[keep], rb[keep]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): root is the smallest node reachable over the edges; nodes without an edge are left out.

    Alternating large-star and small-star rounds (Kiveris et al. 2014), each a grouped minimum and a join, so that a
    node with very many neighbours is one skewed join key and never a collected list. The minima are written before they
    are joined: both sides are then plain, and Spark may split such a node's edges among tasks."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = stored(e, "edges")
    last = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = stored(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        new = stored(small, "edges")
        state = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1000003)).first()
        # Done when the edges stay the same; equal sums may be chance, so then the edges themselves are compared.
        done = state == last and new.join(e, ["u", "v"], "left_anti").isEmpty()
        discard(e, low, large, least)
        e, last = new, state
        if done:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow; functions that name columns get them by name, names that hold a dot are replaced by positions."""
    ship(df.sparkSession)
    if any("." in c or "`" in c for c in df.columns):
        df = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    return df.mapInArrow(fn, schema)

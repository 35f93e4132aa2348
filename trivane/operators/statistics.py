"""Rank association with cluster bootstrap intervals, in set form: values are grouped, never paired.

A pair of rows is concordant if the accepted one has the higher value. Counts of pairs come from running sums over the
distinct values: with a accepted and b other rows at a value, and B others below it, concordant += a B, tied in value
(across) += a b. So the cost is a sort of the distinct values and not the square of the rows."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window as W

from trivane.functions.states import long_if
from trivane.operators.windows import positions, running_sums
from trivane.session import ship


def by_value(df: DataFrame, keys: list[str], value: str, accepted: Column, weight: str | None = None) -> DataFrame:
    """Per key and known value: accepted rows a and other rows b, or the sums of their weights."""
    known = df.where(F.col(value).isNotNull())
    if weight:
        return known.groupBy(*keys, value).agg(F.sum(F.when(accepted, F.col(weight)).otherwise(0)).alias("a"), F.sum(F.when(accepted, 0).otherwise(F.col(weight))).alias("b"))
    return known.groupBy(*keys, value).agg(long_if(accepted).alias("a"), long_if(~accepted).alias("b"))


def pair_counts(grouped: DataFrame, keys: list[str], value: str) -> DataFrame:
    """concordant, discordant, t_acc (within an acceptance group, values differ), t_met (across, values equal)."""
    x = running_sums(grouped, keys, [value], {"_below": "b"})
    a, b = F.col("a"), F.col("b")
    both = lambda c: c * (c - 1) / 2
    s = x.groupBy(*keys).agg(F.sum(a * F.col("_below")).alias("concordant"), F.sum(a * b).alias("t_met"), F.sum("a").alias("n_acc"), F.sum("b").alias("n_other"), F.sum(both(a) + both(b)).alias("_same"))
    n, m = F.col("n_acc"), F.col("n_other")
    s = s.withColumn("discordant", n * m - F.col("concordant") - F.col("t_met")).withColumn("t_acc", (both(n) + both(m) - F.col("_same")).cast("long"))
    return s.select(*keys, "n_acc", "n_other", "concordant", "discordant", "t_acc", "t_met")


def tau_b(c: str = "concordant", d: str = "discordant", ta: str = "t_acc", tm: str = "t_met") -> Column:
    """Kendall's tau-b of counted pairs, null where it is undefined."""
    c, d, ta, tm = (F.col(x).cast("double") for x in (c, d, ta, tm))
    den = F.sqrt((c + d + ta) * (c + d + tm))
    return F.when(den > 0, (c - d) / den)


def rank_tau(df: DataFrame, keys: list[str], value: str, accepted: Column) -> DataFrame:
    """tau-b by midrank sums: (2U - n1 n0) / sqrt(n1 n0 untied); the second formulation, to check the first."""
    g = by_value(df, keys, value, accepted).withColumn("_n", F.col("a") + F.col("b"))
    g = running_sums(g, keys, [value], {"_below": "_n"})
    g = g.withColumn("_rank", (2 * F.col("_below") + F.col("_n") + 1) / 2)
    s = g.groupBy(*keys).agg(F.sum(F.col("_rank") * F.col("a")).alias("_r"), F.sum("a").alias("n1"), F.sum("b").alias("n0"), F.sum(F.col("_n") * (F.col("_n") - 1)).alias("_t"))
    n1, n0 = F.col("n1"), F.col("n0")
    u = F.col("_r") - n1 * (n1 + 1) / 2
    untied = ((n1 + n0) * (n1 + n0 - 1) - F.col("_t")) / 2
    den = F.sqrt(n1.cast("double") * n0 * untied)
    return s.select(*keys, F.when(den > 0, (2 * u - n1 * n0) / den).alias("tau"))


def phi(df: DataFrame, keys: list[str], x: Column, y: Column) -> DataFrame:
    """Correlation of two conditions from their 2x2 table, with its counts."""
    out = df.groupBy(*keys).agg(long_if(x & y).alias("n11"), long_if(x & ~y).alias("n10"), long_if(~x & y).alias("n01"), long_if(~x & ~y).alias("n00"))
    a, b, c, d = (F.col(n).cast("double") for n in ("n11", "n10", "n01", "n00"))
    den = F.sqrt((a + b) * (c + d) * (a + c) * (b + d))
    return out.withColumn("phi", F.when(den > 0, (a * d - b * c) / den))


def best_grouped(grouped: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The same values with acceptance given to the highest ones: of each value, what of the accepted is left by higher ones."""
    g = running_sums(grouped.withColumn("_n", F.col("a") + F.col("b")), keys, [value], {"_below": "_n"})
    total = g.groupBy(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]).agg(F.sum("a").alias("_acc"), F.sum("_n").alias("_all"))
    g = g.join(total, functools.reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)], F.lit(True)))
    g = g.withColumn("_above", F.col("_all") - F.col("_below") - F.col("_n"))
    a = F.greatest(F.lit(0), F.least(F.col("_n"), F.col("_acc") - F.col("_above")))
    return g.select(*keys, value, a.alias("a"), (F.col("_n") - a).alias("b"))


def within(df: DataFrame, keys: list[str], cluster: str, value: str, accepted: Column) -> DataFrame:
    """Pair counts inside clusters, added up."""
    c = pair_counts(by_value(df, [*keys, cluster], value, accepted), [*keys, cluster], value)
    names = ("concordant", "discordant", "t_acc", "t_met")
    if not keys:
        return c.agg(*[F.sum(n).alias(n) for n in names])
    return c.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])


#: Positions of a group whose draws are made together, and whose weights are put together.
CHUNK, SEGMENT = 1 << 16, 1 << 12


def weights(sizes: DataFrame, keys: list[str], replicates: int, salt: str) -> DataFrame:
    """(keys, _k, w): how often each replicate draws position _k of a group of _n, as an array over the replicates.

    Draw i of a replicate takes the position that an md5 number of replicate and i gives modulo _n, the same in every engine.
    Draws are made by replicate and chunk of i and travel packed, by segment of the positions, so the rows that move don't
    become more with the replicates' draws; positions that no replicate draws are left out."""
    spark = sizes.sparkSession
    ship(spark)
    fields = [f"`{k}` {sizes.schema[k].dataType.simpleString()}" for k in keys]
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / CHUNK))).alias("_c")
    rows = sizes.where("_n > 0").select(*keys, F.col("_n").cast("long").alias("_n"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("_r")).select(*keys, "_n", "_r", chunks)
    rows = rows.repartition(spark.sparkContext.defaultParallelism)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, segments, packed = [], [], []
            for row, (n, r, c) in enumerate(zip(*(b.column(len(keys) + j).to_pylist() for j in range(3)), strict=True)):
                first = f"{salt}|{r}|"
                hits = np.sort(np.array([int(md5(f"{first}{i}".encode()).hexdigest()[:8], 16) % n for i in range(c * CHUNK, min(n, (c + 1) * CHUNK))], dtype=np.int64))
                of = hits // SEGMENT
                for part in np.split(hits, np.flatnonzero(np.diff(of)) + 1):
                    take.append(row)
                    segments.append(int(part[0]) // SEGMENT)
                    packed.append((part % SEGMENT).astype("<u2").tobytes())
            at = pa.array(take, pa.int64())
            columns = [*(b.column(j).take(at) for j in range(len(keys))), pa.array(segments, pa.int64()), b.column(len(keys) + 1).take(at), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "_s", "_r", "_d"])

    def gather(t: pa.Table) -> pa.Table:
        w = np.zeros((SEGMENT, replicates), dtype=np.int32)
        for r, d in zip(t.column("_r").to_pylist(), t.column("_d").to_pylist(), strict=True):
            np.add.at(w[:, r], np.frombuffer(d, "<u2"), 1)
        held = np.flatnonzero(w.any(axis=1))
        one = t.select(keys).slice(0, 1)
        columns = [one.column(k).take(pa.array(np.zeros(len(held), dtype=np.int64))) for k in keys]
        rows = pa.FixedSizeListArray.from_arrays(pa.array(w[held].ravel()), replicates).cast(pa.list_(pa.int32()))
        return pa.table([*columns, pa.array(held + t.column("_s")[0].as_py() * SEGMENT), rows], names=[*keys, "_k", "w"])

    packed = rows.mapInArrow(draw, ", ".join([*fields, "_s long", "_r int", "_d binary"]))
    return packed.groupBy(*keys, "_s").applyInArrow(gather, ", ".join([*fields, "_k long", "w array<int>"]))


def portable_draws(clusters: DataFrame, cluster: str, replicates: int, salt: str) -> DataFrame:
    """(cluster, w): how often each replicate takes a cluster when clusters are resampled with replacement."""
    ranked = positions(clusters.select(cluster).distinct(), [cluster], "_k").withColumn("_k", F.col("_k") - 1)
    return weights(ranked.agg(F.count(F.lit(1)).alias("_n")), [], replicates, salt).join(ranked, "_k").select(cluster, "w")


def weighted_sums(df: DataFrame, keys: list[str], values: list[str], weight: str = "w") -> DataFrame:
    """(keys, values as arrays): sums of the values times each entry of the weights, by keys. Tasks add up before rows move."""
    spark = df.sparkSession
    ship(spark)
    fields = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]
    kinds = ["double" if df.schema[v].dataType.simpleString() in ("double", "float") else "long" for v in values]
    schema = ", ".join([*fields, *[f"`{v}` array<{t}>" for v, t in zip(values, kinds, strict=True)]])
    dtypes = [np.float64 if t == "double" else np.int64 for t in kinds]
    types = [to_arrow_type(df.schema[k].dataType) for k in keys]

    def table(sums: dict) -> pa.RecordBatch:
        columns = [pa.array([k[j] for k in sums], t) for j, t in enumerate(types)]
        return pa.RecordBatch.from_arrays([*columns, *[pa.array([list(v[j]) for v in sums.values()], pa.list_(pa.from_numpy_dtype(t))) for j, t in enumerate(dtypes)]], names=[*keys, *values])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list[np.ndarray]] = {}
        for b in batches:
            own = list(zip(*(b.column(j).to_pylist() for j in range(len(keys))), strict=True)) if keys else [()] * b.num_rows
            numbers = [b.column(len(keys) + j).to_numpy(zero_copy_only=False) for j in range(len(values))]
            for i, (key, w) in enumerate(zip(own, b.column(len(keys) + len(values)), strict=True)):
                w = w.values.to_numpy()
                got = sums.get(key)
                if got is None:
                    got = sums[key] = [np.zeros(len(w), dtype=t) for t in dtypes]
                for x, v in zip(got, numbers, strict=True):
                    x += (w * v[i]).astype(x.dtype)
            if len(sums) * sum(len(x) for x in next(iter(sums.values()), [])) > 1 << 23:
                yield table(sums)
                sums.clear()
        if sums:
            yield table(sums)

    def add(t: pa.Table) -> pa.Table:
        first = t.slice(0, 1)
        columns = [np.sum([x.values.to_numpy() for c in t.column(v).chunks for x in c], axis=0) for v in values]
        return pa.table([*(first.column(k) for k in keys), *[pa.array([list(c)], pa.list_(pa.from_numpy_dtype(d))) for c, d in zip(columns, dtypes, strict=True)]], names=[*keys, *values])

    rows = df.select(*keys, *[F.col(v).cast(t).alias(v) for v, t in zip(values, kinds, strict=True)], weight).mapInArrow(partial, schema)
    if not keys:
        return rows.withColumn("_one", F.lit(1)).groupBy("_one").applyInArrow(lambda t: add(t), schema)
    return rows.groupBy(*keys).applyInArrow(add, schema)


def by_replicate(arrays: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, replicate, values) from arrays over the replicates."""
    zipped = F.arrays_zip(*[F.col(v) for v in values])
    return arrays.select(*keys, F.posexplode(zipped).alias("replicate", "_v")).select(*keys, F.col("replicate").cast("long").alias("replicate"), *[F.col("_v")[v].alias(v) for v in values])


def pair_counts_of_arrays(grouped: DataFrame, value: str, replicates: int) -> DataFrame:
    """(replicate, pair counts) of values whose numbers a and b are arrays over the replicates.

    Values are dealt out by range; a part gives its sums and the pairs inside it, and pairs across parts come from the
    sums of the parts, a row each."""
    ship(grouped.sparkSession)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_all, b_all, inside, tied, same = (np.zeros(replicates, dtype=np.int64) for _ in range(5))
        for batch in batches:
            for a, b in zip(*(batch.column(j) for j in range(2)), strict=True):
                a, b = a.values.to_numpy(), b.values.to_numpy()
                inside += a * b_all
                tied += a * b
                same += (a * (a - 1) + b * (b - 1)) // 2
                a_all += a
                b_all += b
        rows = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (a_all, b_all, inside, tied, same)]
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), *rows], names=["part", "a", "b", "inside", "tied", "same"])

    def total(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        a, b, inside, tied, same = (np.array(t.column(c).to_pylist(), dtype=np.int64) for c in ("a", "b", "inside", "tied", "same"))
        concordant = inside.sum(axis=0) + (a * (np.cumsum(b, axis=0) - b)).sum(axis=0)
        n, m = a.sum(axis=0), b.sum(axis=0)
        both = (n * (n - 1) + m * (m - 1)) // 2
        out = {"replicate": np.arange(replicates), "concordant": concordant, "discordant": n * m - concordant - tied.sum(axis=0), "t_acc": both - same.sum(axis=0), "t_met": tied.sum(axis=0)}
        return pa.table(out)

    parts = grouped.select(value, "a", "b").repartitionByRange(value).sortWithinPartitions(value).select("a", "b").mapInArrow(part, "part int, a array<long>, b array<long>, inside array<long>, tied array<long>, same array<long>")
    return parts.withColumn("_one", F.lit(1)).groupBy("_one").applyInArrow(lambda t: total(t), "replicate long, concordant long, discordant long, t_acc long, t_met long")


def bootstrap_pooled(df: DataFrame, draws: DataFrame, cluster: str, value: str, accepted: Column, replicates: int) -> DataFrame:
    """Per replicate tau-b of the resampled rows, over rows grouped by cluster and value before they meet the weights."""
    small = by_value(df, [cluster], value, accepted)
    weighed = weighted_sums(small.join(draws, cluster), [value], ["a", "b"])
    return pair_counts_of_arrays(weighed, value, replicates).select("replicate", tau_b().alias("tau"))


def bootstrap_within(df: DataFrame, draws: DataFrame, cluster: str, value: str, accepted: Column) -> DataFrame:
    """Per replicate tau-b of pairs inside clusters: weights times the clusters' counts."""
    c = pair_counts(by_value(df, [cluster], value, accepted), [cluster], value)
    names = ["concordant", "discordant", "t_acc", "t_met"]
    return by_replicate(weighted_sums(c.join(draws, cluster), [], names), [], names).select("replicate", tau_b().alias("tau"))


def interval(estimates: DataFrame, keys: list[str], value: str, replicates: int, share: float = 0.95) -> DataFrame:
    """2.5 and 97.5 percentiles, interpolated; null if fewer than share of the replicates are defined."""
    out = estimates.groupBy(*keys).agg(F.count(value).alias("defined"), F.percentile(value, F.array(F.lit(0.025), F.lit(0.975))).alias("_q"))
    enough = F.col("defined") >= F.ceil(F.lit(share * replicates))
    return out.select(*keys, "defined", F.when(enough, F.col("_q")[0]).alias("ci_low"), F.when(enough, F.col("_q")[1]).alias("ci_high"))


def contrast(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Means of both sides and of the difference over paired values left and right, and the number of pairs."""
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("left").alias("left_mean"), F.avg("right").alias("right_mean"), F.avg(F.col("left") - F.col("right")).alias("delta"))


def bootstrap_contrast(pairs: DataFrame, keys: list[str], unit: str, replicates: int, salt: str) -> DataFrame:
    """Per replicate the mean difference of as many pairs drawn with replacement."""
    one = pairs.select(*keys, unit, (F.col("left") - F.col("right")).cast("double").alias("_d"), F.lit(1).alias("_one"))
    ranked = running_sums(one, keys, [unit], {"_k": "_one"})
    drawn = weights(pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys, replicates, salt)
    sums = weighted_sums(ranked.select(*keys, "_k", "_d", "_one").join(drawn, [*keys, "_k"]), keys, ["_d", "_one"])
    return by_replicate(sums, keys, ["_d", "_one"]).select(*keys, "replicate", (F.col("_d") / F.col("_one")).alias("delta"))


def softmax(df: DataFrame, keys: list[str], score: str, temperature: float) -> DataFrame:
    """weight = exp(score / T) over its sum in the group, from the largest score down so that nothing overflows."""
    over = W.partitionBy(*keys)
    x = df.withColumn("_e", F.exp((F.col(score) - F.max(score).over(over)) / temperature))
    return x.withColumn("weight", F.col("_e") / F.sum("_e").over(over)).drop("_e")


def resample(df: DataFrame, keys: list[str], pos: str, weight: str, k: int, salt: str) -> DataFrame:
    """k draws with replacement per group by weight: hash uniforms located in the cumulative weights.

    A draw belongs to the row in whose range it falls; each row joins its group's k uniforms, no cross product of rows."""
    over = W.partitionBy(*keys).orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    x = df.withColumn("_hi", F.sum(weight).over(over)).withColumn("_lo", F.col("_hi") - F.col(weight)).withColumn("_all", F.sum(weight).over(W.partitionBy(*keys)))
    u = lambda i: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(salt), *[F.col(c).cast("string") for c in keys], i.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32) * F.col("_all")
    hits = F.filter(F.sequence(F.lit(1), F.lit(k)), lambda i: (u(i) >= F.col("_lo")) & (u(i) < F.col("_hi")))
    return x.withColumn("draw", F.explode(hits)).drop("_hi", "_lo", "_all")

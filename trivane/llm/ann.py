"""Approximate nearest neighbours by multiprobe p-stable hashing.

The index has several tables; in each a vector's bucket is floor((a . x + b) / w) for m Gaussian directions a (Datar et al.
2004), x being the vector scaled to length 1, so that distance orders as cosine does. A query visits in each table the
buckets obtained from its own by steps of -1, 0 or 1 in at most REACH coordinates, in the order of their estimated success: the
sum of the squared distances to the boundaries crossed (Lv et al. 2007). Candidates of all tables are merged and ranked
by their exact cosine in double precision.

The number of tables, m, w and the number of probes are chosen anew for every input: FIT_QUERIES rows of a bounded sample ask, their
true neighbours are found among all rows, in one pass, and the setting is taken that costs least among those that find so large a
share of them that neither their number nor that of the queries is likely to bring the recall below LEAST. Cost counts the rows that a query is compared with, and the rows and probes that are dealt out. As the
rows grow in number, neighbours come nearer and the share of rows that a query visits falls. Every row is indexed.

The rows of a bucket are cut into blocks of about BLOCK rows, and so are its queries; a task compares two blocks and
returns the K best of each query, so a bucket may hold a third of all rows. Queries that found fewer than K rows are compared with
all rows, block by block; that is exact.

Vectors are compared with those of the same number of components; a number that few rows have (vectors.FEW) needs no index,
its queries are compared with all its rows. Vectors that are null, empty, zero, or hold a null or non-finite component take no
part; components may be as large or small as doubles can be. Rows with a query's own id are not its neighbours; further rows of one id
are one candidate by their best score, and one query, that of the fewest components and least bytes. Rows without an id take no
part. Ties go to the smaller id. An empty table gives an empty result. Extra columns are not read."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from trivane.llm.common import arrow_map, partitions, sorted_groups, stored
from trivane.llm.vectors import finite, share, unpacked, widths

K = 5
FIT_ROWS, FIT_QUERIES, LEAST, SIGMAS = 1000, 120, 0.9, 2.5
#: Settings that are tried; REACH is by m.
HASHES, WIDTHS, TABLES, PROBES = (4, 6, 8, 10, 12), (0.75, 1.0, 1.5, 2.0, 3.0), (1, 2, 3, 4, 6), (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512)
REACH = {4: 4, 6: 6, 8: 4, 10: 3, 12: 3}
#: What dealing a row or probe out costs, in comparisons.
DEALT = 10
BLOCK = 1024


@dataclass
class Index:
    lines: np.ndarray  # (components, tables * m)
    shift: np.ndarray  # (tables * m)
    width: float
    m: int
    tables: int
    probes: int

    def place(self, x: np.ndarray) -> np.ndarray:
        """(n, tables, m) positions in units of the width; the bucket is their floor."""
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        return ((x @ self.lines + self.shift) / self.width).reshape(len(x), self.tables, self.m)


@functools.cache
def _steps(m: int) -> np.ndarray:
    """Steps of -1, 0 or 1 in at most REACH[m] of m coordinates, none first."""
    out = []
    for k in range(REACH.get(m, m) + 1):
        for at in itertools.combinations(range(m), k):
            for signs in itertools.product((-1, 1), repeat=k):
                row = [0] * m
                for i, v in zip(at, signs, strict=True):
                    row[i] = v
                out.append(row)
    return np.array(out, dtype=np.int64)


def step_costs(place: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """(n, tables, steps) squared distances to the boundaries that the steps cross."""
    frac = place - np.floor(place)
    return frac**2 @ (steps == -1).T.astype(np.float64) + (1 - frac) ** 2 @ (steps == 1).T.astype(np.float64)


def probe_order(place: np.ndarray, steps: np.ndarray, probes: int) -> np.ndarray:
    """(n, tables, probes) indices of steps, the likeliest first."""
    return np.argsort(step_costs(place, steps), axis=-1, kind="stable")[..., :probes]


def bucket_keys(cells: np.ndarray) -> np.ndarray:
    """One long for the m coordinates in the last axis."""
    out = np.zeros(cells.shape[:-1], dtype=np.int64)
    for k in range(cells.shape[-1]):
        out = out * 1000003 + (cells[..., k].astype(np.int64) + 500000)
    return out


def _reached(rows: np.ndarray, asks: np.ndarray, steps: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
    """The probe at which rows are reached in one table, PROBES[-1] if never: positions (r, m) of rows and (q, m) of asks, the
    result (q, r); or, with own, rows (q, r, m) of each ask's own."""
    most = PROBES[-1]
    cell = np.floor(asks)
    frac = asks - cell
    d = (np.floor(rows)[None] if own is None else np.floor(rows)) - cell[:, None, :]
    fine = (np.abs(d) <= 1).all(axis=2) & ((d != 0).sum(axis=2) <= REACH.get(asks.shape[1], asks.shape[1]))
    cost = np.where(d == -1, (frac**2)[:, None, :], np.where(d == 1, ((1 - frac) ** 2)[:, None, :], 0.0)).sum(axis=2)
    ranked = np.sort(step_costs(asks[:, None, :], steps)[:, 0], axis=1)[:, :most]
    out = np.full(d.shape[:2], most, dtype=np.int32)
    for q in range(len(asks)):
        at = np.flatnonzero(fine[q])
        out[q, at] = np.minimum(most, np.searchsorted(ranked[q], cost[q, at] - 1e-12, "left"))
    return out


def goal(found: int, asked: int) -> float:
    """The recall to aim at: LEAST, and SIGMAS standard deviations of an estimate from found neighbours and of asked ones."""
    return min(1.0, LEAST + SIGMAS * math.sqrt(LEAST * (1 - LEAST) * (1 / max(1, found) + 1 / max(1, asked))))


def tune(x: np.ndarray, asks: np.ndarray, near: np.ndarray, rows: int, asked: int, seed: int = 11) -> tuple[Index, dict]:
    """The cheapest setting that finds goal() of the neighbours (asks, k, components), or else the one that finds most, and what
    is expected of it; x is a sample of the rows."""
    rng = np.random.default_rng(seed)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    x, asks, near = unit(x), unit(asks), unit(near)
    apart = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("qkd,qd->qk", near, asks))).mean() or 1e-3
    found, least = None, goal(near.shape[0] * near.shape[1], asked * near.shape[1])
    for m in HASHES:
        lines, shift = rng.standard_normal((x.shape[1], TABLES[-1] * m)), rng.random(TABLES[-1] * m)
        at, p, n = ((v @ lines).reshape(*v.shape[:-1], TABLES[-1], m) for v in (x, asks, near))
        moved = shift.reshape(TABLES[-1], m)
        steps = _steps(m)
        for wide in WIDTHS:
            w = wide * apart
            # By table: the probe that reaches each row of the sample, and each neighbour.
            seen, hit = [], []
            for k in range(TABLES[-1]):
                q = p[:, k] / w + moved[k]
                seen.append(_reached(at[:, k] / w + moved[k], q, steps))
                hit.append(_reached(n[:, :, k] / w + moved[k], q, steps, near))
            for tables in TABLES:
                first = np.min(hit[:tables], axis=0)
                for probes in PROBES:
                    recall = float((first < probes).mean())
                    compared = float(sum((s < probes).mean() for s in seen[:tables])) * rows
                    cost = compared + DEALT * tables * (probes + 50)
                    # More comparisons than all rows would take are never worth it.
                    rank = (compared >= rows, recall < least, cost if recall >= least else -recall)
                    if found is None or rank < found[0]:
                        index = Index(lines[:, : tables * m], shift[: tables * m] * w, w, m, tables, probes)
                        visited = float((np.min(seen[:tables], axis=0) < probes).mean())
                        found = rank, index, {"recall": recall, "compared": compared, "visited": visited * rows}
    return found[1], found[2]


def _indexed(rows: DataFrame, index: Index, kind: str, as_query: bool) -> DataFrame:
    """(tab, key, id, vec) of the row's own buckets, or of those that a query probes."""
    steps = _steps(index.m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                b = whole.slice(at, 128)
                p = index.place(unpacked(b.column(1).to_pylist(), kind))
                cells = np.floor(p)[:, :, None, :]
                if as_query:
                    cells = cells + steps[probe_order(p, steps, index.probes)]
                keys = bucket_keys(cells)
                each = keys.shape[1] * keys.shape[2]
                tab = np.tile(np.repeat(np.arange(index.tables, dtype=np.int32), keys.shape[2]), b.num_rows)
                row = pa.array(np.repeat(np.arange(b.num_rows), each))
                yield pa.RecordBatch.from_arrays([pa.array(tab), pa.array(keys.ravel()), b.column(0).take(row), b.column(1).take(row)], names=["tab", "key", "id", "vec"])

    return arrow_map(rows.select("id", "vec"), run, "tab int, key long, id long, vec binary")


def _true(rows: DataFrame, asks: list[tuple[int, bytes]], kind: str, k: int) -> list[list[bytes]]:
    """The k nearest rows of each of a few asks among all rows; tasks return their own best, and k a query come to the driver."""
    q = unpacked([v for _, v in asks], kind)
    q = q / np.linalg.norm(q, axis=1, keepdims=True)
    own = np.array([i for i, _ in asks])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, int, bytes]]] = [[] for _ in asks]
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                vec, ids = b.column(1).to_pylist(), b.column(0).to_numpy()
                x = unpacked(vec, kind)
                cos = q @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
                cos[own[:, None] == ids[None, :]] = -2
                top = np.argpartition(-cos, min(k, cos.shape[1] - 1), axis=1)[:, :k]
                for i, js in enumerate(top.tolist()):
                    best[i] = sorted({*best[i], *((-float(cos[i, j]), int(ids[j]), vec[j]) for j in js if cos[i, j] > -2)})[:k]
        flat = [(i, -s, j, v) for i, rows in enumerate(best) for s, j, v in rows]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat, strict=True), (pa.int32(), pa.float64(), pa.int64(), pa.binary()), strict=True)], names=["ask", "score", "id", "vec"])

    got = arrow_map(rows.select("id", "vec"), run, "ask int, score double, id long, vec binary")
    rank = F.row_number().over(W.partitionBy("ask").orderBy(F.desc("score"), "id", "vec"))
    out: list[list[bytes]] = [[] for _ in asks]
    for r in got.withColumn("_r", rank).where(F.col("_r") <= k).orderBy("ask", "_r").select("ask", "vec").collect():
        out[r["ask"]].append(bytes(r["vec"]))
    return out


def index_for(rows: DataFrame, kind: str, n: int, k: int, asked: int) -> tuple[Index, dict]:
    """The index for rows (id, vec) of one width, n in all, and so many queries; and what is expected of it."""
    sample = sorted((r["id"], bytes(r["vec"])) for r in share(rows, F.xxhash64("id", "vec", F.lit("fit")), FIT_ROWS, n).select("id", "vec").collect())
    x = unpacked([v for _, v in sample], kind)
    pick = np.random.default_rng(5).permutation(len(sample))[:FIT_QUERIES]
    near = _true(rows, [sample[i] for i in pick], kind, k)
    full = [i for i, v in enumerate(near) if len(v) == k]
    if not full:  # too few different rows for k neighbours: any index will do, as such queries are compared with all rows
        d = x.shape[1]
        return Index(np.ones((d, 1)), np.zeros(1), 1.0, 1, 1, 1), {}
    return tune(x, x[pick[full]], np.stack([unpacked(near[i], kind) for i in full]), n, asked)


def _ranked(units: DataFrame, kind: str, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best rows of each query in each unit (tab, key, block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in sorted_groups(batches, ["tab", "key", "block"], 2048):
            vec = t.column("vec").to_pylist()
            ids, asks = t.column("id").to_numpy(), t.column("asks").to_numpy(zero_copy_only=False)
            out = []
            for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                q, r = np.flatnonzero(asks[s:e]), np.flatnonzero(~asks[s:e])
                if not len(q) or not len(r):
                    continue
                x, own = unpacked(vec[s:e], kind), ids[s:e]
                norm = np.sqrt((x * x).sum(axis=1))
                # Rows of one id are one candidate: they lie side by side, and the best of them counts.
                r = r[np.argsort(own[r], kind="stable")]
                each, first = np.unique(own[r], return_index=True)
                for c in range(0, len(q), 128):
                    part = q[c : c + 128]
                    cos = (x[part] @ x[r].T) / np.outer(norm[part], norm[r])
                    if len(each) < len(r):
                        cos = np.maximum.reduceat(cos, first, axis=1)
                    cos[own[part][:, None] == each[None, :]] = -np.inf
                    take = min(len(each), k)
                    # With ties at the edge all of them compete; ids are in order.
                    least = -np.partition(-cos, take - 1, axis=1)[:, take - 1]
                    for row, qi in enumerate(part.tolist()):
                        cand = np.flatnonzero((cos[row] >= least[row]) & (cos[row] > -np.inf))
                        cand = cand[np.lexsort((each[cand], -cos[row, cand]))][:k]
                        out += [(int(own[qi]), int(each[z]), float(cos[row, z])) for z in cand.tolist()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in out], pa.int64()), pa.array([v[1] for v in out], pa.int64()), pa.array([v[2] for v in out], pa.float64())], names=["query_id", "vec_id", "score"])

    return arrow_map(units.select("tab", "key", "block", "id", "asks", "vec"), run, "query_id long, vec_id long, score double")


def _units(rows: DataFrame, asks: DataFrame) -> DataFrame:
    """Rows and queries by bucket: its rows in blocks, its queries in blocks, and a unit for each pair of blocks."""
    count = lambda df, name: df.groupBy("tab", "key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    # Only buckets that hold rows and are asked for matter.
    sizes = stored(count(rows, "nr").join(count(asks, "nq"), ["tab", "key"]), "sizes")
    spread = lambda n: F.pmod(F.xxhash64("id", "vec"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    r = rows.join(sizes, ["tab", "key"]).withColumn("i", spread("nr")).withColumn("j", each("nq"))
    q = asks.join(sizes, ["tab", "key"]).withColumn("j", spread("nq")).withColumn("i", each("nr"))
    cols = lambda df, asking: df.select("tab", "key", (F.col("i").cast("long") * (1 << 31) + F.col("j")).alias("block"), "id", F.lit(asking).alias("asks"), "vec")
    unit = ["tab", "key", "block"]
    return cols(r, False).union(cols(q, True)).repartition(partitions(rows.sparkSession), *unit).sortWithinPartitions(*unit)


def _best(found: DataFrame, k: int) -> DataFrame:
    one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return one.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)


def _exact(rows: DataFrame, asks: DataFrame, kind: str, k: int) -> DataFrame:
    """The k best rows of each ask among all rows of its width, block by block."""
    sizes = stored(rows.groupBy("width").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("_blocks")), "widths")
    key = lambda block: F.col("width").cast("long") * (1 << 40) + block
    every = rows.join(sizes, "width").select(F.lit(0).alias("tab"), key(F.pmod(F.xxhash64("id", "vec", F.lit("block")), F.col("_blocks"))).alias("key"), "id", "vec")
    ask = asks.join(sizes, "width").select(F.lit(0).alias("tab"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_at"), "width", "id", "vec")
    return _best(_ranked(_units(every, ask.select("tab", key(F.col("_at")).alias("key"), "id", "vec")), kind, k), k)


def packed(embeddings: DataFrame, is_query: Column) -> tuple[DataFrame, str]:
    """(id, asks, vec, width) of the rows that take part, and the type of their components."""
    kind = "<f4" if dict(embeddings.dtypes)["embedding"] == "array<float>" else "<f8"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.col("embedding").cast("array<double>").alias("embedding"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [np.array(v, dtype=kind).tobytes() for v in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raw, pa.binary())], names=["id", "asks", "vec"])

    rows = arrow_map(rows.where(F.col("id").isNotNull() & finite("embedding")), pack, "id long, asks boolean, vec binary")
    return stored(rows.withColumn("width", (F.length("vec") / int(kind[2])).cast("int")), "vectors"), kind


def search(embeddings: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows found for each row for which is_query holds."""
    rows, kind = packed(embeddings, is_query)
    n, indexed = widths(rows)
    asks = rows.where("asks").groupBy("id").agg(F.min(F.struct("width", "vec")).alias("x")).select("id", "x.vec", "x.width")
    asks = stored(asks, "asks")
    parts = []
    for w in sorted(indexed):
        own = rows.where(F.col("width") == w)
        asking = asks.where(F.col("width") == w)
        index, _ = index_for(own, kind, n[w], k, asking.count())
        units = _units(_indexed(own, index, kind, False), _indexed(asking, index, kind, True))
        parts.append(stored(_best(_ranked(units, kind, k), k), "found"))
    if not parts:
        return asks.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    found = functools.reduce(DataFrame.unionByName, parts)
    # Queries that found fewer than k, those of rare widths among them.
    full = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    short = stored(asks.join(full, F.col("id") == F.col("query_id"), "left_anti"), "short")
    if not short.isEmpty():
        found = found.join(short.select("id"), F.col("query_id") == F.col("id"), "left_anti").unionByName(_exact(rows, short, kind, k))
    return found.select("query_id", "rank", "vec_id", "score")

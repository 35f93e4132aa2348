"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Rotations of the principal components are learned so that the signs of the components make balanced binary codes (ITQ,
Gong and Lazebnik 2011), on a bounded sample of about FIT_ROWS rows. The code is cut into substrings of bits_for(rows)
bits, one Hamming table each; two vectors are candidates if they agree in one substring. There are as many tables as
make a pair at the threshold itself agree somewhere with probability RECALL, taking bits for independent; further
rotations supply bits when one has too few.

Codes alone are dealt out to the tables. Rows that have a candidate there whose code of SKETCH bits differs in no more
places than a pair at the threshold does (but for a chance of MISS) are looked up in a second pass, with their vectors,
and compared by the cosine of the original vectors in double precision.

Equal vectors form one class with its number of rows. Buckets are cut into blocks, any two of which meet in one task;
tasks return marks, sums and spanning forests, never pairs, and a pair counts in the first table in which it agrees.

Only vectors with the same number of components link. A number that few rows have (vectors.FEW) needs no tables: its
vectors are compared with each other, in blocks. Vectors that are null, empty, zero, or hold a null or non-finite component
link with nothing; components may be as large or small as doubles can be. Repeated rows are vectors of their own and link with
each other. A null vec_id stays null and is never the least. An empty table gives an empty result. Extra columns are not
read."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivane.llm.common import arrow_map, components, discard, forest, in_blocks, matrix, sorted_groups, stored
from trivane.llm.vectors import finite, share, unpacked, widths

THRESHOLD, RECALL = 0.9, 0.999
FIT_ROWS, FIT_ROUNDS = 8192, 40
BUCKET, BLOCK = 1024, 1024
SKETCH, MISS = 256, 1e-6


def bits_for(rows: int) -> int:
    """Bits of a table, so that a bucket has about BUCKET rows."""
    return min(32, max(6, round(math.log2(max(2, rows) / BUCKET))))


def tables_for(bits: int, threshold: float, recall: float) -> int:
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(1 - recall) / math.log(1 - agree))


def learn(x: np.ndarray, bits: int, seed: int = 7) -> np.ndarray:
    """(components, bits) whose signs are the code: ITQ rotations side by side."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = x.shape[1]
    # Signs of rows around the origin measure angles, so the components are those of the uncentred second moment.
    _, basis = np.linalg.eigh(x.T @ x)
    basis = basis[:, ::-1]
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(-(-bits // d)):
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        v = x @ basis
        for _ in range(FIT_ROUNDS):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        out.append(basis @ r)
    return np.concatenate(out, axis=1)[:, :bits]


def differing(bits: int, threshold: float, miss: float = MISS) -> int:
    """The number of bits of bits that more of differ with a chance below miss, for a pair at the threshold."""
    p = math.acos(threshold) / math.pi
    left, term = 1.0, (1 - p) ** bits
    for k in range(bits + 1):
        left -= term
        if left < miss:
            return k
        term *= (bits - k) / (k + 1) * p / (1 - p)
    return bits


class Tables:
    """The planes of one width, a table for each bits of them; the sketch is the first SKETCH bits, or all."""

    def __init__(self, sample: np.ndarray, rows: int, threshold: float, recall: float):
        self.bits = bits_for(rows)
        self.tables = tables_for(self.bits, threshold, recall)
        # So many bits that a sketch tells candidates from others.
        self.planes = learn(sample, max(SKETCH // 2, self.bits * self.tables))
        self.sketch = min(SKETCH, self.planes.shape[1]) // 64 * 64
        self.most = differing(self.sketch, threshold)

    def signs(self, x: np.ndarray) -> np.ndarray:
        return x @ self.planes >= 0

    def keys(self, signs: np.ndarray) -> np.ndarray:
        """(n, tables) numbers of the buckets."""
        return signs[:, : self.bits * self.tables].reshape(len(signs), self.tables, self.bits) @ (1 << np.arange(self.bits)).astype(np.int64)


def _coded(classes: DataFrame, width: int, t: Tables, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                signs = t.signs(unpacked(b.column(1).to_pylist(), kind))
                code = pa.array([c.tobytes() for c in np.packbits(signs[:, : t.sketch], axis=1)], pa.binary())
                row = pa.array(np.repeat(np.arange(b.num_rows), t.tables))
                n = b.num_rows * t.tables
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, width, dtype=np.int32)), pa.array(np.tile(np.arange(t.tables, dtype=np.int32), b.num_rows)), pa.array(t.keys(signs).ravel()), b.column(0).take(row), code.take(row)], names=["width", "tab", "key", "node", "code"])

    return arrow_map(classes.where(F.col("width") == width).select("node", "vec"), run, "width int, tab int, key long, node binary, code binary")


def _marked(units: DataFrame, t: Tables) -> DataFrame:
    """(width, tab, key, node) of the rows that have a candidate with a near code in a unit, one with which they agree in no
    earlier table that the sketch shows."""
    weights = (1 << np.arange(t.bits)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, at in sorted_groups(batches, ["width", "tab", "key", "_i", "_j"], 4096):
            code, raw = matrix(rows.column("code"), "<u8"), matrix(rows.column("code"), np.uint8)
            tab, i, j, own = (rows.column(c).to_numpy() for c in ("tab", "_i", "_j", "_b"))
            hit = np.zeros(rows.num_rows, dtype=bool)
            for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                earlier = min(int(tab[s]), t.sketch // t.bits)
                keys = np.unpackbits(raw[s:e], axis=1)[:, : earlier * t.bits].reshape(e - s, earlier, t.bits) @ weights if earlier else None
                left, right = np.flatnonzero(own[s:e] == i[s]), np.flatnonzero(own[s:e] == j[s])
                for k in range(0, len(left), 256):
                    part = left[k : k + 256]
                    apart = np.zeros((len(part), len(right)), dtype=np.int16)
                    for w in range(code.shape[1]):
                        apart += np.bitwise_count(code[s + part, w][:, None] ^ code[s + right, w][None, :])
                    a, b = np.nonzero((apart <= t.most) & (part[:, None] != right[None, :]))
                    a, b = part[a], right[b]
                    if keys is not None:
                        new = ~(keys[a] == keys[b]).any(axis=1)
                        a, b = a[new], b[new]
                    hit[s + a] = hit[s + b] = True
            yield from rows.filter(pa.array(hit)).select(["width", "tab", "key", "node"]).to_batches()

    return arrow_map(units.select("width", "tab", "key", "_i", "_j", "_b", "node", "code"), run, "width int, tab int, key long, node binary")


def _linked(units: DataFrame, threshold: float, kind: str, tables: dict[int, Tables]) -> DataFrame:
    """(node, links, root): rows that a class links with in a unit, and the least class linked with it there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in sorted_groups(batches, ["width", "tab", "key", "_i", "_j"], 2048):
            vec, node = t.column("vec").to_pylist(), t.column("node").to_pylist()
            width, tab, i, j, own, rows = (t.column(c).to_numpy() for c in ("width", "tab", "_i", "_j", "_b", "rows"))
            out = []
            for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                x = unpacked(vec[s:e], kind)
                norm = np.sqrt((x * x).sum(axis=1))
                keys = tables[width[s]].keys(tables[width[s]].signs(x))[:, : tab[s]] if tab[s] else None
                left, right = np.flatnonzero(own[s:e] == i[s]), np.flatnonzero(own[s:e] == j[s])
                pa_, pb_ = [], []
                for k in range(0, len(left), 256):
                    part = left[k : k + 256]
                    cos = (x[part] @ x[right].T) / np.outer(norm[part], norm[right])
                    a, b = np.nonzero(cos >= threshold)
                    a, b = part[a], right[b]
                    if i[s] == j[s]:
                        a, b = a[a < b], b[a < b]
                    if keys is not None:
                        new = ~(keys[a] == keys[b]).any(axis=1)
                        a, b = a[new], b[new]
                    pa_.append(a)
                    pb_.append(b)
                if not pa_ or not sum(map(len, pa_)):
                    continue
                a, b = np.concatenate(pa_), np.concatenate(pb_)
                links = np.bincount(a, rows[s:e][b], e - s) + np.bincount(b, rows[s:e][a], e - s)
                order = np.argsort(np.array([v.hex() for v in node[s:e]]))
                rank = np.empty(e - s, dtype=np.int64)
                rank[order] = np.arange(e - s)
                root = order[forest(e - s, rank[a], rank[b])[rank]]
                out += [(node[s + k], int(links[k]), node[s + int(root[k])]) for k in np.flatnonzero(links).tolist()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in out], pa.binary()), pa.array([v[1] for v in out], pa.int64()), pa.array([v[2] for v in out], pa.binary())], names=["node", "links", "root"])

    return arrow_map(units.select("width", "tab", "key", "_i", "_j", "_b", "node", "vec", "rows"), run, "node binary, links long, root binary")


def dedup(embeddings: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    kind = "<f4" if dict(embeddings.dtypes)["embedding"] == "array<float>" else "<f8"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(finite("embedding"), F.col("embedding").cast("array<double>")).alias("embedding"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [None if v is None else np.array(v, dtype=kind).tobytes() for v in b.column(1).to_pylist()]
            node = [None if v is None else hashlib.blake2b(v, digest_size=16).digest() for v in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(node, pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "node", "vec"])

    packed = stored(arrow_map(rows, pack, "vec_id long, node binary, vec binary"), "vectors")
    classes = packed.where("node IS NOT NULL").groupBy("node").agg(F.count(F.lit(1)).alias("rows"), F.min("vec_id").alias("vec_id"), F.first("vec").alias("vec"))
    classes = stored(classes.withColumn("width", (F.length("vec") / int(kind[2])).cast("int")), "classes")
    n, indexed = widths(classes)
    tables = {}
    for w in sorted(indexed):
        own = classes.where(F.col("width") == w)
        sample = sorted(bytes(r["vec"]) for r in share(own, F.xxhash64("node"), FIT_ROWS, n[w]).select("vec").collect())
        tables[w] = Tables(unpacked(sample, kind), n[w], threshold, recall)
    bucket, deal = ["width", "tab", "key"], F.xxhash64("node")
    found = classes.where(~F.col("width").isin(sorted(indexed))).select("width", F.lit(0).alias("tab"), F.lit(0).cast("long").alias("key"), "node")
    for w, t in tables.items():
        found = found.unionByName(_marked(in_blocks(_coded(classes, w, t, kind), bucket, deal, BLOCK), t).distinct())
    marked = stored(found, "marked")
    units = in_blocks(marked.join(classes.select("node", "vec", "rows"), "node"), bucket, deal, BLOCK)
    links = stored(_linked(units, threshold, kind, tables), "links")
    total = links.groupBy("node").agg(F.sum("links").alias("links"))
    comps = components(links.select("node", "root"), "node", "root")
    out = classes.select("node", "rows", "vec_id").join(total, "node", "left").join(comps, "node", "left")
    out = stored(out.select("node", "vec_id", F.coalesce("root", "node").alias("root"), (F.col("rows") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "joined")
    discard(links, marked)
    low = out.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    out = out.join(low, "root").select(F.col("node").alias("_node"), "n_links", "component_id")
    got = packed.select("vec_id", "node").join(out, F.col("node") == F.col("_node"), "left")
    none = F.col("node").isNull()
    got = got.select("vec_id", F.when(none, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"), F.when(none, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return got.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

"""Similarity join of texts by the Jaccard similarity of their word n-grams, with Bayesian candidate pruning.

A text is the set of its runs of SHINGLE words (lower case, letters, digits and underscores); a shorter text is one run.
Texts with equal sets form a class, and the classes are joined:

1. Candidates share a band of ROWS of their HASHES MinHash values.
2. Their values are compared STEP at a time; a pair is dropped when, with a uniform prior, the posterior probability that
   its similarity reaches the threshold falls below TOLERANCE (BayesLSH, Satuluri and Parthasarathy 2012).
3. Only texts in a remaining pair are read again, and their sets are compared exactly.

Exact copies are never paired: a class counts once, with its number of rows. Buckets are cut into blocks and any two
blocks meet in one task, which returns sums and a spanning forest and no pairs; so a bucket may hold a third of all
texts. A pair counts in the first band that it shares, so nothing has to be made distinct.

Texts that are null or without a word have no set, link with nothing and are classes of their own. Repeated rows are
exact copies of each other. A null doc_id stays null; a class of such rows alone has a null id. An empty table gives an
empty result. Extra columns are not read, and kept by deduplicate()."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivane.llm.common import arrow_map, bucket_sizes, components, discard, forest, in_blocks, matrix, sorted_groups, stored, unit_pairs

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 5
HASHES, STEP, TOLERANCE = BANDS * ROWS, 20, 1e-5
SKETCH_BLOCK, SET_BLOCK = 1024, 512
SEGMENT = 1 << 20
#: Rows to be read again that are broadcast to the texts, at about 100 bytes each; beyond that, Spark joins the two by key.
BROADCAST_ROWS = 500_000

_RNG = np.random.default_rng(20240229)
_FLIP = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_TIMES = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RNG.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


@functools.cache
def _word_chars() -> np.ndarray:
    return np.array([chr(i).isalnum() or i == 95 for i in range(0x3000)], dtype=bool)


@functools.lru_cache(maxsize=2)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words p[start:end], some SEGMENT characters at a time, which bounds the tables of powers.

    A polynomial of the characters is summed over each prefix of a segment; a word's own is a difference, moved down to
    power 0, so that it doesn't depend on the word's place."""
    out = np.empty(len(start), dtype=np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + SEGMENT, "right")))
        s, e = start[i:j] - start[i], end[i:j] - start[i]
        q = p[start[i] : end[j - 1]].astype(np.uint64) + np.uint64(1)
        size = 1 << max(12, int(len(q)).bit_length())
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(q * _powers(size, _BASE)[: len(q)], dtype=np.uint64)])
        out[i:j] = _mix((upto[e] - upto[s]) * _powers(size, _BASE_INVERSE)[s])
        i = j
    return out


def shingles(text: str | None) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct word runs of a whole text."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    p = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    word = _word_chars()[np.minimum(p, 0x2FFF)]
    far = np.flatnonzero(p >= 0x3000)
    if len(far):
        word[far] = [chr(c).isalnum() for c in p[far].tolist()]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        h = _word_hashes(p, start, end)
        n = len(h)
        if n < SHINGLE:
            out = np.full(1, n, dtype=np.uint64)
            for k in range(n):
                out = out + _mix(h[k : k + 1] * _PLACE[k])
        else:
            out = np.zeros(n - SHINGLE + 1, dtype=np.uint64)
            for k in range(SHINGLE):
                out = out + _mix(h[k : n - SHINGLE + 1 + k] * _PLACE[k])
        return np.unique(_mix(out))


def minhashes(s: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(s), 1024):
            np.minimum(out, ((s[at : at + 1024, None] ^ _FLIP) * _TIMES).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype("<u4")


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(n, BANDS) keys of (n, HASHES) signatures."""
    x = np.zeros((len(sig), BANDS), dtype=np.uint64)
    parts = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            x = _mix(x + parts[:, :, k] + np.uint64(k + 1))
    return x.astype(np.int64)


@functools.cache
def least_matches(threshold: float, hashes: int = HASHES, step: int = STEP, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """For each number of compared values (step, 2 step, ...): the fewest matches with which a pair goes on.

    With a uniform prior the similarity after m matches of n has the Beta(m + 1, n - m + 1) distribution."""
    x = (np.arange(20000) + 0.5) / 20000
    out = []
    for n in range(step, hashes + 1, step):
        for m in range(n + 1):
            log = m * np.log(x) + (n - m) * np.log1p(-x)
            density = np.exp(log - log.max())
            if density[x >= threshold].sum() / density.sum() >= tolerance:
                break
        out.append(m)
    return tuple(out)


def _unpruned(sig: np.ndarray, a: np.ndarray, b: np.ndarray, band: int, least: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose first shared band is this one and that pruning leaves."""
    same = (sig[a, band * ROWS : (band + 1) * ROWS] == sig[b, band * ROWS : (band + 1) * ROWS]).all(axis=1)
    a, b = a[same], b[same]
    matches = np.zeros(len(a), dtype=np.int64)
    for k, m in enumerate(least):
        if not len(a):
            return a, b
        eq = sig[a, k * STEP : (k + 1) * STEP] == sig[b, k * STEP : (k + 1) * STEP]
        matches = matches + eq.sum(axis=1)
        shared = eq.reshape(len(a), STEP // ROWS, ROWS).all(axis=2)
        early = shared[:, : max(0, min(STEP // ROWS, band - k * STEP // ROWS))].any(axis=1)
        keep = ~early & (matches >= m)
        a, b, matches = a[keep], b[keep], matches[keep]
    return a, b


def intersections(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets a and b, by bit sets over the hashes that several sets have."""
    flat = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, col, n = np.unique(flat, return_inverse=True, return_counts=True)
    keep = n[col] > 1
    doc, col = doc[keep], (np.cumsum(n > 1) - 1)[col[keep]]
    order = np.argsort(col, kind="stable")
    doc, col = doc[order], col[order]
    out = np.zeros(len(a), dtype=np.int64)
    width = 1 << 14
    for s in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        lo, hi = np.searchsorted(col, (s, s + width))
        bits = np.zeros((len(sets), width), dtype=bool)
        bits[doc[lo:hi], col[lo:hi] - s] = True
        packed = np.packbits(bits, axis=1).view(np.uint64)[:, : -(-(int(col[hi - 1]) - s + 1) // 64) if hi > lo else 1]
        step = max(1, (1 << 22) // packed.shape[1])
        for k in range(0, len(a), step):
            out[k : k + step] += np.bitwise_count(packed[a[k : k + step]] & packed[b[k : k + step]]).sum(axis=1, dtype=np.int64)
    return out


def sketches(documents: DataFrame) -> DataFrame:
    """doc_id, print (a hash of the text), digest (of the set, null without words) and sig of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                digest, sig = [], []
                for text in b.column(2).to_pylist():
                    s = shingles(text)
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    sig.append(minhashes(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "print", "digest", "sig"])

    cols = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("print"), "text")
    return arrow_map(cols, run, "doc_id long, print long, digest binary, sig binary")


def _banded(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band = pa.array(np.tile(np.arange(BANDS, dtype=np.int32), 1024))
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                keys = band_keys(matrix(b.column(1), "<u4", HASHES))
                yield pa.RecordBatch.from_arrays([band.slice(0, keys.size), pa.array(keys.ravel()), b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), BANDS)))], names=["band", "key", "digest"])

    return arrow_map(classes.select("digest", "sig"), run, "band int, key long, digest binary")


def _candidates(units: DataFrame, least: tuple[int, ...]) -> DataFrame:
    """(band, key, digest) of the classes that a unit has an unpruned pair of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in sorted_groups(batches, ["band", "key", "_i", "_j"]):
            sig = matrix(t.column("sig"), "<u4", HASHES)
            band, i, j, own = (t.column(c).to_numpy() for c in ("band", "_i", "_j", "_b"))
            hit = np.zeros(len(sig), dtype=bool)
            for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                for a, b in unit_pairs(own[s:e], i[s], j[s]):
                    a, b = _unpruned(sig[s:e], a, b, int(band[s]), least)
                    hit[s + a] = hit[s + b] = True
            got = t.filter(pa.array(hit)).select(["band", "key", "digest"])
            yield from got.to_batches()

    return arrow_map(units.select("band", "key", "_i", "_j", "_b", "digest", "sig"), run, "band int, key long, digest binary")


def _verified(units: DataFrame, least: tuple[int, ...], threshold: float) -> DataFrame:
    """(digest, links, root): rows that a class links with in a unit, and the least class linked with it there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in sorted_groups(batches, ["band", "key", "_i", "_j"], 512):
            sig = matrix(t.column("sig"), "<u4", HASHES)
            sets = [np.frombuffer(x, "<u8") for x in t.column("set").to_pylist()]
            digest = t.column("digest").to_pylist()
            band, i, j, own, rows = (t.column(c).to_numpy() for c in ("band", "_i", "_j", "_b", "rows"))
            out = []
            for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                size = np.array([len(x) for x in sets[s:e]])
                pairs = []
                for a, b in unit_pairs(own[s:e], i[s], j[s]):
                    a, b = _unpruned(sig[s:e], a, b, int(band[s]), least)
                    near = np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - 1e-9
                    pairs.append((a[near], b[near]))
                a, b = (np.concatenate([p[k] for p in pairs]) if pairs else np.empty(0, dtype=np.int64) for k in (0, 1))
                if not len(a):
                    continue
                common = intersections(sets[s:e], a, b)
                ok = common >= threshold * (size[a] + size[b] - common) - 1e-9
                a, b = a[ok], b[ok]
                if not len(a):
                    continue
                links = np.bincount(a, rows[s:e][b], e - s) + np.bincount(b, rows[s:e][a], e - s)
                order = np.argsort(np.array([x.hex() for x in digest[s:e]]))
                rank = np.empty(e - s, dtype=np.int64)
                rank[order] = np.arange(e - s)
                root = order[forest(e - s, rank[a], rank[b])[rank]]
                out += [(digest[s + k], int(links[k]), digest[s + int(root[k])]) for k in np.flatnonzero(links).tolist()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())], names=["digest", "links", "root"])

    return arrow_map(units.select("band", "key", "_i", "_j", "_b", "digest", "sig", "rows", "set"), run, "digest binary, links long, root binary")


def _sets(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(digest, set) of the classes of wanted (doc_id, print, digest), from the row that stands for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["digest", "set"])

    docs = documents.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_print"), "text")
    wanted = stored(wanted, "wanted")
    few = wanted.count() <= BROADCAST_ROWS
    rows = docs.join(F.broadcast(wanted) if few else wanted, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_print") == F.col("print"))).select("digest", "text")
    return arrow_map(rows, run, "digest binary, set binary").dropDuplicates(["digest"])


def classes(documents: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """The sketches without signatures, and for each class: digest, n_links, class_id, root, rows, doc_id and print of the
    row that stands for it, and times (how often that row occurs)."""
    least = least_matches(threshold)
    rows = stored(sketches(documents), "sketches")
    each = rows.where("digest IS NOT NULL").groupBy("digest", "doc_id", "print").agg(F.count(F.lit(1)).alias("n"), F.first("sig").alias("sig"))
    best = F.struct(F.col("doc_id").isNull(), "doc_id", "print", "n")
    cls = each.groupBy("digest").agg(F.sum("n").alias("rows"), F.min(best).alias("x"), F.first("sig").alias("sig"))
    cls = stored(cls.select("digest", "rows", F.col("x.doc_id").alias("doc_id"), F.col("x.print").alias("print"), F.col("x.n").alias("times"), "sig"), "classes")

    bands = _banded(cls)
    members = bands.join(bucket_sizes(bands, ["band", "key"]).drop("_w"), ["band", "key"]).join(cls.select("digest", "sig"), "digest")
    flagged = stored(_candidates(in_blocks(members, ["band", "key"], F.xxhash64("digest"), SKETCH_BLOCK), least).distinct(), "flagged")
    wanted = flagged.select("digest").distinct().join(cls.select("digest", "doc_id", "print"), "digest")
    sets = stored(_sets(documents, wanted), "sets")
    members = flagged.join(cls.select("digest", "sig", "rows"), "digest").join(sets.withColumn("_size", F.length("set")), "digest")
    links = stored(_verified(in_blocks(members, ["band", "key"], F.xxhash64("digest"), SET_BLOCK, "_size"), least, threshold), "links")
    discard(flagged, sets)

    total = links.groupBy("digest").agg(F.sum("links").alias("links"))
    comps = components(links.select("digest", "root"), "digest", "root").select(F.col("node").alias("digest"), "root")
    out = cls.join(total, "digest", "left").join(comps, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    out = stored(out.select("digest", "root", "rows", "doc_id", "print", "times", (F.col("rows") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "joined")
    low = out.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "print", "digest")).alias("x"))
    out = out.join(low.select("root", "class_id", F.col("x.digest").alias("first")), "root")
    return rows.select("doc_id", "print", "digest"), out.withColumn("first", F.col("first") == F.col("digest"))


def join(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id and n_links of every row: class_id is the least doc_id that links lead to, its own included, and
    n_links the number of other rows whose similarity reaches the threshold."""
    rows, cls = classes(documents, threshold)
    cls = cls.select(F.col("digest").alias("_d"), "class_id", "n_links")
    out = rows.join(cls, rows["digest"] == F.col("_d"), "left")
    alone = F.col("digest").isNull()
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"))


def deduplicate(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each group of linked rows, the one of least doc_id, and every row without words; all columns kept."""
    rows, cls = classes(documents, threshold)
    stay = cls.where("first").select("doc_id", "print", (F.col("times") > 1).alias("_once"))
    stay = stay.union(rows.where("digest IS NULL").select("doc_id", "print", F.lit(False)).distinct())
    stay = stored(stay.select(F.col("doc_id").alias("_id"), F.col("print").alias("_print"), "_once"), "stay")
    # The rows travel as one struct, so that no column of theirs can clash with a name used here.
    docs = documents.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_key"), F.xxhash64("text").alias("_text"))
    out = docs.join(stay, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_print")))
    kept = out.where("NOT _once").select("_row.*")
    if stay.where("_once").isEmpty():
        return kept
    return kept.union(out.where("_once").dropDuplicates(["_id", "_print"]).select("_row.*"))

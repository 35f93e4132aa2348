"""What the two operators on vectors share: rows that take part, their values as bytes, and their numbers of components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors of a number of components that no more rows have than this are compared exactly, unless no number is more usual.
FEW = 4096


def finite(vector: str) -> Column:
    """The vector has components, all of them finite, and not all zero; never null."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def widths(rows: DataFrame) -> tuple[dict[int, int], set[int]]:
    """Rows by width (a row for each different number of components), and the widths that are indexed: the most usual one,
    the smallest of these in a tie, and all of more than FEW rows."""
    n = {r["width"]: r["n"] for r in rows.groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect()}
    usual = min(n, key=lambda w: (-n[w], w), default=None)
    return n, {w for w in n if w == usual or n[w] > FEW}


def unpacked(vectors: list[bytes], kind: str) -> np.ndarray:
    """A row of doubles for each of these vectors of one width. Doubles are scaled by a power of two, which changes no cosine,
    so that squares neither overflow nor vanish."""
    x = np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(np.float64)
    if kind == "<f8" and len(x):
        x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x


def share(rows: DataFrame, key: Column, most: int, n: int) -> DataFrame:
    """About most rows of n, or all if there are fewer, by a threshold on a hash of key."""
    return rows if n <= most else rows.where(key / float(1 << 63) < 2 * most / n - 1)

"""Language identification by nearest centroids.

A text is a vector of hashed character n-grams (1 to 3, over its letters in lower case, with one blank between words),
weighted by TF-IDF and normalised. Each language has several centroids, from spherical k-means over its training rows;
the nearest by cosine decides. A text whose best cosine lies below what all but REJECT of its language's training rows
reach is marked rejected; its prediction stays.

The classifier is fitted on a bounded sample of labelled rows: about FIT_ROWS in all, the same number for each language (all
of its rows, if it has fewer), chosen by a threshold on a hash of doc_id and text. Null texts and texts without a letter are `und` with score 0.
Repeated rows get equal results; an empty table gives an empty result; extra columns are not read. Without any training
row every text is `und`."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trivane.llm.common import arrow_map

DIMS = 4096
#: Rows that the classifier is fitted on, about; all languages together.
FIT_ROWS = 6000
CENTROIDS, ROUNDS, REJECT, SHARP = 4, 12, 0.002, 20.0
#: Code points counted at once; a longer text is counted in pieces of this length, which overlap by two.
PIECE = 1 << 18
UNKNOWN = "und"


def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x3000)], dtype=bool)


_LETTER = _letters()


def counts(text: str) -> np.ndarray | None:
    """Hashed n-gram counts of a whole text, or None if it has no letter."""
    p = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    letter = _LETTER[np.minimum(p, 0x2FFF)] | (p >= 0x3000)
    if (p >= 0x3000).any():
        far = np.flatnonzero(p >= 0x3000)
        letter[far] = [chr(c).isalpha() for c in p[far].tolist()]
    if not letter.any():
        return None
    p = np.where(letter, p, 32).astype(np.uint32)
    keep = np.ones(len(p), dtype=bool)
    keep[1:] = letter[1:] | letter[:-1]
    p = p[keep]
    p = np.concatenate([[32], p[int(p[0] == 32) : len(p) - int(p[-1] == 32)], [32]]).astype(np.uint32)
    out = np.zeros(DIMS, dtype=np.float64)
    for s in range(0, len(p), PIECE):
        q = p[s : s + PIECE + 2]
        here = len(p[s : s + PIECE])
        one = q * np.uint32(2654435761)
        two = (one[:-1] ^ (q[1:] * np.uint32(2246822519))) * np.uint32(3266489917)
        three = (two[:-1] ^ (q[2:] * np.uint32(668265263))) * np.uint32(374761393)
        for h in (one, two, three):
            out += np.bincount(h[:here] >> np.uint32(20), minlength=DIMS)
    return out


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    least: np.ndarray


def _normed(log: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF vectors of length 1 from logarithms of counts, in place."""
    log *= idf
    log /= np.maximum(np.linalg.norm(log, axis=1, keepdims=True), 1e-12)
    return log


def _vectors(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _normed(np.log1p(c).astype(np.float32), idf)


def _kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from the points that lie farthest from each other."""
    c = [x.mean(axis=0)]
    near = x @ c[0]
    for _ in range(min(k, len(x)) - 1):
        c.append(x[int(near.argmin())])
        near = np.maximum(near, x @ c[-1])
    c = np.stack(c)
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (own == j).any():
                c[j] = x[own == j].mean(axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    used = np.unique((x @ c.T).argmax(axis=1))
    return c[used]


def fit(documents: DataFrame, train: Column, rows: int = FIT_ROWS) -> Model | None:
    """Fit on the rows for which train holds, of known language and with a letter."""
    own = documents.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("_h"))
    sizes = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    each = rows / len(sizes)
    share = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, min(1.0, each / n))]), F.col("lang")), F.lit(0.0))
    sample = own.where((F.col("_h") / float(1 << 63)) < share * 2 - 1).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(lang, c) for lang, t in zip(*[x.to_pylist() for x in b.columns], strict=True) if (c := counts(t)) is not None]
            # The dimensions that occur, and the logarithms of their counts.
            at = [np.flatnonzero(c) for _, c in rows]
            log = [np.log1p(c[k]).astype("<f4") for (_, c), k in zip(rows, at, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.string()), pa.array([k.astype("<u2").tobytes() for k in at], pa.binary()), pa.array([v.tobytes() for v in log], pa.binary())], names=["lang", "at", "log"])

    got = sorted((r["lang"], bytes(r["at"]), bytes(r["log"])) for r in arrow_map(sample, run, "lang string, at binary, log binary").collect())
    if not got:
        return None
    c = np.zeros((len(got), DIMS), dtype=np.float32)
    for row, (_, at, log) in zip(c, got, strict=True):
        row[np.frombuffer(at, "<u2")] = np.frombuffer(log, "<f4")
    idf = (np.log((1 + len(c)) / (1 + np.count_nonzero(c, axis=0))) + 1).astype(np.float32)
    x = _normed(c, idf)
    names = np.array([lang for lang, *_ in got])
    langs, cents, owner = sorted(set(names)), [], []
    for i, lang in enumerate(langs):
        k = _kmeans(x[names == lang], CENTROIDS)
        cents.append(k)
        owner += [i] * len(k)
    centroids, owner = np.concatenate(cents).astype(np.float32), np.array(owner)
    sims = x @ centroids.T
    least = np.array([np.quantile(sims[names == lang][:, owner == i].max(axis=1), REJECT) for i, lang in enumerate(langs)])
    return Model([str(v) for v in langs], idf.astype(np.float32), centroids, owner, least)


def predict(documents: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score (how far the best language leads, as a share of 1), cosine and rejected of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 512):
                b = whole.slice(s, 512)
                got = [None if t is None or model is None else counts(t) for t in b.column(1).to_pylist()]
                at = [i for i, c in enumerate(got) if c is not None]
                lang, score, cos, rejected = [UNKNOWN] * len(got), np.zeros(len(got)), np.zeros(len(got)), np.zeros(len(got), dtype=bool)
                if at:
                    sims = _vectors(np.stack([got[i] for i in at]), model.idf) @ model.centroids.T
                    best = np.stack([sims[:, model.owner == i].max(axis=1) for i in range(len(model.langs))], axis=1).astype(np.float64)
                    top = best.argmax(axis=1)
                    p = np.exp(SHARP * (best - best.max(axis=1, keepdims=True)))
                    score[at] = 1 / p.sum(axis=1)
                    cos[at] = best.max(axis=1)
                    rejected[at] = best.max(axis=1) < model.least[top]
                    for i, k in zip(at, top.tolist(), strict=True):
                        lang[i] = model.langs[k]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(cos), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "cosine", "rejected"])

    return arrow_map(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, lang_pred string, score double, cosine double, rejected boolean")

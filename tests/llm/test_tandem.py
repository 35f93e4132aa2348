"""Periodic runs: against all periods tried at all places, on random words and on the tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from trivane.llm import queries, tandem

TABLES = "/root/testdata/sf0.001"


def brute(w: list, least: int, exponent: int) -> list[tuple[int, int, int]]:
    """Every maximal stretch of every period; a stretch whose smallest period is another one doesn't count."""
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, exponent * q) and not any(all(w[t] == w[t + r] for t in range(i, i + length - r)) for r in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least,exponent", [(24, 3), (2, 2), (6, 2), (9, 3), (8, 4)])
def test_runs_equal_brute_force(least, exponent):
    rng = random.Random(least)
    for _ in range(250):
        texts = []
        for _ in range(rng.randint(0, 5)):
            w = [str(rng.randrange(rng.choice([1, 2, 3, 5]))).encode() for _ in range(rng.randint(0, 80))]
            if w and rng.random() < 0.5:
                a, p = rng.randrange(len(w)), rng.randint(1, max(1, len(w) // 3))
                w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
            if rng.random() < 0.4:
                w = w + [b"x"] + w + w[: rng.randint(0, len(w))]
            texts.append(w)
        assert tandem.runs_of_texts(texts, least, exponent) == [brute(w, least, exponent) for w in texts]


def expected(doc_id, text):
    words = [w for w in re.split("[ \t-\r]+", text or "") if w]
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words, 24, 3)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if found else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


COLUMNS = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").collect()
    rows = [r for r in rows if len((r["text"] or "").split()) < 1500]
    kept = {r["doc_id"] for r in rows}
    got = queries.op13_tandem(spark, TABLES)
    assert got.columns == COLUMNS
    assert sorted(tuple(r) for r in got.collect() if r["doc_id"] in kept) == sorted(expected(*r) for r in rows)


def test_odd_rows(spark):
    line = "one two three four "
    texts = [None, "", " \t\n", line * 9, line * 9, "a" * 100_000, "word " * 5000, "x\x1cy z " * 30, "　", "é ü " * 12 + line * 8 + "end"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, line * 10), (3, None), (3, line * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("clash")).withColumn("a.b", F.lit(1))
    got = tandem.digest(tandem.find(df, tandem.planted)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[7])
    assert sorted((tuple(r) for r in got), key=key) == sorted((expected(*r) for r in rows), key=key)
    assert tandem.digest(tandem.find(df.limit(0), tandem.planted)).count() == 0


def test_texts_keep_what_is_no_repetition(spark):
    df = spark.createDataFrame([(1, "so it goes  on " * 10 + "until here")], "doc_id long, text string")
    row = tandem.find(df).first()
    assert row["text"] == "so it goes on until here" and row["words"] == 42
    assert [tuple(r) for r in row["runs"]] == [(0, 40, 4)]

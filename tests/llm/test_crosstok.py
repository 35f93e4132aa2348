"""Alignment of tokens against whole texts encoded by both libraries, and pair counts by plain dictionaries."""

from __future__ import annotations

import hashlib
import random
import tracemalloc
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trivane.llm import crosstok, queries

TABLES = "/root/testdata/sf0.001"
COLUMNS = [c.split()[0] for c in crosstok.COLUMNS.split(", ")]


@pytest.fixture(scope="module")
def pair():
    return crosstok.Pair(*crosstok.default_tokenizers())


def whole(pair, text):
    """Groups of a text, by the sets of byte offsets at which tokens end, without segments; None if it isn't spelt."""
    if not text:
        return None
    a = pair.a.encode(" " + text, add_special_tokens=False).ids
    b = pair.b.encode(text)
    raw = (" " + text).encode()
    if pair.spelt(a, True) != raw or pair.spelt(b, False) != raw:
        return None

    def ends(ids, table):
        out, n = [], 0
        for i in ids:
            n += len(table[i])
            out.append(n)
        return out

    ea, eb = ends(a, pair.a_bytes), ends(b, pair.b_bytes)
    both = sorted(set(ea) & set(eb))
    out, low = [], 0
    for high in both:
        out.append(([i for i, x in zip(a, ea, strict=True) if low < x <= high], [i for i, x in zip(b, eb, strict=True) if low < x <= high]))
        low = high
    return out


def expected(pair, rows):
    cut = [(i, whole(pair, t)) for i, t in rows]
    holds = Counter()
    for _, g in cut:
        holds.update({(p, q) for x, y in g or () for p in x for q in y})
    most = {}
    for (p, _), n in holds.items():
        most[p] = max(n, most.get(p, 0))
    out = []
    for i, g in cut:
        if g is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(p, q) for x, y in g for p in x for q in y]
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g)
        sizes = (sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links))
        out.append((i, *sizes, sum(holds[k] == most[k[0]] for k in links), sum(holds[k] for k in links), hashlib.sha256(text.encode()).hexdigest()))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:])


def odd():
    rng = random.Random(3)
    pieces = ["a", "b ", " ", "\n", "\t", "\r\n", "é", "日本", "🙂", " ", "　", "the", "'s", "<s>", "<|endoftext|>", "<0x0A>", "12", "...", "​", "\x1c", "\x85", "\x00", "A" * 30, " \n", "\n\n "]
    rows = [(k, "".join(rng.choice(pieces) for _ in range(rng.randint(1, 40)))) for k in range(90)]
    return rows + [(None, "no id"), (None, None), (5, None), (6, ""), (7, " "), (8, "  "), (9, "\n"), (10, "x ▁ y"), (11, "same text"), (11, "same text"), (12, "ab" * 20_000), (13, "word " * 3000), (14, "z" * 5000 + "\n" * 500)]


def test_vocabularies_allow_the_cuts(pair):
    assert pair.cuts == " \n"
    assert crosstok.boundaries([b"a b"], ["▁a"]) == "\n"
    assert crosstok.boundaries([b" a"], ["a▁"]) == "\n"
    assert crosstok.boundaries([b" a"], ["▁a", "x\n"]) == " "
    assert crosstok.boundaries(["   ".encode()], ["▁▁a"]) == " \n"


@pytest.mark.parametrize("block", [300, 1 << 20])
def test_odd_rows(spark, pair, block):
    rows = odd()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit(7)).withColumn("block", F.lit("clash")).withColumn("a.b", F.lit(1)).repartition(3)
    got = crosstok.align(df, block=block, texts=block > 300)
    assert got.columns[:8] == COLUMNS
    assert sorted((tuple(r)[:8] for r in got.collect()), key=key) == sorted(expected(pair, rows), key=key)
    if block > 300:
        assert all(hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] for r in got.collect() if r["n_a"])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert crosstok.align(none).columns == COLUMNS and crosstok.align(none).count() == 0
    assert [tuple(r) for r in crosstok.align(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_query_equals_whole_texts(spark, pair):
    rows = [tuple(r) for r in spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op12_crosstok(spark, TABLES)
    assert got.columns == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(expected(pair, rows), key=key)


def test_memory_of_an_alignment(pair):
    """What is kept of a segment is its groups as text and numbers of eight bytes; no objects of the tokenizers pile up."""
    rng = random.Random(5)
    segments = [(" " + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(24))).encode() for _ in range(20_000)]
    crosstok.aligned(segments[:100], pair)
    tracemalloc.start()
    texts, counts, pairs = crosstok.aligned(segments, pair)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(texts) == 20_000 and counts[:, 5].sum() == len(pairs) > 200_000
    assert peak < 60 * len(pairs) + sum(map(len, texts)) + 100 * len(texts)

"""The Pitman-Yor model: seats against enumeration, probabilities that add up to 1, closed forms, held-out texts."""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trivane.llm import blocks, pitman_yor, queries
from trivane.llm.pitman_yor import END, Part

COLUMNS = [n for n, _ in pitman_yor.OUT]


def seatings(n, d):
    """The weight of all ways to seat n customers, by number of tables, by going through them."""
    out = Counter()
    for choice in itertools.product(*(range(i + 1) for i in range(n))):
        sizes, weight = [], 1.0
        for c in choice:
            if c > len(sizes):
                break
            if c == len(sizes):
                sizes.append(1)
            else:
                weight *= sizes[c] - d
                sizes[c] += 1
        else:
            out[len(sizes)] += weight
    return out


@pytest.mark.parametrize("d", [0.2, 0.7])
def test_tables_follow_the_conditional(d):
    table = pitman_yor.stirling(d, 8)
    want = seatings(5, d)
    assert np.allclose(np.exp(table[5, :5]), [want[t] for t in range(1, 6)])
    rng = np.random.default_rng(1)
    a = 0.8
    got = np.bincount(pitman_yor.seat(np.full(40_000, 5), np.full(40_000, a), d, table, rng), minlength=6)[1:] / 40_000
    exact = np.array([want[t] * a**t for t in range(1, 6)])
    assert np.abs(got - exact / exact.sum()).max() < 0.012
    # Beyond the table: between one table and as many as customers, more for a larger weight.
    many = [pitman_yor.seat(np.full(200, 5000), np.full(200, x), d, table, rng).mean() for x in (0.01, 1.0, 100.0)]
    assert 1 <= many[0] < many[1] < many[2] <= 5000


def parts_of(texts, marks, contexts, parts):
    known: dict[bytes, int] = {}
    codes = [np.array([known.setdefault(t, len(known)) for t in pitman_yor.tokens(x)]) for x in texts]
    told = pitman_yor.pairs_of_block(contexts)(list(known), codes, marks)
    of = np.array([zlib.crc32(t) % parts for t in known])
    names = list(known)
    out = []
    for p in range(parts):
        own = np.flatnonzero(of == p)
        if len(own):
            out.append((p, Part([{"block": 0, "data": blocks.pack_tokens([names[i] for i in own]), "codes": blocks.pack(own.astype("<u4")), "more": blocks.pack(told(own))}], contexts)))
    return out


def test_probabilities_add_up_to_one():
    words = [f"w{k}" for k in range(12)]
    texts = [" ".join(words[(i * j) % 12] for j in range(i % 9)) for i in range(60)]
    every = [f"{u} {w}" for u in words for w in words]  # each pair is asked for, outside the training texts
    contexts = 7
    parts = parts_of(texts + every, [True] * len(texts) + [False] * len(every), contexts, 3)
    times = sum(np.bincount(p.context, weights=p.times, minlength=contexts) for _, p in parts)
    kinds = sum(np.bincount(p.context, weights=p.times > 0, minlength=contexts) for _, p in parts)
    v = sum(len({w for w, t in zip(p.word, p.times, strict=True) if t}) for _, p in parts)
    state = {"words": v, "discount": 0.4, "discount1": 0.7, "tables1": kinds, "times": times, "customers": kinds.sum(), "tables": v, "strength": 3.0, "strength1": 20.0}
    tallies = sum(pitman_yor.tally(p, state, n, 1, 4) for n, p in parts).reshape(4, contexts + 1)
    total, pairs = np.zeros(contexts), Counter()
    for n, p in parts:
        np.add.at(total, p.context, pitman_yor.predictive(p, state, tallies, n, 1, 4))
        pairs.update(p.context.tolist())
    # Any other word, and words that no pair of the context has.
    s0, s1, d0, d1 = 3.0, 20.0, 0.4, 0.7
    rest = np.zeros(contexts)
    for row in tallies:
        other = (s0 + d0 * row[-1]) / (v + 1) / (s0 + row[:-1].sum())
        rest += (s1 + d1 * row[:-1]) * other / (s1 + times) / 4
    full = np.array([pairs[k] == v for k in range(contexts)])
    assert full.sum() >= 3
    assert np.allclose((total + rest)[full], 1.0)


def base(rows):
    cut = [(i, [w for w in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] + [END]) for i, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in cut]
    count = Counter(w for (_, x), h in zip(cut, held, strict=True) if not h for w in x)
    n, v = sum(count.values()), len(count)
    return [(i, h, len(x), sum(count[w] > 0 for w in x), n, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x)) for (i, x), h in zip(cut, held, strict=True)]


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(g[:5]) == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in queries.op11_pitman_yor(spark, sf).collect()]
    same(got, base(rows))
    assert all(r[6] < 0 and r[7] == pytest.approx(10 ** (-r[6] / r[2])) for r in got)
    held = [r for r in got if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)
    assert sorted(got, key=repr) == sorted((tuple(r) for r in queries.op11_pitman_yor(spark, sf).collect()), key=repr)


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_odd_rows(spark, block):
    rows = [(1, "Ab aB\tab\n"), (2, None), (3, ""), (None, "no id"), (4, "same"), (4, "same"), (5, "x " * 20_000), (6, "y" * 100_000), (7, "É é\x1cq　z"), (8, "one two three")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("mark", F.lit("clash")).withColumn("part", F.lit(1)).withColumn("a.b", F.lit(1)).repartition(2)
    got = pitman_yor.score(df, pitman_yor.not_held_out(), block=block)
    assert got.columns == COLUMNS
    same([(r[0], not r[1], *r[2:]) for r in got.collect()], base(rows))
    assert all(math.isfinite(r["score"]) and r["score"] <= 1e-9 for r in got.collect())


def test_no_texts_and_no_training_texts(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pitman_yor.score(none, pitman_yor.not_held_out()).columns == COLUMNS
    assert pitman_yor.score(none, pitman_yor.not_held_out()).count() == 0
    got = pitman_yor.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(False)).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got] == [(3, 0, 0, 0.0, 0.0)]


def test_closed_form_of_words_that_occur_once(spark):
    """Every customer sits alone, so there is nothing to sample: one text of different words, and one held out."""
    df = spark.createDataFrame([(1, "a b c d e"), (2, "a q")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in pitman_yor.score(df, F.col("doc_id") == 1, contexts=1).collect()}
    v, d = 6, 0.95
    fits = []
    for s0, s1 in itertools.product(pitman_yor.STRENGTHS, repeat=2):
        p = lambda known: (known * (1 - d) + (s0 + d * v) / (v + 1)) / (s0 + v)
        q = lambda known: math.log10((known * (1 - d) + (s1 + d * v) * p(known)) / (s1 + v))
        fits.append(abs(got[1] - 6 * q(1)) + abs(got[2] - 2 * q(1) - q(0)))
    assert min(fits) < 1e-5


def test_contexts_are_words(spark):
    """Words of one class of 1,024 keep restaurants of their own: what follows the one says nothing of the other."""
    seen = {}
    for k in itertools.count():
        u, v = f"u{k}", seen.setdefault(zlib.crc32(b"u%d" % k) % 1024, f"u{k}")
        if u != v:
            break
    rows = [(k, " ".join([f"{u} x"] * 30)) for k in range(20)] + [(k, " ".join([f"{v} y"] * 30)) for k in range(20, 40)]
    rows += [(100, f"{u} x"), (101, f"{u} y")]
    got = {r["doc_id"]: r["score"] for r in pitman_yor.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 100).collect()}
    assert got[100] - got[101] > 1


def test_closed_form_of_contexts_that_are_words(spark):
    """Every pair occurs once, so there is nothing to sample."""
    df = spark.createDataFrame([(1, "a b c d e"), (2, "a q")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in pitman_yor.score(df, F.col("doc_id") == 1).collect()}
    v, d = 6, 0.95
    fits = []
    for s0, s1 in itertools.product(pitman_yor.STRENGTHS, repeat=2):
        p = [(known * (1 - d) + (s0 + d * v) / (v + 1)) / (s0 + v) for known in (0, 1)]
        pair = lambda times, known: (times * (1 - d) + (s1 + d) * p[known]) / (s1 + 1)
        want = 6 * math.log10(pair(1, 1)), math.log10(pair(1, 1) * pair(0, 0) * p[1])
        fits.append(abs(got[1] - want[0]) + abs(got[2] - want[1]))
    assert min(fits) < 1e-5


def test_scores_of_one_class_add_up_to_one(spark):
    """With one context, a text of one word has the probabilities of that word and of the end."""
    words = [f"w{k}" for k in range(9)]
    rows = [(k, " ".join(words[(k * j + j * j) % 9] for j in range(k % 11))) for k in range(60)]
    rows += [(100 + k, w) for k, w in enumerate([*words, "other", ""])]
    got = {r["doc_id"]: r["score"] for r in pitman_yor.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 100, contexts=1, block=200).collect()}
    end = got[100 + len(words) + 1]
    assert sum(10 ** (got[100 + k] - end) for k in range(len(words) + 1)) + 10**end == pytest.approx(1.0, rel=1e-6)

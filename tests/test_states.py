from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from trivane.functions import states as S


def column(spark, expr, **values):
    names = list(values)
    df = spark.createDataFrame(list(zip(*values.values(), strict=True)), ", ".join(f"{n} {'boolean' if isinstance(next((v for v in values[n] if v is not None), True), bool) else 'string' if isinstance(next((v for v in values[n] if v is not None), ''), str) else 'double'}" for n in names))
    return [r[0] for r in df.select(expr).collect()]


def test_combine_over_all_triples(spark):
    states = ("valid", "invalid", "unknown", None)
    every = list(itertools.product(states, repeat=3))
    df = spark.createDataFrame(every, "a string, b string, c string")
    got = [r[0] for r in df.select(S.combine(["a", "b", "c"], "valid", "invalid")).collect()]
    want = ["unfavorable" if "invalid" in x else "favorable" if all(s == "valid" for s in x) else "other" for x in every]
    assert got == want


def test_kleene_and_is_three_valued(spark):
    pairs = list(itertools.product((True, False, None), repeat=2))
    df = spark.createDataFrame(pairs, "a boolean, b boolean")
    want = [False if False in p else None if None in p else True for p in pairs]
    assert [r[0] for r in df.select(S.kleene_and("a", "b")).collect()] == want


@pytest.mark.parametrize("values,want", [([True, True], True), ([True, None], None), ([None, False], False), ([None], None), ([True], True)])
def test_all_true_keeps_unknown(spark, values, want):
    df = spark.createDataFrame([(v,) for v in values], "x boolean")
    assert df.agg(S.all_true(F.col("x"))).first()[0] is want


@pytest.mark.parametrize("p,f,u,score,state", [(0, 0, 0, None, "none"), (1, 0, 0, 1.0, "pass"), (0, 1, 0, 0.0, "fail"), (0, 0, 1, 0.0, "none"), (1, 0, 1, 0.5, "none")])
def test_io_edges(spark, p, f, u, score, state):
    df = spark.createDataFrame([(p, f, u)], "k_passed long, k_failed long, k_unresolved long")
    assert tuple(df.select(S.io_score("k"), S.io_state("k_passed", "k_failed", "k_unresolved")).first()) == (score, state)


def test_number_and_unit_reject_what_is_no_score(spark):
    df = spark.createDataFrame([(1.0 + 5e-13,), (None,)], "x double")
    assert [r[0] for r in df.select(S.unit("x")).collect()] == [1.0, None]
    for bad in (1.1, float("nan"), float("inf")):
        with pytest.raises(Exception, match="score outside|finite"):
            spark.createDataFrame([(bad,)], "x double").select(S.unit("x")).collect()


def test_witness_truth_table(spark):
    tri = (True, False, None)
    every = [(d, *v) for d in ("pre_strengthening", "pre_omission", "pre_weakening", "post_strengthening", "post_weakening") for v in itertools.product(tri, repeat=4)]
    df = spark.createDataFrame(every, "d string, bp boolean, mp boolean, bc boolean, mc boolean")
    got = [r[0] for r in df.select(S.witness("d", "bp", "mp", "bc", "mc")).collect()]

    def want(d, bp, mp, bc, mc):
        if d == "pre_strengthening":
            return bp is True and mp is False
        if d.startswith("pre"):
            return bp is False and mp is True
        if bp is not True or mp is not True:
            return False
        return (bc, mc) == ((True, False) if d == "post_strengthening" else (False, True))

    assert got == [want(*x) for x in every]


def test_f1_edges(spark):
    df = spark.createDataFrame([(0.0, 0.0), (None, 1.0), (1.0, 0.5)], "p double, r double")
    got = [r[0] for r in df.select(S.f1("p", "r")).collect()]
    assert got[:2] == [0.0, None] and abs(got[2] - 2 / 3) < 1e-12

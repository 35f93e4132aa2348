"""Steps, folds, walks, libraries and stateful records on small inputs, against plain loops."""

from __future__ import annotations

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from trivane.functions import library, parsing, walks
from trivane.operators import joins, redundancy, search
from trivane.streaming import records


# deletions to a fix-point


def plain_minimise(ids, outcomes, limit):
    """The search of one program, step by step; outcomes by set of removed ids."""
    if outcomes.get(frozenset(), ("",))[0] != "verified":
        return ("skipped", 0, 0, 0, len(ids), 0, 0, "")
    if not ids:
        return ("no_testable_clauses", 0, 0, 0, 0, 0, 0, "")
    used = checks = 0
    removable, necessary, gone = [], [], []
    for i in ids:
        if used >= limit:
            break
        outcome, front = outcomes.get(frozenset([i]), ("", None))
        used += 1
        asked = outcome == "proof_failed" and used < limit
        used, checks = used + asked, checks + asked
        if outcome == "verified":
            removable.append(i)
        elif asked and front:
            necessary.append(i)
    if removable and used < limit:
        used += 1
        if outcomes.get(frozenset(removable), ("",))[0] == "verified":
            gone = list(removable)
    changed = bool(removable)
    while changed and used < limit:
        changed = False
        for i in ids:
            if i in gone:
                continue
            if used >= limit:
                break
            used += 1
            if outcomes.get(frozenset([*gone, i]), ("",))[0] == "verified":
                gone.append(i)
                changed = True
                break
    unknown = len(set(ids) - set(removable) - set(necessary) - set(gone))
    status = "partial" if unknown or used >= limit else "ok"
    return (status, len(gone), len(ids) - unknown - len(gone), unknown, len(ids) - len(gone), used, checks, ",".join(map(str, gone)))


def test_deletions_against_a_plain_search(spark):
    rng = random.Random(4)
    programs, candidates, verdicts, want = [], [], [], {}
    for p in range(120):
        ids = sorted(rng.sample(range(1, 30), rng.randint(0, 6)))
        outcomes = {}
        for k in range(len(ids) + 1):
            for s in itertools.combinations(ids, k):
                if rng.random() < 0.9:
                    good = 0.97 if not k else 0.55
                    outcomes[frozenset(s)] = ("verified", None) if rng.random() < good else rng.choice([("proof_failed", True), ("proof_failed", False), ("timeout", None)])
        limit = rng.choice([1, 2, 3, 5, len(ids) + 1, 60])
        name = f"p{p}"
        programs.append((name,))
        candidates += [(name, i, limit) for i in ids]
        verdicts += [(name, ",".join(map(str, sorted(s))), *o) for s, o in outcomes.items()]
        want[name] = plain_minimise(ids, outcomes, limit)
    got = redundancy.minimised(
        spark.createDataFrame(programs, "program string"),
        spark.createDataFrame(candidates, "program string, id long, most int"),
        spark.createDataFrame(verdicts, "program string, removed string, outcome string, frontend boolean"),
        "program",
        F.col("most"),
    ).collect()
    assert len(got) == len(want)
    for r in got:
        assert tuple(r[c] for c in ("status", "removed", "necessary", "unknown", "minimal_size", "attempts", "frontend_checks", "removed_ids")) == want[r["program"]], r["program"]


def test_deletions_of_nothing(spark):
    none = lambda s: spark.createDataFrame([], s)
    out = redundancy.minimised(none("u string"), none("u string, id long"), none("u string, removed string, outcome string, frontend boolean"), "u")
    assert out.count() == 0


# ordered matches


def plain_match(left, right):
    cursor, out = 0, []
    for k in left:
        at = next((i for i in range(cursor, len(right)) if right[i] == k), None)
        if at is None:
            break
        out.append(at)
        cursor = at + 1
    return out


def test_ordered_match_against_a_plain_cursor(spark):
    rng = random.Random(2)
    left, right, want = [], [], {}
    for u in range(60):
        a, b = ([rng.choice("xyz") for _ in range(rng.randint(0, 9))] for _ in range(2))
        left += [(u, k, 10 * i) for i, k in enumerate(a)]
        right += [(u, k, i) for i, k in enumerate(b)]
        if a:
            want[u] = (plain_match(a, b), len(a))
    schema = "unit long, k string, pos long"
    got = joins.ordered_match(spark.createDataFrame(left, schema).repartition(4), spark.createDataFrame(right, schema).repartition(3), "unit", ["k"], "pos").collect()
    assert {r["unit"]: ([p["right_pos"] for p in r["pairs"]], r["matched"], r["complete"]) for r in got} == {u: (m, len(m), len(m) == n) for u, (m, n) in want.items()}


def test_crossing_items_end_the_match(spark):
    schema = "unit string, k string, pos long"
    left = spark.createDataFrame([("u", "B", 0), ("u", "A", 1)], schema)
    right = spark.createDataFrame([("u", "A", 0), ("u", "B", 1)], schema)
    row = joins.ordered_match(left, right, "unit", ["k"], "pos").first()
    assert [tuple(p) for p in row["pairs"]] == [(0, 1)] and row["matched"] == 1 and not row["complete"]


# walks


def test_walk_hands_context_down(spark):
    parsing.ready(spark)
    check = {"holds": None, "status": "s", "lemma_harness_version": 1}
    deep = {"function": "f", "requires": {"clause": {"normalized": "a", "text": "b"}, "x": dict(check, reason="r")}}
    for _ in range(400):
        deep = {"k": [deep]}
    value = [deep, {"ground": [{"function": "g", "gen_pre_implies_ground_pre": dict(check, clause="x>1", holds=True), "other": {"holds": True, "status": "s"}}]}, dict(check, engine="e"), {"holds": False, "status": "s", "reason": "malformed_clause", "check_name": "n"}]
    own = {"holds": False, "status": "s", "obligation_context": {"check_name": "q_ensures_3", "antecedent": ["a  <b"], "consequent": [], "consequent_kinds": ["", "ensures"]}, "sub": dict(check)}
    rows = spark.createDataFrame([(1, json.dumps(value)), (2, json.dumps([own, own])), (3, None), (4, "no json"), (5, "3")], "id long, js string")
    got = rows.lateralJoin(walks.walk(F.col("js").outer())).collect()
    one = [(r["function"], r["kind"], r["direction"], list(r["consequent"]), r["verdict"], r["origin"]) for r in got if r["id"] == 1]
    assert one == [
        ("f", "requires", "implication", ["a"], "unknown", "contextual_check"),
        ("g", "", "gen_pre_implies_ground_pre", ["x > 1"], "valid", "ground_self_check"),
        ("", "", "implication", [], "unknown", "contextual_check"),
        ("", "", "n", [], "invalid", "contextual_check"),
    ]
    two = [(r["kind"], r["direction"], r["slot"], list(r["antecedent"]), r["path"]) for r in got if r["id"] == 2]
    assert two == [("ensures", "q_ensures_3", "3", ["a < b"], "0"), ("ensures", "q_ensures_3", "3", [], "0.sub")]
    assert {r["id"] for r in got} == {1, 2}


def test_checks_are_those_of_the_walk_with_the_fields_asked_for(spark):
    parsing.ready(spark)
    check = {"holds": True, "status": "s", "lemma_harness_version": 1, "clause": "x  >1"}
    value = {"function": "f", "ground": {"ensures": [check, {"a": [1, "b", None, check]}]}, "gen_pre_implies_ground_pre": [dict(check, holds=None, sub=dict(check, clause_kind="k"))]}
    rows = spark.createDataFrame([(1, json.dumps(value)), (2, json.dumps({"k": [value, check]})), (3, None), (4, "no json"), (5, "3")], "id long, js string")
    want = rows.lateralJoin(walks.walk(F.col("js").outer(), F.lit("m")))
    for fields in (tuple(walks.FIELDS), ("verdict", "obligation"), ("path",)):
        got = rows.select("*", F.inline(walks.checks(F.col("js"), F.lit("m"), fields=fields)))
        assert got.columns == ["id", "js", *fields]
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select("id", "js", *fields).collect())) != []


def test_texts_that_are_walked_are_not_shuffled(spark, sf):
    from trivane import catalog

    plan = catalog.QUERIES["h03_walk"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    head, grouped, below = plan.partition("Aggregate [")
    assert grouped and "repeat(" in head and "repeat(" not in below and "concat(" not in below.split("Project [")[0]


def test_harness_tags(spark):
    rows = [
        ("unknown", {"category": "return_name"}, "", ["H1"]),
        ("valid", {"category": "return_name"}, "", []),
        ("unknown", {"category": "return_type", "t": "(u8, )"}, "", ["H2"]),
        ("unknown", {"error": "dangling_>"}, "a::b<c> ", ["H3"]),
        ("unknown", {"phase": "harness_frontend"}, "if a\n&& b", ["H4"]),
        ("unknown", {"candidate_vstd_globs": ["x"]}, "", ["H5"]),
        ("unknown", {"candidate_vstd_globs": [], "support_issue": "unsafe_generated_import", "reason": "malformed_clause"}, "a <==> b", ["H5", "H6"]),
        ("unknown", {}, "a <==> b", []),
    ]
    df = spark.createDataFrame([(i, v, json.dumps(c), t) for i, (v, c, t, _) in enumerate(rows)], "i int, v string, c string, t string")
    got = df.select("i", walks.harness_tags(F.col("c"), F.col("v"), F.col("t")).alias("x")).collect()
    assert {r["i"]: list(r["x"]) for r in got} == {i: r[3] for i, r in enumerate(rows)}


# libraries


def test_records_of_a_source():
    text = """
/// Takes.
///   Twice.
#[verifier]
pub broadcast proof fn a(s: Seq<int>)
    requires
        s.len() > 0,
        f(s, 1)
    ensures
        #[trigger] s.take(1) == s,
        true,
{
    if (x) { b(); M::N::c(); old(s) }
}
pub axiom fn d()
    ensures forall|i: int| g(i);
pub open spec fn e() -> bool { h(1) }
fn hidden() { pub_call() }
pub exec fn open_end() { z(
"""
    got = {r["name"]: r for r in library.records(text)}
    assert list(got) == ["a", "d", "e", "open_end"]
    a = got["a"]
    assert (a["kind"], a["doc"], a["requires"], a["ensures"], a["triggers"], a["callees"], a["line"]) == ("broadcast_proof", "Takes.\nTwice.", ["s.len() > 0", "f(s, 1)"], ["#[trigger] s.take(1) == s", "true"], ["s.take(1"], ["b", "c"], 1)
    assert a["signature"].startswith("pub broadcast proof fn a(s: Seq<int>)") and a["keywords"] == ["Seq", "len", "take", "trigger"]
    assert got["d"]["ensures"] == ["forall|i: int| g(i)"] and got["d"]["body"] is None and got["d"]["callees"] == []
    assert (got["e"]["kind"], got["e"]["callees"], got["e"]["body"]) == ("open_spec", [], "{ h(1) }")
    assert got["open_end"]["body"] is None
    assert list(library.records("")) == []


@pytest.mark.parametrize("terms", ["steel", "the of", "st e", "eel ss", "zzz q", "a", "brand x1 steel", "  "])
def test_postings_leave_what_the_scan_finds(spark, terms):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["steel", "Brand", "x1", "ss", "e", ""]) for _ in range(rng.randint(0, 4))), rng.choice([None, "brand doc", "st"])) for i in range(80)] + [(90, None, None)]
    lib = spark.createDataFrame(rows, "id long, text string, doc string")
    args = ("id", F.coalesce("text", F.lit("")), F.col("doc"))
    scan = sorted(map(tuple, search.full_text(lib, terms, *args).collect()))
    postings = search.gram_postings(lib, "id", args[1])
    assert sorted(map(tuple, search.full_text_indexed(lib, postings, terms, *args).collect())) == scan
    best = search.full_text_indexed(lib, postings, terms, *args, top=7).collect()
    assert [tuple(r) for r in best] == sorted(scan, key=lambda r: (-r[4], r[0]))[:7]


def test_search_reads_postings(spark, tmp_path):
    lib = spark.range(2000).select("id", F.concat(F.lit("name "), F.col("id")).alias("text"))
    search.gram_postings(lib, "id", F.col("text")).write.parquet(str(tmp_path / "p"))
    plan = search.full_text_indexed(lib, spark.read.parquet(str(tmp_path / "p")), "1999", "id", F.col("text"), F.lit(None).cast("string"))._jdf.queryExecution().toString()
    assert "In(gram, [199,999])" in plan and plan.count("LeftSemi") >= 1


# stateful records


def test_record_rows():
    assert records.row_of("r", {"b": 1.0, "a": 2.5}, 3, ("a", "b")) == {"record": "r", "status": "complete", "metrics": "a,b", "total": 3.5, "events": 3, "missing": ""}
    assert records.row_of("r", {"b": 1.0}, 2, ("c", "a", "b"))["missing"] == "a,c"


# selection and sums by counting


def test_statistics_against_sorted_values(spark):
    from statistics import median

    from trivane.operators import aggregates

    rng = random.Random(8)
    rows = [("all", rng.choice([float(rng.randrange(50)), rng.gauss(0, 1e3), 10 ** rng.uniform(-9, 9)])) for _ in range(30_000)] + [("one", 2.5), ("two", 1.0), ("two", 4.0), (None, 7.0), (None, -1.0), (None, 0.0), ("none", None)]
    rows += [(f"g{n}", float(i * i % 17)) for n in range(3, 14) for i in range(n)]
    got = {r["k"]: r for r in aggregates.summary_statistics(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", 9).collect()}
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    assert set(got) == set(groups)
    for k, values in groups.items():
        values.sort()
        n, r = len(values), got[k]
        assert (r["scored"], r["min"], r["max"]) == (n, round(values[0], 9), round(values[-1], 9))
        assert (r["q25"], r["q75"], r["median"]) == (pytest.approx(values[n // 4], abs=1e-9), pytest.approx(values[3 * n // 4], abs=1e-9), pytest.approx(median(values), abs=1e-9)), k


def test_statistics_sort_no_group(spark):
    from trivane.operators import aggregates

    plan = aggregates.summary_statistics(spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("v")), ["k"], "v")._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan and "collect_list" not in plan


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_running_sums_over_parts(spark, keys):
    from trivane.operators.windows import running_sums

    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.randrange(9), rng.choice([None, 0.5, 2.0])) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, i long, x int, y double").repartition(7)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {r["i"]: (r["sx"], r["sy"]) for r in running_sums(df, keys, ["i"], {"sx": "x", "sy": "y"}).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sums = {}
    for k, i, x, y in rows:
        g = k if keys else 0
        a, b = sums.get(g, (0, 0.0))
        assert got[i] == (a, pytest.approx(b))
        sums[g] = (a + x, b + (y or 0))


def test_weights_are_the_draws(spark, monkeypatch):
    from collections import Counter
    from hashlib import md5

    from trivane.operators import statistics

    monkeypatch.setattr(statistics, "CHUNK", 7)
    monkeypatch.setattr(statistics, "SEGMENT", 4)
    sizes = spark.createDataFrame([("a", 19), ("b", 1), (None, 5), ("none", 0)], "g string, _n long")
    got = {(r["g"], r["_k"]): list(r["w"]) for r in statistics.weights(sizes, ["g"], 6, "s").collect()}
    want = Counter()
    for g, n in (("a", 19), ("b", 1), (None, 5)):
        for r in range(6):
            for i in range(n):
                want[g, int(md5(f"s|{r}|{i}".encode()).hexdigest()[:8], 16) % n, r] += 1
    assert got == {k: [want[*k, r] for r in range(6)] for k in {k[:2] for k in want}}

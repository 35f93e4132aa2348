from __future__ import annotations

import math
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from trivane.functions import registry
from trivane.operators import aggregates, joins, quality, statistics, texts, windows
from trivane.sources import scans, sinks
from trivane.streaming import incremental


def naive_counts(pairs):
    c = d = ta = tm = 0
    for i, (a, x) in enumerate(pairs):
        for b, y in pairs[:i]:
            if a == b:
                ta += x != y
            elif x == y:
                tm += 1
            elif (x > y) == a:
                c += 1
            else:
                d += 1
    return c, d, ta, tm


@pytest.mark.parametrize("seed", range(3))
def test_pair_counts_by_brute_force(spark, seed):
    rnd = random.Random(seed)
    data = [(rnd.random() < 0.4, rnd.randint(0, 6)) for _ in range(60)]
    df = spark.createDataFrame([("k", a, v) for a, v in data] + [("k", True, None)], "k string, acc boolean, v int")
    got = statistics.pair_counts(statistics.by_value(df, ["k"], "v", F.col("acc")), ["k"], "v")
    r = got.withColumn("tau", statistics.tau_b()).first()
    c, d, ta, tm = naive_counts(data)
    assert (r["concordant"], r["discordant"], r["t_acc"], r["t_met"]) == (c, d, ta, tm)
    assert r["tau"] == pytest.approx((c - d) / math.sqrt((c + d + ta) * (c + d + tm)))
    assert statistics.rank_tau(df, ["k"], "v", F.col("acc")).first()["tau"] == pytest.approx(r["tau"])


def test_tau_edges(spark):
    def tau(data):
        df = spark.createDataFrame(data, "k string, acc boolean, v int")
        return statistics.pair_counts(statistics.by_value(df, ["k"], "v", F.col("acc")), ["k"], "v").select(statistics.tau_b()).first()[0]

    assert tau([("k", True, 1), ("k", False, 1)]) is None  # all values tied
    assert tau([("k", True, 1), ("k", True, 2)]) is None  # one group
    assert tau([("k", True, 2), ("k", False, 1)]) == 1.0


@pytest.mark.parametrize("values", [[1], [1, 2], [3, 1, 2], [4, 3, 2, 1], [5, 4, 3, 2, 1]])
def test_quartiles_by_index(spark, values):
    df = spark.createDataFrame([("k", float(v)) for v in values], "k string, v double")
    r = aggregates.summary_statistics(df, ["k"], "v").first()
    s = sorted(values)
    assert (r["q25"], r["q75"]) == (s[len(s) // 4], s[3 * len(s) // 4])
    assert r["stdev"] == (0.0 if len(s) == 1 else round(math.sqrt(sum((v - sum(s) / len(s)) ** 2 for v in s) / (len(s) - 1)), 4))


@pytest.mark.parametrize("c,r,want", [("", "", 1.0), ("a b", "", 0.0), ("", "a", 0.0), ("a b c d e", "a b c d e", 1.0), ("x y", "a b", 0.0), ("a b", "a b", 1.0)])
def test_bleu_and_rouge_edges(spark, c, r, want):
    df = spark.createDataFrame([(1, c.split(), r.split())], "k int, c array<string>, r array<string>")
    assert texts.bleu(df, "k", "c", "r").first()["bleu"] == pytest.approx(want)
    assert texts.rouge_l(df, "k", "c", "r").first()["rouge"] == pytest.approx(want)


def test_bleu_smoothing_by_hand(spark):
    df = spark.createDataFrame([(1, "a b c x".split(), "a b c d e".split())], "k int, c array<string>, r array<string>")
    want = math.exp(1 - 5 / 4) * math.exp((math.log(3 / 4) + math.log(2 / 3) + math.log(1 / 2) + math.log(1 / 2)) / 4)
    assert texts.bleu(df, "k", "c", "r").first()["bleu"] == pytest.approx(want)


def test_lcs_by_brute_force(spark):
    rnd = random.Random(5)
    data = [(k, [rnd.choice("abc") for _ in range(rnd.randint(0, 12))], [rnd.choice("abc") for _ in range(rnd.randint(0, 12))]) for k in range(40)]

    def lcs(a, b):
        p = [0] * (len(b) + 1)
        for x in a:
            q = [0]
            for j, y in enumerate(b):
                q.append(p[j] + 1 if x == y else max(p[j + 1], q[-1]))
            p = q
        return p[-1]

    df = spark.createDataFrame(data, "k int, c array<string>, r array<string>")
    got = {x["k"]: x["lcs"] for x in texts.rouge_l(df, "k", "c", "r").collect()}
    assert got == {k: lcs(a, b) for k, a, b in data}


def test_near_duplicates_by_brute_force(spark):
    rnd = random.Random(2)
    data = [(d, p, " ".join(rnd.sample("abcdefgh", rnd.randint(0, 7)))) for d in range(4) for p in range(30)]
    df = spark.createDataFrame(data, "d int, p int, x string")
    toks = F.filter(F.split("x", " "), lambda t: t != "")
    got = {(r["d"], r["left_pos"], r["right_pos"]) for r in joins.near_duplicates(df, "d", "x", "p", toks, 0.7).collect()}

    def jac(a, b):
        a, b = set(a.split()), set(b.split())
        return len(a & b) / len(a | b) if a | b else 1.0

    want = {(d, p, q) for d, p, x in data for e, q, y in data if d == e and p < q and x != y and jac(x, y) >= 0.7}
    assert got == want


def test_near_duplicates_of_repeated_units_and_texts(spark):
    # Two rows of unit 1 at each place, as when an id repeats; equal texts, empty sets, nulls, and items beyond the first ones.
    data = [(1, 1, "a b c"), (1, 1, "a b c d"), (1, 2, "a b c"), (1, 2, "c b a"), (1, 3, "-"), (1, 4, "*"), (1, 5, None), (None, 1, "a b"), (None, 2, "b a"), (2, 1, "a b"), (2, 2, "q"), (2, 3, "b a")]
    df = spark.createDataFrame(data, "d int, p long, x string")
    toks = F.filter(F.split("x", "[^a-z]+"), lambda t: t != "")
    got = joins.near_duplicates(df, "d", "x", "p", toks, 0.75)
    assert rows(got) == [(1, 1, 2, 0.75), (1, 1, 2, 0.75), (1, 1, 2, 1.0), (1, 3, 4, 1.0), (2, 1, 3, 1.0)]
    assert rows(joins.near_duplicates(df.where("d = 2"), "d", "x", "p", toks, 0.75, 2)) == []
    assert got.dtypes == [("d", "int"), ("left_pos", "bigint"), ("right_pos", "bigint"), ("jaccard", "double")]


def test_near_duplicates_move_items_once(spark):
    df = spark.createDataFrame([(1, 1, "a b")], "d int, p long, x string")
    plan = joins.near_duplicates(df, "d", "x", "p", F.split("x", " "))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_similar_sets_by_brute_force():
    rnd = random.Random(4)
    for threshold in (0.3, 0.6, 2 / 3, 0.85, 1.0):
        items = [(p, " ".join(rnd.choices("abcdefgh", k=rnd.randint(0, 6))) + " " * rnd.randint(0, 1), None) for p in range(60)]
        items = [(p, x, x.split()) for p, x, _ in items]

        def jac(a, b):
            a, b = set(a), set(b)
            return len(a & b) / len(a | b) if a | b else 1.0

        want = sorted((p, q, jac(a, b)) for p, x, a in items for q, y, b in items if p < q and x != y and jac(a, b) >= threshold)
        assert sorted(joins.similar_sets(items, threshold)) == want != []


def test_dense_grid_and_empty_dimension(spark):
    agg = spark.createDataFrame([("a", "x", 3)], "k string, s string, n long")
    dims = [spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("x",), ("y",)], "s string")]
    assert rows(aggregates.densify(agg, dims, ["k", "s"], ["n"])) == [("a", "x", 3), ("a", "y", 0), ("b", "x", 0), ("b", "y", 0)]


def test_table_differences_tolerance(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, float("nan"), None), (3, 1.0, "y")], "k int, v double, t string")
    b = spark.createDataFrame([(1, 1.0 + 5e-13, "x"), (2, float("nan"), None), (4, 1.0, "y")], "k int, v double, t string")
    assert rows(quality.table_differences(a, b, ["k"]).select("k", "column")) == [(3, "(row)"), (4, "(row)")]


def test_budget_sample_is_round_robin(spark):
    df = spark.createDataFrame([("u", f, i) for f, n in (("a", 5), ("b", 1), ("c", 3)) for i in range(n)], "u string, f string, i int")
    got = windows.budget_sample(df, "f", ["i"], 1, 6, ["u"]).orderBy("picked").collect()
    assert [(r["f"], r["i"]) for r in got] == [("a", 0), ("b", 0), ("c", 0), ("a", 1), ("c", 1), ("a", 2)]


def test_unique_rows_fails_on_duplicates(spark):
    assert scans.unique_rows(spark.createDataFrame([(1,), (2,)], "k int"), "k").count() == 2
    with pytest.raises(Exception, match="duplicate key"):
        scans.unique_rows(spark.createDataFrame([(1,), (1,)], "k int"), "k").collect()


def test_sources_and_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", float("nan")), (None, 2.0)], "k string, v double")
    sinks.write_new(sinks.without_nan(df), str(tmp_path / "t"), ["k", "v"])
    assert rows(scans.csv_table(spark, str(tmp_path / "t"), "k string, v double")) == sorted([("a", 1.5), ("b", None), (None, 2.0)], key=repr)
    with pytest.raises(Exception, match="exist"):
        sinks.write_new(df, str(tmp_path / "t"), ["k", "v"])
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "one.json").write_text('{"metrics": {"m": {"score": 1, "generated": {"score": 0.5}}}}')
    (tmp_path / "j" / "two.json").write_text("{broken")
    r = scans.json_records(spark, str(tmp_path / "j"))
    got = {x["name"]: x["s"] for x in r.select("name", scans.variant_side(F.col("record"), "m", "score").alias("s")).collect()}
    assert got == {"one.json": 0.5, "two.json": None}
    import hashlib

    index = spark.createDataFrame([(n, hashlib.sha256((tmp_path / "j" / n).read_bytes()).hexdigest()) for n in ("one.json",)], "name string, sha256 string")
    assert scans.hashed_json(spark, str(tmp_path / "j"), index).count() == 1
    with pytest.raises(Exception, match="hash mismatch"):
        scans.hashed_json(spark, str(tmp_path / "j"), spark.createDataFrame([("one.json", "00")], "name string, sha256 string")).collect()
    for folder in ("ok", "unverified"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "s.csv").write_text("k\n1\n")
    u = scans.flagged_union(spark, [str(tmp_path / "ok"), str(tmp_path / "unverified")], "k int", "unverified")
    assert sorted(x["flag"] for x in u.collect()) == [False, True]
    assert scans.source_texts(spark, str(tmp_path / "j")).count() == 2
    assert scans.json_lines(spark, str(tmp_path / "j" / "one.json")).count() == 1


def test_strict_pairs_and_identities_raise(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "n string"), spark.createDataFrame([("x",)], "n string")
    assert rows(scans.paired_names(a, b, "n", strict=False)) == [("x",)]
    with pytest.raises(Exception, match="unpaired"):
        scans.paired_names(a, b, "n", strict=True).collect()
    with pytest.raises(Exception, match="bad sample id"):
        scans.split_sample_id(spark.createDataFrame([("a|b||d",)], "sample_id string")).collect()


def test_metric_failures_stay_in_their_row(spark, monkeypatch):
    from trivane.functions import parsing

    parsing.ready(spark)
    df = spark.createDataFrame([("fn f() requires true {}",), (None,), ("",)], "t string")
    got = [tuple(r[0]) for r in df.select(registry.evaluated("vacuity_rate", F.col("t"))).collect()]
    assert got == [("ok", 1.0), ("not_available", None), ("not_available", None)]
    assert registry.scope("Spec-Only") == "spec_only" and registry.catalog(spark).count() == len(registry.METRICS) + len(registry.MEASURES)


def test_stream_upsert_and_compaction(spark, tmp_path):
    src, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int").write.parquet(src)
    stream = incremental.read_stream(spark, src, spark.read.parquet(src).schema)
    incremental.upsert(stream, target, str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([(1, "c", 2)], "k int, v string, t int").write.mode("append").parquet(src)
    stream = incremental.read_stream(spark, src, spark.read.parquet(src).schema)
    incremental.upsert(stream, target, str(tmp_path / "cp")).awaitTermination()
    assert rows(incremental.latest(spark, target, ["k"], [F.desc("t")])) == [(1, "c", 2), (2, "b", 1)]
    incremental.compact(spark, target, ["k"], [F.desc("t")], str(tmp_path / "small"))
    assert rows(incremental.latest(spark, str(tmp_path / "small"), ["k"], [F.desc("t")])) == [(1, "c", 2), (2, "b", 1)]


def test_name_resolution_prefers_exact(spark):
    names = spark.createDataFrame([("m::a", 2), ("n::a", 1), ("b", 3)], "name string, pos int")
    calls = spark.createDataFrame([("m::a",), ("a",), ("b",), ("zz",)], "call string")
    assert rows(joins.resolve_names(calls, names, "call", "name", "pos")) == [("a", "n::a"), ("b", "b"), ("m::a", "m::a"), ("zz", None)]


def test_resample_follows_the_weights(spark):
    df = spark.createDataFrame([("g", 1, 0), ("g", 2, 9), ("g", 3, 1)], "g string, pos int, w long")
    got = [r["pos"] for r in statistics.resample(df, ["g"], "pos", "w", 200, "s").collect()]
    assert len(got) == 200 and 1 not in got and got.count(2) > 140


def test_positions_of_a_total_order(spark):
    rnd = random.Random(8)
    values = [(rnd.randint(0, 50), i) for i in range(500)]
    df = spark.createDataFrame(values, "v int, i int").repartition(7)
    got = {(r["v"], r["i"]): r["position"] for r in windows.positions(df, ["v", "i"]).collect()}
    assert got == {x: k + 1 for k, x in enumerate(sorted(values))}


def record(stage="accepted", passed=1, total=1, **metrics):
    import json

    io = {"generated": {"passed": passed, "failed": 0, "unknown": 0, "total": total, "score": 1.0, "status": "ok"}}
    target = {"sample_id": "w|m|s|t", "verification_stage": stage, "analysis_eligible": True, "directions": dict.fromkeys(("pre_ref_to_gen", "post_gen_to_ref", "pre_gen_to_ref", "post_ref_to_gen"), "valid"), "triviality": {"precondition_falsity": "favorable", "postcondition_truth": "favorable"}}
    return json.dumps({"target_evaluation": target, "metrics": {"correct_io_pass_rate": io, **metrics}})


def test_flattened_records(spark):
    from trivane.sources.records import flatten

    def flat(text, **more):
        return flatten(spark.createDataFrame([(text,)], "t string").select(F.parse_json("t").alias("record")), **more).first()

    r = flat(record(), path=F.lit("/x/verified/per_file/a.json"))
    assert (r["workflow"], r["task_id"], r["verified_side"], r["formal_state"], r["io_state"], r["mutation_status"], r["triviality_form"]) == ("w", "t", True, "favorable", "favorable", "missing", "none")
    assert r["io_wrong_passed"] == 0 and r["io_wrong_state"] == "other" and r["redundancy_score"] is None and r["llm_intent_advisory"] is False
    m = {"status": "ok", "generated": {"status": "partial", "valid_mutants": 3, "survived_mutants": 0, "unknown_mutants": 1, "score": 0.5}}
    assert flat(record(mutation_kill_rate=m))["mutation_state"] == "other"
    j = {"status": "ok", "score": 1, "generated": {"status": "ok", "verdict": "Equivalent"}, "llm": {"status": "ok"}, "target_alignment": {"status": "ok", "function": "f"}}
    named = {"audited": F.lit(True)}
    assert flat(record(llm_as_judge_intent_consistency=j), target=F.lit("f"), **named)["llm_intent_state"] == "favorable"
    assert flat(record(llm_as_judge_intent_consistency=j), target=F.lit("g"), **named)["llm_intent_state"] == "other"
    for bad, why in ((record(stage="odd"), "unknown stage"), (record(total=2), "inconsistent counts"), (record(passed=-1, total=-1), "inconsistent counts")):
        with pytest.raises(Exception, match=why):
            flat(bad)


def test_folders_are_paired_and_evaluated(spark, tmp_path, capsys):
    from trivane.__main__ import evaluate, file_pairs

    spec = "fn f(x: u32) requires x < {} ensures true {{ assert(x < 9); }}"
    for side, names in (("gen", ("a b.rs", "é.rs", "only.rs", "note.txt")), ("ref", ("a b.rs", "é.rs"))):
        (tmp_path / side).mkdir()
        for k, n in enumerate(names):
            (tmp_path / side / n).write_text(spec.format(k if side == "gen" else 0))
    gen, ref = str(tmp_path / "gen"), str(tmp_path / "ref")
    assert file_pairs(gen, ref, ".rs")[1] == ["only.rs"] and len(file_pairs(gen, ref, ".rs")[0]) == 2
    (tmp_path / "o.json").write_text('{"name": "a b.rs", "side": "generated", "verified": true, "mutants": ["killed", "unknown"]}\n')
    evaluate(gen, ref, str(tmp_path / "out"), str(tmp_path / "o.json"))
    got = {(r["name"], r["metric"]): r for r in spark.read.parquet(str(tmp_path / "out" / "scores")).collect()}
    assert len(got) == 2 * len(registry.MEASURES)
    assert got["a b.rs", "textual_similarity"]["score"] == 1.0 and 0 < got["é.rs", "textual_similarity"]["score"] < 1
    assert (got["a b.rs", "mutation_kill_rate"]["status"], got["a b.rs", "mutation_kill_rate"]["score"]) == ("partial", 0.5)
    assert got["é.rs", "mutation_kill_rate"]["status"] == "not_available"
    with pytest.raises(SystemExit):
        file_pairs(gen, str(tmp_path / "o.json"), ".rs")


def test_measures_by_older_names():
    assert registry.measure("pass").name == "verification_pass_rate" and registry.measure("tool_spec_score").name == "textual_similarity"
    with pytest.raises(ValueError):
        registry.measure("nothing")
    with pytest.raises(ValueError):
        registry.side({"nothing": F.lit(1)})


def test_archives_are_checked(spark, tmp_path):
    from trivane.sources import archives

    (tmp_path / "big.bin").write_bytes(bytes(range(256)) * 100)
    whole, parts = str(tmp_path / "big.bin"), str(tmp_path / "parts")
    m = spark.createDataFrame(archives.split(spark, whole, parts, 10_000).collect(), "name string, size long, sha256 string")
    assert sorted(r["size"] for r in m.collect()) == [5_600, 10_000, 10_000]
    archives.restore(spark, m, parts, str(tmp_path / "again.bin"))
    assert (tmp_path / "again.bin").read_bytes() == (tmp_path / "big.bin").read_bytes()
    with pytest.raises(ValueError, match="exists"):
        archives.restore(spark, m, parts, str(tmp_path / "again.bin"))
    (tmp_path / "parts" / "big.bin.part00001").write_bytes(b"x" * 10_000)
    (tmp_path / "parts" / ".big.bin.part00001.crc").unlink()  # else the file system itself refuses the part
    with pytest.raises(ValueError, match="part00001"):
        archives.restore(spark, m, parts, str(tmp_path / "third.bin"))
    assert not (tmp_path / "third.bin").exists()


def test_actions_have_one_function_each():
    from trivane.functions import actions

    text = "fn f(x: u8) requires x > 1, x > 2 { }"
    assert actions.apply("mask_contract", text, "f").split() == ["fn", "f(x:", "u8)", "{", "}"]
    with pytest.raises(ValueError):
        actions.action("merge_lines")(str)
    with pytest.raises(ValueError):
        actions.apply("nothing", text)


def test_running_sums_and_positions(spark):
    rnd = random.Random(3)
    data = [(rnd.choice(["a", "b", None]), rnd.randint(0, 40), k, rnd.randint(-3, 9)) for k in range(400)]
    df = spark.createDataFrame(data, "g string, o int, k int, v long").repartition(5)
    got = {r["k"]: r["before"] for r in windows.running_sums(df, ["g"], ["o", "k"], {"before": "v"}).collect()}
    assert got == {k: sum(w for h, p, j, w in data if h == g and (p, j) < (o, k)) for g, o, k, v in data}
    place = {r["k"]: r["position"] for r in windows.positions(df, ["o", "k"]).collect()}
    assert [k for k, _ in sorted(place.items(), key=lambda x: x[1])] == [k for _, k in sorted((o, k) for _, o, k, _ in data)]
    assert windows.running_sums(df.limit(0), ["g"], ["o"], {"before": "v"}).count() == 0


def test_figures(spark):
    from trivane.sources import figures

    df = spark.createDataFrame([("a<b", 2.0, 1.0, 3.0), ("c", None, None, None)], "k string, v double, lo double, hi double")
    for svg in (figures.bars(df, "k", "v"), figures.dots(df, "k", "v", "lo", "hi"), figures.heatmap(df, "k", "k", "v")):
        assert svg.startswith("<svg") and svg.endswith("</svg>") and "a&lt;b" in svg and svg.count('data-value="2"') == 1
    assert figures.bars(df.limit(0), "k", "v").count("<rect") == 0
    with pytest.raises(ValueError):
        figures.bars(spark.range(600).select(F.col("id").alias("k"), F.col("id").alias("v")), "k", "v")


def test_dear_texts_are_dealt_over_cores(spark, sf):
    """However few files a table has, and however small Spark thinks a join's parts are."""
    from trivane.plans import measures, programs, texts

    n = 4 * spark.sparkContext.defaultParallelism
    assert texts.spec_texts(spark, sf).rdd.getNumPartitions() == n
    assert programs.turns(spark, sf).rdd.getNumPartitions() == n
    assert measures.text_pairs(spark, sf).rdd.getNumPartitions() == n


def test_ordered_match_of_dealt_sides(spark):
    """Sides that are dealt by unit already meet all the same, whatever adaptive execution makes of their parts."""
    rows = spark.range(0, 3000, 1, 6).select((F.col("id") % 500).alias("u"), F.floor(F.col("id") / 500).alias("k"))
    place = lambda order: rows.withColumn("p", F.row_number().over(W.partitionBy("u").orderBy(order)))
    out = joins.ordered_match(place(F.col("k")), place(F.col("k")), "u", ["k"], "p")
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    assert out.where("matched = 6 AND complete").count() == out.count() == 500


def test_postings_of_few_files_are_made_by_all_cores(spark):
    from trivane.operators import search

    lib = spark.range(0, 100, 1, 1).select("id", F.concat(F.lit("name"), F.col("id").cast("string")).alias("x"))
    out = search.gram_postings(lib, "id", F.col("x"))
    assert "RoundRobinPartitioning" in out._jdf.queryExecution().executedPlan().toString()
    assert out.where("gram = 'nam'").count() == 100

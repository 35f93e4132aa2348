"""The command line's longer jobs, the store of results, batches, audits and decisions on small inputs."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from trivane import commands
from trivane.__main__ import main
from trivane.functions import decisions
from trivane.operators import audits, harness
from trivane.sources import cache


def test_files_against_a_manifest(spark, tmp_path, capsys):
    data = tmp_path / "data"
    (data / "sub").mkdir(parents=True)
    for name, text in (("a.txt", "one"), ("sub/b c+d.txt", "two"), ("new.txt", "three")):
        (data / name).write_text(text)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    listed = tmp_path / "m.csv"
    listed.write_text("path,sha256\n" + "".join(f"{n},{h}\n" for n, h in (("a.txt", sha("other")), ("sub/b c+d.txt", sha("two").upper()), ("gone.txt", sha("x")))))
    got = {tuple(r) for r in commands.file_differences(spark, str(data), str(listed)).collect()}
    assert got == {("a.txt", "changed"), ("gone.txt", "missing"), ("new.txt", "unlisted")}
    with pytest.raises(SystemExit):
        main(["validate", str(data), str(listed)])
    assert "gone.txt" in capsys.readouterr().out


def test_reproduced_results_are_compared(spark, sf, tmp_path):
    names = ["a02_histogram", "j06_anti"]
    first = commands.reproduce(spark, sf, str(tmp_path / "one"), names)
    assert first["status"] == "passed" and [s["name"] for s in first["stages"]] == names
    again = commands.reproduce(spark, sf, str(tmp_path / "two"), names, str(tmp_path / "one"))
    assert again["status"] == "passed" and all(s["differences"] == 0 for s in again["stages"])
    path = str(tmp_path / "one/results/j06_anti")
    rows = spark.read.parquet(path).limit(3).collect()
    spark.createDataFrame(rows, spark.read.parquet(path).schema).write.mode("overwrite").parquet(path)
    third = commands.reproduce(spark, sf, str(tmp_path / "three"), names, str(tmp_path / "one"))
    assert third["status"] == "failed" and json.loads((tmp_path / "three/report.json").read_text())["stages"][1]["status"] == "different"
    with pytest.raises(SystemExit):
        commands.reproduce(spark, sf, str(tmp_path / "one"), names)
    with pytest.raises(SystemExit):
        commands.reproduce(spark, sf, str(tmp_path / "four"), ["no such"])


def test_data_set_goes_on_where_it_stopped(spark, tmp_path):
    for n in range(5):
        (tmp_path / f"g{n}.rs").write_text(f"fn f(x: u32) requires x < {n} {{ }}")
        (tmp_path / f"r{n}.rs").write_text("fn f(x: u32) requires x < 3 { }")
    rows = [("w", "m", "few" if n % 2 else "zero", f"t{n}", f"{tmp_path}/g{n}.rs") for n in range(5)]
    listed = spark.createDataFrame(rows, "workflow string, model string, shot string, task_id string, generated_path string")
    refs = spark.createDataFrame([(f"t{n}", f"{tmp_path}/r{n}.rs") for n in range(5)], "task_id string, reference_path string")
    jobs = commands.jobs(listed, refs, {"shot": None})
    out = str(tmp_path / "out")
    assert commands.evaluate_dataset(spark, jobs.where("sample_id < 'w|m|few|t3'"), out, step=1) == 1
    # A step that was broken off has no mark of success and is done again.
    (tmp_path / "out/scores/batch=1").mkdir()
    assert commands.evaluate_dataset(spark, jobs, out, step=3) == 4
    assert commands.evaluate_dataset(spark, jobs, out) == 0
    scores = spark.read.parquet(f"{out}/scores").where("metric = 'textual_similarity_spec_only'")
    assert scores.count() == 5 and {r["name"]: r["score"] for r in scores.collect()}["w|m|few|t3"] == 1.0
    assert commands.summary(spark, out).where("metric = 'spec_size_complexity'").first()["pairs"] == 5
    with pytest.raises(Exception, match="unknown t9"):
        commands.jobs(listed.withColumn("task_id", F.lit("t9")), refs, {}).collect()
    with pytest.raises(Exception, match="disagrees"):
        commands.jobs(listed.withColumn("sample_id", F.lit("x")), refs, {}).collect()
    with pytest.raises(Exception, match="duplicate key"):
        commands.jobs(listed.unionByName(listed), refs, {}).collect()


def test_the_store_does_not_move(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(200).select("id", (F.col("id") % 3).alias("ask"), F.lit("ok").alias("status"), (F.col("id") * 2).alias("value"))
        cache.save(rows.where("id < 90"), "results_test", str(tmp_path / "store"), "id", 4)
        cache.save(rows.where("id >= 90 AND id < 150"), "results_test", str(tmp_path / "store"), "id", 4)
        asked = rows.select("id", F.when(F.col("id") < 10, 9).otherwise(F.col("ask")).alias("ask"))
        found = cache.lookup(asked, "results_test", "id", "ask")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        got = {r["id"]: (r["status"], r["value"]) for r in found.collect()}
        assert got == {i: ("ok", 2 * i) if 10 <= i < 150 else ("not_attempted", None) for i in range(200)}
        assert sorted(r["id"] for r in cache.misses(asked, "results_test", "id", "ask").collect()) == [*range(10), *range(150, 200)]
    finally:
        cache.drop(spark, "results_test")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_lines_of_batches(spark):
    cases = spark.createDataFrame([("u", i, "\n".join(f"case {i} line {k}" for k in range(1 + i % 3))) for i in range(7)], "u string, c int, t string")
    built = harness.batches(cases, "u", "c", "t", 3, ("use a;", "use vstd::prelude::*;"), ("// p",))
    files = {r["batch"]: r["file"].split("\n") for r in harness.files(built, "u", "c", "t", ("use a;", "use vstd::prelude::*;"), ("// p",)).collect()}
    rows = built.collect()
    assert len(rows) == 7 and len(files) == 3
    assert files[0][:6] == ["use vstd::prelude::*;", "use a;", "", "verus! {", "", "// p"] and files[0][-3:] == ["", "} // verus!", ""]
    for r in rows:
        lines = files[r["batch"]]
        assert "\n".join(lines[r["start"] - 1 : r["end"]]) == r["t"] and lines[r["start"] - 2] == ""


def test_audit_looks_at_changed_tasks_only(spark, tmp_path):
    out = str(tmp_path)
    tasks = lambda h: spark.createDataFrame([("a", "1", "f"), ("b", h, "f"), ("c", "1", None), ("empty", "1", "f")], "task string, source_hash string, target string")
    rows = [("a", "positive", "k", 0, True, None), ("a", "positive", "k", 1, True, None), ("a", "negative", "x", 0, None, None), ("b", "positive", "k", 0, False, "wrong"), ("c", "positive", "k", 0, True, None)]
    cases = spark.createDataFrame(rows, "task string, kind string, case_key string, pos long, valid boolean, reason string")
    assert not any(r["resumed"] for r in audits.run(tasks("1"), cases, out, 1, 3, 1).collect())
    quarantined = {(r["task"], r["kind"], r["pos"]): r["reason"] for r in audits.current(spark, out, "quarantined").collect()}
    assert quarantined == {("a", "positive", 1): "duplicate_case", ("a", "negative", 0): "not_decided", ("b", "positive", 0): "wrong", ("c", "positive", 0): "target_not_found"}
    meta = {r["task"]: r for r in audits.finished(spark, out).collect()}
    assert meta["a"]["states"] == {"positive": "complete", "negative": "blocked"} and meta["c"]["status"] == "no_function" and meta["empty"]["kept"] == 0
    second = audits.run(tasks("2"), cases.withColumn("valid", F.lit(True)), out, 2, 3, 1)
    assert {r["task"]: r["resumed"] for r in second.collect()} == {"a": True, "b": False, "c": True, "empty": True}
    assert {(r["task"], r["kind"]) for r in audits.current(spark, out, "kept").collect()} == {("a", "positive"), ("b", "positive")}
    # Another schema version makes every task new.
    assert not any(r["resumed"] for r in audits.run(tasks("2"), cases, out, 3, 4, 1).collect())


def test_decisions(spark):
    reason = lambda t: spark.range(1).select(decisions.unsafe_reason(F.lit(t)).alias("r")).first()["r"]
    assert reason("verus! { fn f() ensures x { } }") is None
    assert reason("verus! { a ssume (x) ensures }") == "assume is forbidden" and reason("verus! {}") == "generated program has no ensures clause" and reason("ensures") == "generated output is not a Verus program"
    runs = spark.createDataFrame([("a", "m"), ("a", "n"), ("b", "m")], "w string, m string")
    assert decisions.selected_runs(runs, {"w": "a", "m": "all"}).count() == 2
    with pytest.raises(ValueError):
        decisions.selected_runs(runs, {"w": "c", "m": None})
    with pytest.raises(Exception, match="given twice"):
        decisions.selected_runs(runs.unionByName(runs), {"w": "b", "m": None}).collect()
    none = spark.range(1).select(decisions.materialized(F.lit(None).cast("array<struct<kind:string,text:string,normalized:string>>"), "ensures").alias("x"), decisions.materialized(F.lit(None).cast("array<struct<kind:string,text:string,normalized:string>>"), "assert").alias("y")).first()
    assert [tuple(c) for c in none["x"]] == [("ensures", "true", "true", True)] and none["y"] == []


def test_audit_reads_its_cases_once(spark, tmp_path):
    """One pass over the cases gives both tables, and cases without a key are in them too."""
    out = str(tmp_path / "once")
    tasks = spark.createDataFrame([("a", "h", "f")], "task string, source_hash string, target string")
    cases = spark.createDataFrame([("a", "k", None, 1, True, None), ("a", "k", None, 0, True, None), ("a", "k", "x", 2, False, "wrong")], "task string, kind string, case_key string, pos int, valid boolean, reason string")
    audits.run(tasks, cases, out, 1, 1, 1)
    assert {(r["pos"], r["reason"]) for r in audits.current(spark, out, "quarantined").collect()} == {(1, "duplicate_case"), (2, "wrong")}
    assert [r["pos"] for r in audits.current(spark, out, "kept").collect()] == [0]
    audits.run(tasks, cases.where("false"), str(tmp_path / "none"), 1, 1, 1)
    assert not audits.current(spark, str(tmp_path / "none"), "kept").collect()

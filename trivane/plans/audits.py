"""Queries for decisions over records, batches of cases, audits with quarantine and the store of results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trivane.functions import decisions, walks
from trivane.operators import audits, harness
from trivane.plans.programs import WORDS, number, program, turns
from trivane.plans.registry import query
from trivane.session import dealt, shared_dir
from trivane.sources import cache
from trivane.views import view

_UNSAFE = ("verus! { fn f#() ensures x > # { } }", "a ssume (x > #);", "// ADMIT( )", "~[verifier :: external_body] fn g() {}", "fn h() ensures\n  true, {}", "let x = #;", "let y = #;", "let z = #;", "fn k() {}")


@query(f"""WITH {WORDS} SELECT item_id, CASE WHEN {number(1, 9)} > 0 THEN 'assume is forbidden' WHEN {number(2, 9)} > 0 THEN 'admit is forbidden' WHEN {number(3, 9)} > 0 THEN 'external body is forbidden' WHEN {number(4, 9)} > 0 THEN 'ensures true is forbidden'
  WHEN {number(0, 9)} + {number(4, 9)} = 0 THEN 'generated program has no ensures clause' WHEN {number(0, 9)} = 0 THEN 'generated output is not a Verus program' END AS reason FROM tk""")
def p39_unsafe(spark, d):
    """The first thing that makes a text unsafe, over programs made of the words of turns."""
    text = F.replace(program(_UNSAFE), F.lit("~"), F.lit("#"))
    return turns(spark, d).select("item_id", decisions.unsafe_reason(text).alias("reason"))


@query("""
WITH c AS (SELECT sample_id, kind, case_no, part_id, amount, state FROM cases),
g AS (SELECT sample_id, kind, count(*) AS n, count(*) FILTER (state = 'failed') AS rejected, count(*) FILTER (state = 'passed') AS passed, bool_or(state = 'unresolved') AS open, string_agg(CASE WHEN state = 'failed' THEN 'x > ' || amount END, ';' ORDER BY case_no, part_id, amount, state) AS texts FROM c GROUP BY ALL)
SELECT sample_id, kind, CASE WHEN sample_id % 10 = 0 THEN 'missing_target_clause_context' WHEN sample_id % 10 = 1 THEN 'consequent_coverage_mismatch' WHEN sample_id % 10 = 2 THEN 'antecedent_mismatch' WHEN sample_id % 10 = 3 THEN 'different_premise_policy' WHEN sample_id % 10 = 4 THEN 'consequent_context_mismatch'
  WHEN open THEN 'unresolved_clause_checks' WHEN rejected = 0 THEN 'no_rejected_clause_in_saved_checks' ELSE 'localized_proof_rejection' END AS status, n AS clauses, rejected, passed, coalesce(texts, '') AS rejected_text FROM g""")
def p29_clause_localisation(spark, d):
    """Which clauses of a side saved checks rejected, and what keeps them from saying so."""
    k = F.col("sample_id") % 10
    text = F.format_string("x > %d", "amount")
    kind = F.when(F.col("kind") == "io_wrong", "ensures").otherwise("requires")
    check = F.struct(
        "case_no", "part_id", "amount", "state",
        F.struct(
            text.alias("text"),
            F.when(F.col("state") == "passed", "valid").when(F.col("state") == "failed", "invalid").otherwise("unknown").alias("status"),
            F.array(F.when(k == 2, "other").otherwise("a  <\n b")).alias("antecedent"),
            F.array(F.when(k == 3, "invariant").otherwise(kind)).alias("antecedent_kinds"),
            F.array(F.when(k == 4, "y").otherwise(F.concat(F.lit(" "), text))).alias("consequent"),
        ).alias("c"),
    )
    g = view(spark, d, "cases").groupBy("sample_id", "kind").agg(F.transform(F.array_sort(F.collect_list(check)), lambda x: x["c"]).alias("c"))
    after = F.transform("c", lambda x: F.concat(x["text"], F.lit("  ")))
    after = F.when(k == 1, F.array(F.lit("z"))).otherwise(after)
    out = g.withColumn("l", decisions.localisation(F.col("c"), F.when(k != 0, F.array(F.lit("a < b"))), after, kind))
    return out.select("sample_id", "kind", "l.status", "l.clauses", "l.rejected", "l.passed", F.array_join("l.rejected_text", ";").alias("rejected_text"))


@query("""
WITH c AS (SELECT *, kind = 'io_invalid' AND amount % 5 = 0 AS mute FROM cases)
SELECT sample_id, CASE WHEN count(*) FILTER (NOT mute) = 0 THEN 1 ELSE count(*) FILTER (NOT mute) END AS clauses, count(*) FILTER (NOT mute) = 0 AS implicit, coalesce(max(CASE WHEN NOT mute THEN 'x > ' || amount END), 'true') AS last FROM c GROUP BY sample_id""")
def h07_implicit_true(spark, d):
    """Contracts whose empty clauses are left out; one without any gets the implicit true."""
    mute = (F.col("kind") == "io_invalid") & (F.col("amount") % 5 == 0)
    text = F.format_string("x > %d", "amount")
    one = F.struct(F.lit(None).cast("string").alias("kind"), F.when(mute, " ").when(F.col("amount") % 2 == 0, text).alias("text"), F.when(mute, "").otherwise(F.concat(F.lit(" "), text)).alias("normalized"))
    c = view(spark, d, "cases").groupBy("sample_id").agg(F.collect_list(one).alias("a")).select("sample_id", decisions.materialized(F.col("a"), "requires").alias("m"))
    return c.select("sample_id", F.size("m").cast("long").alias("clauses"), F.exists("m", lambda x: x["implicit"]).alias("implicit"), F.array_max(F.transform("m", lambda x: x["text"])).alias("last"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS stamp, round(epoch_us(ts) % 86400000000 / 1e6::DOUBLE, 3) AS seconds, CASE WHEN event_id % 2 = 0 THEN 0.0::DOUBLE END AS before FROM events")
def h08_timestamps(spark, d):
    t = F.col("ts").cast("timestamp")
    day = F.date_trunc("day", t)
    return view(spark, d, "events").select("event_id", decisions.iso_stamp(t).alias("stamp"), decisions.elapsed(day, t).alias("seconds"), decisions.elapsed(F.when(F.col("event_id") % 2 == 0, t), day).alias("before"))


@query("""
SELECT candidate_id, CASE WHEN status IN ('confirmed', 'rejected') THEN '' ELSE concat_ws(',', CASE WHEN points % 7 < 2 THEN 'H1' END, CASE WHEN points % 7 = 2 THEN 'H2' END, CASE WHEN operator = 'click' AND points % 3 = 0 THEN 'H3' END, CASE WHEN points % 5 = 1 AND points % 3 = 1 THEN 'H4' END, CASE WHEN points % 4 < 2 THEN 'H5' END, CASE WHEN points % 3 = 2 AND points % 2 = 0 THEN 'H6' END) END AS tags FROM candidates""")
def h04_tags(spark, d):
    """What of the harness may explain unknown verdicts."""
    p, k = F.col("points"), F.lit
    category = F.when(p % 7 == 0, "return_count").when(p % 7 == 1, "return_name").when(p % 7 == 2, "return_type").otherwise("none")
    check = F.to_json(F.struct(
        category.alias("category"),
        F.when(p % 7 == 2, "(u8, )").otherwise("u8").alias("type"),
        F.when(F.col("operator") == "click", "a dangling_> b").alias("error"),
        F.when(p % 5 == 1, "harness_frontend").otherwise("proof").alias("phase"),
        F.when(p % 4 == 0, F.array(k("vstd::x"))).alias("candidate_vstd_globs"),
        F.when(p % 4 == 1, "ambiguous_generated_import").alias("support_issue"),
        F.when(p % 2 == 0, "malformed_clause").otherwise("other").alias("reason"),
    ))
    clauses = F.when(p % 3 == 0, "x is a::b<u8> ").when(p % 3 == 1, "if a\n then b && c").otherwise("a <==> b")
    verdict = F.when(F.col("status") == "confirmed", "valid").when(F.col("status") == "rejected", "invalid").otherwise("unknown")
    return view(spark, d, "candidates").select("candidate_id", F.array_join(walks.harness_tags(check, verdict, clauses), ",").alias("tags"))


@query("""SELECT sample_id, CASE WHEN sample_id % 4 = 0 THEN 'not_applicable' WHEN io_correct_passed >= sample_id % 4 THEN 'complete' ELSE 'partial' END AS state, CASE WHEN sample_id % 4 = 0 THEN 'not_applicable' WHEN io_correct_passed >= sample_id % 4 THEN 'complete' ELSE 'blocked' END AS audited FROM outcomes""")
def y09_category_state(spark, d):
    """State of a category by its target and what there is of it, in both forms."""
    n, target = F.col("io_correct_passed"), F.col("sample_id") % 4
    return view(spark, d, "outcomes").select("sample_id", audits.category_state(n, target).alias("state"), audits.category_state(n, target, True).alias("audited"))


@query("SELECT workflow, model, shot, count(*) AS n FROM samples WHERE workflow = '2' AND shot = 'few' GROUP BY ALL")
def y15_selected_runs(spark, d):
    """Runs of the matrix that match the given fields; a field that isn't given matches all."""
    runs = view(spark, d, "samples").groupBy("workflow", "model", "shot").agg(F.count(F.lit(1)).alias("n"))
    return decisions.selected_runs(runs, {"workflow": "2", "model": None, "shot": "few"})


@query("""
WITH c AS (SELECT DISTINCT sample_id, case_no, min(state) OVER (PARTITION BY sample_id, case_no) AS state FROM cases),
b AS (SELECT *, (row_number() OVER (PARTITION BY sample_id ORDER BY case_no) - 1) // 3 AS batch FROM c),
g AS (SELECT sample_id, batch, count(*) FILTER (state = 'failed') AS fails, bool_or(state <> 'passed') AS bad FROM b GROUP BY ALL)
SELECT b.sample_id, b.batch, b.case_no, CASE WHEN b.sample_id % 9 = 0 THEN NULL WHEN NOT bad THEN true WHEN fails = 0 OR b.sample_id % 7 = 0 OR b.sample_id % 8 = 0 THEN NULL WHEN state = 'failed' THEN false WHEN state = 'passed' THEN true END AS success FROM b JOIN g ON b.sample_id = g.sample_id AND b.batch = g.batch""")
def y07_harness(spark, d):
    """Cases put into files, three to one; diagnostics placed by the lines of these files and mapped back to the cases."""
    c = view(spark, d, "cases").groupBy("sample_id", "case_no").agg(F.min("state").alias("state"))
    mark = F.when(F.col("state") == "failed", "assert(false);").when(F.col("state") == "passed", "fine();").otherwise("broken(;")
    text = F.concat(F.format_string("fn case_%d() {", "case_no"), F.repeat(F.lit("\n    let x = 1;"), (F.col("case_no") % 3).cast("int")), F.lit("\n    "), mark, F.lit("\n}"))
    uses, pre = ("use vstd::seq::*;",), ("spec fn p() -> bool;", "// two lines")
    built = harness.batches(c.withColumn("text", text), "sample_id", "case_no", "text", 3, uses, pre)
    files = harness.files(built, "sample_id", "case_no", "text", uses, pre)
    lines = files.select("sample_id", "batch", F.posexplode(F.split("file", "\n")).alias("at", "line_text"))
    bad = lines.where(F.col("line_text").rlike(r"assert\(false\)|broken")).select("sample_id", "batch", F.col("at").alias("id"), F.when(F.contains("line_text", F.lit("broken")), "expected ;").otherwise("error: assertion failed").alias("message"), (F.col("at") + 1).cast("long").alias("line"))
    # One place outside of all cases, in every eighth sample; more errors counted than seen in every seventh.
    stray = files.where("sample_id % 8 = 0").select("sample_id", "batch", F.lit(-1).alias("id"), F.lit("unused").alias("message"), F.lit(1).cast("long").alias("line"))
    errors = bad.groupBy("sample_id", "batch").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.contains("message", F.lit("assertion"))).alias("proofs"))
    runs = files.select("sample_id", "batch").join(errors, ["sample_id", "batch"], "left")
    runs = runs.select("sample_id", "batch", F.when(F.col("sample_id") % 9 == 0, "timeout").when(F.col("n").isNull(), "ok").otherwise("failed").alias("status"), (F.col("proofs") + F.when(F.col("sample_id") % 7 == 0, 1).otherwise(0)).alias("errors"))
    return harness.verdicts(built, runs, bad.unionByName(stray), "sample_id", "case_no")


@query("""
WITH c AS (SELECT sample_id, kind, amount, case_no, part_id, state, row_number() OVER (PARTITION BY sample_id, kind, amount ORDER BY case_no, part_id, state) AS r, sample_id % 6 = 0 AS changed FROM cases),
v AS (SELECT *, CASE WHEN sample_id % 10 = 3 THEN 'target_not_found' WHEN r > 1 THEN 'duplicate_case' WHEN changed AND state = 'failed' THEN NULL WHEN state = 'passed' THEN NULL ELSE state END AS reason FROM c)
SELECT CAST(sample_id AS VARCHAR) AS task, NOT any_value(changed) AS resumed, CASE WHEN sample_id % 10 = 3 THEN 'no_function' ELSE 'ok' END AS status, count(*) FILTER (reason IS NULL) AS kept, count(*) FILTER (reason IS NOT NULL) AS quarantined, coalesce(string_agg(DISTINCT reason, ',' ORDER BY reason), '') AS reasons FROM v GROUP BY sample_id""")
def y10_quarantine(spark, d):
    """An audit, and a second one after some tasks' sources changed: only these are looked at again."""
    out = f"{shared_dir(spark)}/audit-{uuid.uuid4().hex}"
    c = view(spark, d, "cases")
    sources = c.select("sample_id").distinct()
    order = F.struct("case_no", "part_id", "state")
    task, changed = F.col("sample_id").cast("string").alias("task"), F.col("sample_id") % 6 == 0
    for n in (1, 2):
        now = changed if n == 2 else F.lit(False)
        tasks = sources.select(task, F.sha2(F.concat_ws("|", task, F.when(now, "new").otherwise("old")).cast("binary"), 256).alias("source_hash"), F.when(F.col("sample_id") % 10 != 3, "f").alias("target"))
        valid = (F.col("state") == "passed") | (now & (F.col("state") == "failed"))
        cases = c.select(task, "kind", F.col("amount").cast("string").alias("case_key"), order.alias("pos"), valid.alias("valid"), F.col("state").alias("reason"))
        resumed = audits.run(tasks, cases, out, n, 3, 1)
    why = audits.current(spark, out, "quarantined").groupBy("task").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))
    meta = audits.finished(spark, out).select("task", "status", "kept", "quarantined")
    return resumed.join(meta, "task").join(why, "task", "left").fillna("", ["reasons"])


@query("""
WITH q AS (SELECT candidate_id, points % 3 AS ask FROM candidates)
SELECT q.candidate_id, q.ask, CASE WHEN q.candidate_id % 2 = 0 AND q.ask <> 1 THEN c.status ELSE 'not_attempted' END AS status, CASE WHEN q.candidate_id % 2 = 0 AND q.ask <> 1 THEN c.points END AS points FROM q JOIN candidates c ON q.candidate_id = c.candidate_id""")
def s23_j04_bucketed_store(spark, d):
    """Requests meet a bucketed store; results of older requests count as missing."""
    name = f"results_{uuid.uuid4().hex}"
    c = view(spark, d, "candidates")
    ask = F.col("points") % 3
    stored = c.select("candidate_id", F.when(ask == 1, 7).otherwise(ask).alias("ask"), "status", "points")
    for part in (0, 2):  # in two goes, as results come in
        cache.save(stored.where(F.col("candidate_id") % 4 == part), name, f"{shared_dir(spark)}/{name}", "candidate_id")
    return cache.lookup(c.select("candidate_id", ask.alias("ask")), name, "candidate_id", "ask")


@query("""
WITH p AS (SELECT p_partkey, p_size, p_partkey % 6 AS k FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN 'parameter_count' WHEN 1 THEN 'parameter_type:0' WHEN 2 THEN 'generic_context' END AS issue, CASE WHEN k > 2 THEN 'x' || p_size || '=a>__arg0,v=w>__arg1,result=r>__ret0' END AS shared,
  CASE WHEN k > 2 THEN CASE WHEN k = 3 THEN 'f_gen(__arg0, __old_arg1, __ret0)' WHEN k = 4 THEN 'f_gen(__arg0, __arg1, __ret0, __old_arg1)' ELSE 'f_gen(__arg0, __arg1, __ret0)' END END AS call,
  CASE WHEN k > 2 THEN CASE WHEN k = 3 THEN 'a < ' || p_size || ' && w.len() > 0' WHEN k = 4 THEN '__old_w.len() + ' || p_size || ' == (*__old_w).len()' ELSE 'a == r' END END AS body FROM p""")
def y05_binding(spark, d):
    """Functions bound by position, and clauses of the generated one as predicates over the shared values."""
    from trivane.functions import binding, parsing

    parsing.ready(spark)
    k = F.col("p_partkey") % 6
    ref = F.format_string("fn f<T>(x%d: u32, v: &mut Vec<T>) -> u32 { 0 }", "p_size")
    gen = F.when(k == 0, "fn f<T>(a: u32) -> (r: u32) { 0 }").when(k == 1, "fn f<T>(a: u64, w: &mut Vec<T>) -> (r: u32) { 0 }").when(k == 2, "fn f(a: u32, w: &mut Vec<T>) -> (r: u32) { 0 }")
    gen = gen.otherwise("fn f< T >(a: u32, w: &'a mut Vec< T >) -> (r: u32) { 0 }")
    clause = F.when(k == 3, F.format_string("a < %d && w.len() > 0", "p_size")).when(k == 4, F.format_string("old(w).len() + %d == old(*w).len()", "p_size")).otherwise("a == r")
    x = dealt(view(spark, d, "part").select("p_partkey", "p_size")).select("p_partkey", ref.alias("ref"), gen.alias("gen"), clause.alias("clause"), F.when(k == 3, "requires").otherwise("ensures").alias("kind"))
    x = x.withColumn("b", binding.binding("ref", "gen", F.lit("f"))).withColumn("c", binding.clause_predicate("ref", "gen", F.lit("f"), "clause", "kind", F.lit("generated")))
    shared = F.array_join(F.transform("b.values", lambda v: F.concat(v["reference"], F.lit("="), v["generated"], F.lit(">"), v["shared"])), ",")
    return x.select("p_partkey", "b.issue", shared.alias("shared"), "c.call", "c.body")

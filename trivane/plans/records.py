"""Queries for scans and sinks (S), encoders (P), scalar arithmetic (M) and checks (V)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trivane.functions import states as S
from trivane.operators import quality as Q
from trivane.plans.aggregations import IO_COLUMNS, MASK_SQL, checks
from trivane.plans.registry import query
from trivane.sources import scans, sinks
from trivane.views import KINDS, view


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def s02_unique_scan(spark, d):
    return scans.unique_rows(view(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")


@query("SELECT item_id, sha256(text) AS digest FROM benchmark")
def s03_h01_content_hash(spark, d):
    return view(spark, d, "benchmark").select("item_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query("SELECT count(*) AS records, count(k) AS parsed, CAST(sum(k) AS BIGINT) AS total FROM (SELECT CASE WHEN event_id % 10 = 3 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events)")
def s04_unreadable_records(spark, d):
    """Records that are no JSON stay in the denominator."""
    raw = view(spark, d, "events").select(F.when(F.col("event_id") % 10 == 3, F.concat(F.lit("{broken"), "props")).otherwise(F.col("props")).alias("raw"))
    k = F.try_variant_get(F.try_parse_json("raw"), "$.k", "bigint")
    return raw.agg(F.count(F.lit(1)).alias("records"), F.count(k).alias("parsed"), F.sum(k).alias("total"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type")
def s06_json_lines(spark, d):
    e = view(spark, d, "events").select("event_type", F.from_json("props", "k bigint").alias("p"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p.k").alias("total"))


@query("SELECT o_orderkey AS sample_id, c_custkey AS task_id, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'")
def s08_manifest(spark, d):
    m = view(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_custkey").alias("task_id"), "o_orderstatus")
    c = view(spark, d, "customer").select(F.col("c_custkey").alias("task_id"), "c_mktsegment")
    return scans.manifest(m, c, "task_id", o_orderstatus="P").drop("o_orderstatus")


@query("SELECT DISTINCT s.sample_id FROM samples s JOIN cases c ON s.sample_id = c.sample_id")
def s10_lenient_pairs(spark, d):
    return scans.paired_names(view(spark, d, "samples"), view(spark, d, "cases"), "sample_id", strict=False)


@query("SELECT (SELECT count(*) FROM (SELECT sample_id FROM samples EXCEPT SELECT sample_id FROM cases)) AS left_only, (SELECT count(*) FROM (SELECT sample_id FROM cases EXCEPT SELECT sample_id FROM samples)) AS right_only")
def s09_s10_unpaired(spark, d):
    return scans.unpaired_counts(view(spark, d, "samples"), view(spark, d, "cases"), "sample_id")


@query("SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def s11_catalog_lookup(spark, d):
    n = view(spark, d, "nation").join(view(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("key"), "n_name", "r_name", F.md5(F.col("n_name").cast("binary")).alias("expected"))
    s = view(spark, d, "supplier").join(n.select(F.col("key").alias("k2"), F.col("expected").alias("actual")), F.col("s_nationkey") == F.col("k2")).select("s_suppkey", F.col("s_nationkey").alias("key"), "actual")
    return scans.catalog_lookup(s, n, ["key"], "expected", "actual").select("s_suppkey", "n_name", "r_name")


@query("SELECT sample_id, kind, count(*) AS n FROM cases WHERE sample_id % 3 = 0 AND state <> 'unresolved' GROUP BY ALL")
def s12_validated_cases(spark, d):
    c = view(spark, d, "cases")
    status = F.when(F.col("state") == "unresolved", "open").otherwise("validated").alias("status")
    suites = c.groupBy(F.col("sample_id").alias("task_id")).agg(F.collect_list(F.struct("kind", status)).alias("cases")).select("task_id", F.lit("h").alias("source_hash"), F.lit("t").alias("target"), F.when(F.col("task_id") % 3 == 0, 3).otherwise(2).alias("schema_version"), F.lit(True).alias("complete"), "cases")
    current = view(spark, d, "samples").select(F.col("sample_id").alias("task_id"), F.lit("h").alias("source_hash"), F.lit("t").alias("target"))
    out = scans.validated_cases(suites, current)
    return out.groupBy(F.col("task_id").alias("sample_id"), F.col("case.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH m AS (SELECT task_id, [(task_id * 7 + i) % 61 FOR i IN range(1, CASE WHEN task_id % 9 = 4 THEN 5 ELSE 6 END)] AS n FROM (SELECT DISTINCT task_id FROM samples WHERE task_id <> 5)), t AS (SELECT DISTINCT task_id FROM samples)
SELECT task_id, 'not k distinct' AS reason FROM m WHERE len(n) <> 5 OR len(list_distinct(n)) <> 5 UNION SELECT task_id, 'own neighbour' FROM m WHERE len(n) = 5 AND len(list_distinct(n)) = 5 AND list_contains(n, task_id)
UNION SELECT task_id, 'unknown neighbour' FROM (SELECT task_id, unnest(n) AS x FROM m) WHERE x NOT IN (SELECT task_id FROM t) UNION SELECT task_id, 'no row' FROM t WHERE task_id NOT IN (SELECT task_id FROM m)""")
def s13_neighbour_checks(spark, d):
    t = view(spark, d, "samples").select("task_id").distinct()
    m = t.where("task_id <> 5").withColumn("neighbours", F.transform(F.sequence(F.lit(1), F.when(F.col("task_id") % 9 == 4, 4).otherwise(5)), lambda i: (F.col("task_id") * 7 + i) % 61))
    return scans.neighbour_violations(m, t)


@query("SELECT status, count(*) AS suites, CAST(sum(CASE WHEN points % 3 = 0 THEN 0 ELSE points END) AS BIGINT) AS positive_count, CAST(sum(pos) AS BIGINT) AS negative_count, CAST(0 AS BIGINT) AS invalid_count FROM candidates GROUP BY status")
def s14_suite_rollup(spark, d):
    c = view(spark, d, "candidates").select("status", F.when(F.col("points") % 3 != 0, F.col("points")).alias("positive_count"), F.col("pos").alias("negative_count"), F.lit(None).cast("long").alias("invalid_count"))
    return scans.suite_rollup(c)


@query("SELECT sample_id, CASE WHEN quality % 5 <> 0 THEN quality / 10.0 END AS x FROM samples WHERE quality IS NOT NULL")
def s16_without_nan(spark, d):
    s = view(spark, d, "samples").where("quality IS NOT NULL")
    return sinks.without_nan(s.select("sample_id", F.when(F.col("quality") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("quality") / 10.0).alias("x")))


@query("SELECT sample_id, quality, CAST(NULL AS VARCHAR) AS stage FROM samples WHERE eligible UNION ALL SELECT sample_id, NULL, stage FROM samples WHERE NOT eligible")
def s17_union_of_keys(spark, d):
    s = view(spark, d, "samples")
    return sinks.union_of_keys([s.where("eligible").select("sample_id", "quality"), s.where("NOT eligible").select("sample_id", "stage")])


@query("SELECT sample_id, quality AS quality_score, redundancy AS redundancy_score, CASE WHEN quality IS NULL THEN 'not_available' ELSE 'ok' END AS quality_status, CASE WHEN redundancy IS NULL THEN 'not_available' ELSE 'ok' END AS redundancy_status FROM samples")
def s19_wide_scores(spark, d):
    s = view(spark, d, "samples").select("sample_id", "quality", "redundancy").unpivot(["sample_id"], ["quality", "redundancy"], "metric", "score")
    return sinks.wide_scores(s.withColumn("status", F.when(F.col("score").isNull(), "not_available").otherwise("ok")), "sample_id", ["quality", "redundancy"])


@query("SELECT DISTINCT points % 100 AS k FROM candidates WHERE points % 100 NOT IN (SELECT points % 50 FROM candidates)")
def s23_cache_misses(spark, d):
    c = view(spark, d, "candidates")
    return sinks.cache_misses(c.select((F.col("points") % 100).alias("k")), c.select((F.col("points") % 50).alias("k")), "k")


@query("SELECT doc_id, CAST(coalesce(list_sum(list_transform(regexp_extract_all(text, ' ([0-9]{1,3})[.]', 1), lambda x: CAST(x AS BIGINT))), 0) AS BIGINT) AS numbers, CAST(coalesce(list_sum(list_transform(regexp_extract_all(text, 'Input tokens: ([0-9]+)', 1), lambda x: CAST(x AS BIGINT))), 0) AS BIGINT) AS tokens FROM documents")
def s24_regex_sums(spark, d):
    return scans.regex_sums(view(spark, d, "documents").select("doc_id", "text"), "text", {"numbers": " ([0-9]{1,3})[.]", "tokens": "Input tokens: ([0-9]+)"}).drop("text")


@query("SELECT sample_id, CASE stage WHEN 'parse_failed' THEN 'Parse' WHEN 'frontend_failed' THEN 'Frontend' WHEN 'proof_failed' THEN 'Proof' ELSE 'Accepted' END AS label, CASE stage WHEN 'parse_failed' THEN 0 WHEN 'frontend_failed' THEN 1 WHEN 'proof_failed' THEN 2 ELSE 3 END AS level FROM samples")
def s25_ordered_factor(spark, d):
    levels = [("parse_failed", "Parse"), ("frontend_failed", "Frontend"), ("proof_failed", "Proof"), ("accepted", "Accepted")]
    return scans.ordered_factor(view(spark, d, "samples").select("sample_id", "stage"), "stage", levels).drop("stage")


@query("SELECT sample_id, CAST(quality AS DOUBLE) / 100 AS score, CAST(quality AS DOUBLE) / 50 AS raw FROM samples WHERE quality <= 100")
def p01_p02_checked_scores(spark, d):
    s = view(spark, d, "samples").where("quality <= 100")
    return s.select("sample_id", S.unit(F.col("quality") / 100).alias("score"), S.number(F.col("quality") / 50).alias("raw"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 1.0 ELSE CAST(event_id % 50 AS DOUBLE) / 50 END AS score FROM events")
def p03_lenient_clamp(spark, d):
    i = F.col("event_id")
    raw = F.when(i % 4 == 0, "NaN").when(i % 4 == 1, "17.5").otherwise((i % 50 / 50).cast("string"))
    return view(spark, d, "events").select("event_id", raw.alias("raw")).select("event_id", S.clamp_score("raw").alias("score"))


@query("SELECT sample_id, CASE WHEN sample_id % 3 = 0 THEN CAST(quality AS DOUBLE) WHEN sample_id % 3 = 1 THEN NULL ELSE CAST(redundancy AS DOUBLE) END AS score, stage FROM samples")
def p04_p07_nested_records(spark, d):
    """Records as JSON, parsed once into variants: the generated side if that object is there, even without a score."""
    s = view(spark, d, "samples")
    gen = F.when(F.col("sample_id") % 3 == 0, F.struct(F.col("quality").alias("score"), F.lit(None).cast("string").alias("note"))).when(F.col("sample_id") % 3 == 1, F.struct(F.lit(None).cast("long").alias("score"), F.lit("x").alias("note")))
    metric = F.struct(F.col("redundancy").alias("score"), gen.alias("generated"))
    js = F.to_json(F.struct(F.struct(metric.alias("m")).alias("metrics"), F.struct(F.col("stage").alias("verification_stage")).alias("target_evaluation")))
    r = s.select("sample_id", F.parse_json(js).alias("r"), (F.col("sample_id") % 3 == 0).alias("g"))
    # A quality of null leaves the object {} behind, which is still there.
    return r.select("sample_id", scans.variant_side(F.col("r"), "m", "score").alias("score"), F.try_variant_get("r", "$.target_evaluation.verification_stage", "string").alias("stage"))


@query("SELECT sample_id, CASE WHEN 'unfavorable' IN (pre_false, post_true) THEN 'unfavorable' WHEN pre_false = 'favorable' AND post_true = 'favorable' THEN 'favorable' ELSE 'other' END AS combined, (quality > 30) AND (redundancy > 30) AS both FROM samples")
def p05_p06_three_values(spark, d):
    return view(spark, d, "samples").select("sample_id", S.combine(["pre_false", "post_true"]).alias("combined"), S.kleene_and(F.col("quality") > 30, F.col("redundancy") > 30).alias("both"))


@query("SELECT sample_id, CASE WHEN quality IS NULL THEN 'other' WHEN stage = 'parse_failed' THEN 'other' WHEN quality % 4 = 0 THEN 'too_strong' WHEN quality % 4 = 1 THEN 'too_weak' ELSE 'match' END AS verdict, quality % 3 = 1 AS advisory FROM samples WHERE quality IS NOT NULL")
def p08_intent_labels(spark, d):
    s = view(spark, d, "samples").where("quality IS NOT NULL")
    raw = F.when(F.col("quality") % 4 == 0, "over_strong").when(F.col("quality") % 4 == 1, "too_weak").otherwise("match")
    notes = F.when(F.col("quality") % 3 == 1, F.array(F.lit(" "), F.lit("check"))).when(F.col("quality") % 3 == 2, F.array(F.lit("  "))).otherwise(F.array().cast("array<string>"))
    verdict = F.when(F.col("stage") == "parse_failed", "other").otherwise(F.when(raw == "over_strong", "too_strong").otherwise(raw))
    return s.select("sample_id", verdict.alias("verdict"), F.exists(notes, lambda x: F.trim(x) != "").alias("advisory"))


@query("""
SELECT sample_id, CASE WHEN 'invalid' IN (pre_ref_to_gen, post_gen_to_ref) THEN 'fail' WHEN pre_ref_to_gen = 'valid' AND post_gen_to_ref = 'valid' THEN 'pass' ELSE 'unresolved' END AS reliability,
  CASE WHEN 'unfavorable' IN (pre_false, post_true) THEN 'fail' WHEN pre_false = 'favorable' AND post_true = 'favorable' THEN 'pass' ELSE 'unresolved' END AS triviality FROM samples""")
def p09_p12_states(spark, d):
    return view(spark, d, "samples").select("sample_id", S.formal_state("pre_ref_to_gen", "post_gen_to_ref").alias("reliability"), S.triviality_state("pre_false", "post_true").alias("triviality"))


@query("SELECT sample_id, " + ", ".join(f"CAST({k}_passed AS DOUBLE) / nullif({k}_passed + {k}_failed + {k}_unresolved, 0) AS {k}, CASE WHEN {k}_failed > 0 THEN 'fail' WHEN {k}_passed > 0 AND {k}_unresolved = 0 THEN 'pass' ELSE 'none' END AS {k}_state" for k in KINDS) + " FROM outcomes")
def p10_p11_io(spark, d):
    o = view(spark, d, "outcomes")
    cols = [c for k in KINDS for c in (S.io_score(k).alias(k), S.io_state(f"{k}_passed", f"{k}_failed", f"{k}_unresolved").alias(f"{k}_state"))]
    return o.select("sample_id", *cols)


@query("""
WITH e AS (SELECT s.*, CAST(io_correct_passed AS DOUBLE) / nullif(io_correct_passed + io_correct_failed + io_correct_unresolved, 0) AS io FROM samples s LEFT JOIN outcomes o ON s.sample_id = o.sample_id)
SELECT sample_id, 'accepted' AS metric, CASE WHEN stage = 'accepted' THEN 1.0 ELSE 0.0 END AS v FROM e UNION ALL SELECT sample_id, 'quality', CASE WHEN eligible THEN CAST(quality AS DOUBLE) END FROM e
UNION ALL SELECT sample_id, 'judged', CASE WHEN eligible AND stage NOT IN ('parse_failed', 'frontend_failed') THEN CAST(redundancy AS DOUBLE) END FROM e UNION ALL SELECT sample_id, 'trivial', CASE WHEN eligible THEN CASE pre_false WHEN 'favorable' THEN 1.0 WHEN 'unfavorable' THEN 0.0 END END FROM e
UNION ALL SELECT sample_id, 'reliability', CASE WHEN eligible THEN CASE WHEN 'invalid' IN (pre_ref_to_gen, post_gen_to_ref) THEN 0.0 WHEN pre_ref_to_gen = 'valid' AND post_gen_to_ref = 'valid' THEN 1.0 END END FROM e UNION ALL SELECT sample_id, 'io', CASE WHEN eligible THEN io END FROM e""")
def p14_p15_metric_encoder(spark, d):
    """All samples have the stage metric; others are null if the sample isn't eligible, and judged ones at early stages."""
    x = view(spark, d, "samples").join(view(spark, d, "outcomes"), "sample_id", "left")
    ok = F.col("eligible")
    formal = S.formal_state("pre_ref_to_gen", "post_gen_to_ref")
    cols = {
        "accepted": F.when(F.col("stage") == "accepted", 1.0).otherwise(0.0),
        "quality": F.when(ok, F.col("quality").cast("double")),
        "judged": F.when(ok & ~F.col("stage").isin("parse_failed", "frontend_failed"), F.col("redundancy").cast("double")),
        "trivial": F.when(ok & (F.col("pre_false") == "favorable"), 1.0).when(ok & (F.col("pre_false") == "unfavorable"), 0.0),
        "reliability": F.when(ok & (formal == "pass"), 1.0).when(ok & (formal == "fail"), 0.0),
        "io": F.when(ok, S.io_score("io_correct")),
    }
    return x.select("sample_id", *[c.alias(k) for k, c in cols.items()]).unpivot(["sample_id"], list(cols), "metric", "v")


@query(MASK_SQL + "SELECT sample_id, formal, io, triviality, flag_mask, complete, CASE WHEN flag_mask = '000' THEN '' WHEN triviality = 'fail' THEN 'counterexample_or_proved_triviality' WHEN io = 'fail' THEN 'unproved_io_failure' ELSE 'reference_rejection_only' END AS evidence FROM m")
def p16_p17_masks(spark, d):
    c = checks(spark, d)
    ev = F.when(F.col("flag_mask") == "000", "").when(F.col("triviality") == "fail", "counterexample_or_proved_triviality").when(F.col("io") == "fail", "unproved_io_failure").otherwise("reference_rejection_only")
    return c.withColumn("evidence", ev)


@query("""
SELECT candidate_id, CASE WHEN points % 5 = 0 THEN 'unavailable' WHEN points % 3 = 0 AND points % 2 = 0 THEN 'valid' WHEN points % 3 = 1 AND points % 2 = 1 THEN 'invalid' ELSE 'unknown' END AS state FROM candidates""")
def p18_implication_state(spark, d):
    p = F.col("points")
    status = F.when(p % 5 != 0, F.when(p % 3 == 0, "valid").when(p % 3 == 1, "invalid").otherwise("timeout"))
    return view(spark, d, "candidates").select("candidate_id", S.implication_state(status, F.when(p % 5 != 0, p % 2 == 0)).alias("state"))


@query("""
WITH c AS (SELECT sample_id, count(*) AS n, bool_and(state = 'passed') AS all_valid, bool_and(state <> 'unresolved') AS decided FROM cases GROUP BY sample_id)
SELECT s.sample_id, CASE WHEN c.sample_id IS NULL THEN 'unavailable' WHEN n <> 3 THEN 'unknown' WHEN all_valid THEN 'valid' WHEN decided THEN 'invalid' ELSE 'unknown' END AS direction FROM samples s LEFT JOIN c ON s.sample_id = c.sample_id""")
def p19_clause_direction(spark, d):
    """A direction is decided only if every expected clause (here 3) has been checked and decided."""
    c = view(spark, d, "cases").groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("state") == "passed").alias("v"), F.bool_and(F.col("state") != "unresolved").alias("k"))
    x = view(spark, d, "samples").select("sample_id").join(c, "sample_id", "left")
    return x.select("sample_id", F.when(F.col("n").isNull(), "unavailable").when(F.col("n") != 3, "unknown").when(F.col("v"), "valid").when(F.col("k"), "invalid").otherwise("unknown").alias("direction"))


@query("SELECT sample_id, stage, CASE WHEN eligible THEN pre_ref_to_gen ELSE 'unavailable' END AS pre, CASE WHEN eligible THEN post_true ELSE 'other' END AS trivial FROM samples")
def p20_target_summary(spark, d):
    """Ineligible samples have no directions and no triviality, whatever their records say."""
    s = view(spark, d, "samples")
    target = F.struct("stage", F.when(F.col("eligible"), F.col("pre_ref_to_gen")).otherwise("unavailable").alias("pre"), F.when(F.col("eligible"), F.col("post_true")).otherwise("other").alias("trivial"))
    return s.select("sample_id", target.alias("t")).select("sample_id", "t.*")


@query("WITH a AS (SELECT sample_id, list(amount) FILTER (kind = 'io_correct') AS m FROM cases GROUP BY sample_id) SELECT sample_id, CASE WHEN len(m) = 1 THEN m[1] END AS amount FROM a")
def p21_unique_match(spark, d):
    """The element that matches, if exactly one does."""
    a = view(spark, d, "cases").groupBy("sample_id").agg(F.collect_list(F.struct("kind", "amount")).alias("a"))
    m = F.filter("a", lambda x: x["kind"] == "io_correct")
    return a.select("sample_id", F.when(F.size(m) == 1, F.get(m, F.lit(0))["amount"]).alias("amount"))


@query("""
WITH s AS (SELECT sample_id, kind, state = 'passed' AS ok, state = 'failed' AS bad, amount % 2 = 0 AS proved, amount % 11 = 0 AS undefd FROM cases)
SELECT sample_id, kind, CASE WHEN bool_or(bad AND (kind <> 'io_invalid' OR proved)) THEN 'behavior_detected' WHEN bool_or((bad AND kind = 'io_invalid' AND NOT proved) OR undefd) THEN 'diagnostic_only' WHEN bool_and(ok) THEN 'missed' ELSE 'unresolved' END AS state FROM s GROUP BY sample_id, kind""")
def p22_case_state(spark, d):
    c = view(spark, d, "cases")
    success = F.when(F.col("state") == "passed", True).when(F.col("state") == "failed", False)
    row = F.struct(success.alias("success"), (F.col("amount") % 2 == 0).alias("requires_accepted"), F.when(F.col("amount") % 11 == 0, "contract_expression_undefined").alias("reason"), F.lit(None).cast("string").alias("reason_detail"))
    a = c.groupBy("sample_id", "kind").agg(F.collect_list(row).alias("a"))
    return a.select("sample_id", "kind", F.when(F.col("kind") == "io_invalid", S.case_state("a", True)).otherwise(S.case_state("a", False)).alias("state"))


@query("""
WITH g AS (SELECT candidate_id, CASE points % 4 WHEN 0 THEN 'detected' WHEN 1 THEN 'clear' WHEN 2 THEN 'unresolved' ELSE 'unavailable' END AS base, CASE points % 3 WHEN 0 THEN 'detected' WHEN 1 THEN 'clear' ELSE 'unresolved' END AS changed FROM candidates)
SELECT candidate_id, base, CASE WHEN base = 'clear' THEN changed ELSE 'base_not_clear' END AS pair FROM g""")
def p24_pair_state(spark, d):
    p = F.col("points")
    base = S.suite_state(F.when(p % 4 == 2, "partial").otherwise("ok"), F.when(p % 4 == 0, 1).otherwise(0), F.when(p % 4 == 2, 1).otherwise(0), F.when(p % 4 == 3, 0).otherwise(5))
    changed = S.suite_state(F.when(p % 3 == 2, "partial").otherwise("ok"), F.when(p % 3 == 0, 2).otherwise(0), F.when(p % 3 == 2, 1).otherwise(0), F.lit(5))
    return view(spark, d, "candidates").select("candidate_id", base.alias("base"), S.pair_state(base, changed).alias("pair"))


@query("""
WITH b AS (SELECT candidate_id, ['pre_strengthening', 'pre_omission', 'pre_weakening', 'post_strengthening', 'post_weakening'][points % 5 + 1] AS dir, CASE (points // 5) % 3 WHEN 0 THEN true WHEN 1 THEN false END AS bp, CASE (points // 15) % 3 WHEN 0 THEN true WHEN 1 THEN false END AS mp, CASE (points // 45) % 3 WHEN 0 THEN true WHEN 1 THEN false END AS bc, CASE (points // 135) % 3 WHEN 0 THEN true WHEN 1 THEN false END AS mc FROM candidates)
SELECT candidate_id, CASE WHEN dir = 'pre_strengthening' THEN bp IS TRUE AND mp IS FALSE WHEN dir IN ('pre_omission', 'pre_weakening') THEN bp IS FALSE AND mp IS TRUE WHEN dir = 'post_strengthening' THEN bp IS TRUE AND mp IS TRUE AND bc IS TRUE AND mc IS FALSE ELSE bp IS TRUE AND mp IS TRUE AND bc IS FALSE AND mc IS TRUE END AS witness,
  CASE WHEN mc THEN 'wrong_output_accepted' WHEN NOT mp THEN 'wrong_input_rejected' WHEN mp AND NOT mc THEN 'admitted_input_output_rejected' WHEN mp IS NULL AND NOT mc THEN 'input_admission_unresolved' ELSE 'output_rejection_unresolved' END AS decision FROM b""")
def p25_p26_decisions(spark, d):
    p = F.col("points")
    tri = lambda k: F.when(F.floor(p / k) % 3 == 0, True).when(F.floor(p / k) % 3 == 1, False)
    names = F.array(*[F.lit(x) for x in ("pre_strengthening", "pre_omission", "pre_weakening", "post_strengthening", "post_weakening")])
    x = view(spark, d, "candidates").select("candidate_id", F.element_at(names, (p % 5 + 1).cast("int")).alias("dir"), tri(5).alias("bp"), tri(15).alias("mp"), tri(45).alias("bc"), tri(135).alias("mc"))
    return x.select("candidate_id", S.witness("dir", "bp", "mp", "bc", "mc").alias("witness"), S.wrong_output_decision("mc", "mp")["reason"].alias("decision"))


@query("""
WITH b AS (SELECT candidate_id, CASE points % 3 WHEN 0 THEN true WHEN 1 THEN false END AS f, CASE (points // 3) % 3 WHEN 0 THEN true WHEN 1 THEN false END AS g FROM candidates)
SELECT candidate_id, CASE WHEN f IS NULL OR g IS NULL THEN 'unknown' WHEN f AND g THEN 'equivalent' WHEN f THEN 'generated_stronger_or_equal' WHEN g THEN 'generated_weaker_or_equal' ELSE 'incomparable' END AS relation, CASE WHEN f AND g THEN 'equivalent' WHEN f THEN 'generated_refines_reference' WHEN g THEN 'reference_refines_generated' WHEN f IS NULL OR g IS NULL THEN 'unknown' ELSE 'incomparable' END AS refinement FROM b""")
def p27_relations(spark, d):
    p = F.col("points")
    tri = lambda x: F.when(x % 3 == 0, True).when(x % 3 == 1, False)
    f, g = tri(p), tri(F.floor(p / 3))
    return view(spark, d, "candidates").select("candidate_id", S.relation(f, g).alias("relation"), S.refinement(f, g, F.lit("ok")).alias("refinement"))


@query("SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'), ' ') AS clause FROM documents")
def p30_normalized_clause(spark, d):
    return view(spark, d, "documents").select("doc_id", F.trim(F.regexp_replace("text", r"[ \t\n\r\f\x0B]+", " ")).alias("clause"))


RULES = ("pre_rel", "post_rel", "pre_comp", "post_comp")
_RULE_SQL = "WITH r AS (SELECT sample_id, CASE WHEN sample_id % 7 = 0 THEN NULL ELSE CAST(least(quality, 90) AS DOUBLE) / 90 END AS pre_rel, CASE WHEN sample_id % 6 = 0 THEN NULL ELSE CAST(least(redundancy, 80) AS DOUBLE) / 80 END AS post_rel, 1e0 AS pre_comp, CAST(sample_id % 5 AS DOUBLE) / 4 AS post_comp FROM samples)"


def rule_scores(spark, d):
    i = F.col("sample_id")
    return view(spark, d, "samples").select(
        "sample_id",
        F.when(i % 7 != 0, F.least("quality", F.lit(90).cast("long")) / 90).alias("pre_rel"),
        F.when(i % 6 != 0, F.least("redundancy", F.lit(80).cast("long")) / 80).alias("post_rel"),
        F.lit(1.0).alias("pre_comp"),
        (i % 5 / 4).alias("post_comp"),
    )


@query(_RULE_SQL + """
SELECT sample_id, CASE WHEN pre_rel IS NULL OR post_rel IS NULL THEN NULL WHEN pre_rel = 1 AND post_rel = 1 THEN 1e0 ELSE 0e0 END AS rule_rel, (pre_rel + post_rel) / 2 AS approx_rel, CASE WHEN pre_comp = 1 AND post_comp = 1 THEN 1e0 ELSE 0e0 END AS rule_comp, (pre_comp + post_comp) / 2 AS approx_comp,
  CASE WHEN pre_rel IS NULL OR post_rel IS NULL THEN NULL WHEN pre_rel = 1 AND post_rel = 1 AND pre_comp = 1 AND post_comp = 1 THEN 1e0 ELSE 0e0 END AS rule_correct, ((pre_rel + post_rel) / 2 + (pre_comp + post_comp) / 2) / 2 AS approx_correct FROM r""")
def p31_derived_rules(spark, d):
    r = rule_scores(spark, d)
    both = lambda a, b: F.when(F.col(a).isNull() | F.col(b).isNull(), None).otherwise(F.least(S.strict(a), S.strict(b)))
    r = r.select("sample_id", both("pre_rel", "post_rel").alias("rule_rel"), S.mean_or_null("pre_rel", "post_rel").alias("approx_rel"), both("pre_comp", "post_comp").alias("rule_comp"), S.mean_or_null("pre_comp", "post_comp").alias("approx_comp"))
    return r.select("*", both("rule_rel", "rule_comp").alias("rule_correct"), S.mean_or_null("approx_rel", "approx_comp").alias("approx_correct"))


@query(_RULE_SQL + ", z AS (SELECT sample_id, coalesce(pre_rel, 0e0) AS a, coalesce(post_rel, 0e0) AS b, pre_comp AS c, post_comp AS e FROM r) SELECT sample_id, CASE WHEN a = 1 AND b = 1 THEN 1e0 ELSE 0e0 END AS rule_rel, (a + b) / 2 AS approx_rel, CASE WHEN a = 1 AND b = 1 AND c = 1 AND e = 1 THEN 1e0 ELSE 0e0 END AS rule_correct FROM z")
def p32_conservative_rules(spark, d):
    r = rule_scores(spark, d).fillna(0.0)
    one = lambda *cs: F.least(*[S.strict(c) for c in cs])
    return r.select("sample_id", one("pre_rel", "post_rel").alias("rule_rel"), S.mean_unknown_zero("pre_rel", "post_rel").alias("approx_rel"), one(*RULES).alias("rule_correct"))


@query("SELECT s.sample_id, CASE WHEN o.sample_id IS NULL THEN 0.0 ELSE coalesce(CAST(io_wrong_passed AS DOUBLE) / nullif(io_wrong_passed + io_wrong_failed + io_wrong_unresolved, 0), 0.0) END AS score, coalesce(CAST(redundancy AS DOUBLE), 1.0) AS imputed FROM samples s LEFT JOIN outcomes o ON s.sample_id = o.sample_id")
def p33_p34_conservative(spark, d):
    x = view(spark, d, "samples").join(view(spark, d, "outcomes"), "sample_id", "left").fillna(0, IO_COLUMNS)
    return x.select("sample_id", S.conservative(F.col("io_wrong_passed"), S.io_total("io_wrong")).alias("score"), S.imputed(F.col("redundancy").cast("double"), F.lit(True), F.lit(False)).alias("imputed"))


@query("SELECT sample_id, coalesce(quality, redundancy, -1) AS v FROM samples")
def p35_first_present(spark, d):
    return view(spark, d, "samples").select("sample_id", S.first_present("quality", "redundancy", F.lit(-1).cast("long")).alias("v"))


@query("""
WITH r AS (SELECT candidate_id, ['verified', 'verification_failed', 'timeout', 'tool_error', 'resource_exhausted', 'parse_error'][points % 6 + 1] AS run, [NULL, 'verified', 'parse_error', 'timeout'][(points // 6) % 4 + 1] AS fe FROM candidates)
SELECT candidate_id, CASE WHEN run = 'verified' THEN 'survived' WHEN run IN ('timeout', 'tool_error', 'resource_exhausted') OR fe IS NULL THEN 'unknown' WHEN fe = 'verified' THEN 'killed' WHEN fe = 'timeout' THEN 'unknown' ELSE 'invalid_mutant' END AS mutant,
  CASE WHEN run = 'verified' THEN 'removable' WHEN run NOT IN ('timeout', 'tool_error', 'resource_exhausted') AND coalesce(fe = 'verified', false) THEN 'necessary' ELSE 'unknown' END AS removal FROM r""")
def p36_p37_outcomes(spark, d):
    p = F.col("points")
    pick = lambda i, *xs: F.element_at(F.array(*[F.lit(x).cast("string") for x in xs]), (i + 1).cast("int"))
    r = view(spark, d, "candidates").select("candidate_id", pick(p % 6, "verified", "verification_failed", "timeout", "tool_error", "resource_exhausted", "parse_error").alias("run"), pick(F.floor(p / 6) % 4, None, "verified", "parse_error", "timeout").alias("fe"))
    return r.select("candidate_id", S.mutant_outcome("run", "fe").alias("mutant"), S.removal_outcome("run", "fe").alias("removal"))


@query("""
WITH r AS (SELECT candidate_id, ['done', 'timeout', 'unavailable', 'parse_error', 'done', 'done', 'done'][points % 7 + 1] AS st, CASE points % 3 WHEN 0 THEN true WHEN 1 THEN false END AS ok, ['process ran Out of Memory', 'error: expected `;`, found `}`', 'postcondition not satisfied', 'Parsed 3 items'][(points // 7) % 4 + 1] AS o, CASE WHEN points % 11 = 0 THEN -9 ELSE 1 END AS rc FROM candidates)
SELECT candidate_id, CASE WHEN st = 'timeout' THEN 'timeout' WHEN st = 'unavailable' THEN 'tool_error' WHEN st = 'parse_error' THEN 'parse_error' WHEN ok THEN 'verified' WHEN ok IS NULL THEN 'tool_error' WHEN o LIKE '%Memory' THEN 'resource_exhausted' WHEN rc < 0 THEN 'tool_error' WHEN o LIKE 'error: expected%' OR o LIKE 'Parsed%' THEN 'parse_error' ELSE 'verification_failed' END AS outcome FROM r""")
def p38_run_outcome(spark, d):
    p = F.col("points")
    pick = lambda i, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (i + 1).cast("int"))
    r = view(spark, d, "candidates").select("candidate_id", pick(p % 7, "done", "timeout", "unavailable", "parse_error", "done", "done", "done").alias("st"), F.when(p % 3 == 0, True).when(p % 3 == 1, False).alias("ok"), pick(F.floor(p / 7) % 4, "process ran Out of Memory", "error: expected `;`, found `}`", "postcondition not satisfied", "Parsed 3 items").alias("o"), F.when(p % 11 == 0, -9).otherwise(1).alias("rc"))
    return r.select("candidate_id", S.run_outcome("st", "ok", "o", "rc").alias("outcome"))


@query("SELECT stage, count(*) AS n FROM samples WHERE eligible AND stage IN ('accepted', 'proof_failed') GROUP BY stage")
def p40_populations(spark, d):
    return view(spark, d, "samples").where(F.col("eligible") & F.col("stage").isin("accepted", "proof_failed")).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


@query("WITH r AS (SELECT sample_id, CAST(quality AS DOUBLE) / nullif(redundancy, 0) AS p, CAST(redundancy AS DOUBLE) / 100 AS r FROM samples) SELECT sample_id, p, CASE WHEN p IS NULL OR r IS NULL THEN NULL WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f1 FROM r")
def m01_m02_ratio_f1(spark, d):
    x = view(spark, d, "samples").select("sample_id", S.ratio("quality", "redundancy").alias("p"), (F.col("redundancy") / 100).alias("r"))
    return x.select("sample_id", "p", S.f1("p", "r").alias("f1"))


@query("SELECT sample_id, 'quality' AS \"column\", CAST(quality AS VARCHAR) AS \"left\", CAST(quality + 1 AS VARCHAR) AS \"right\" FROM samples WHERE sample_id % 100 = 1 AND quality IS NOT NULL UNION ALL SELECT sample_id, '(row)', 'true', NULL FROM samples WHERE sample_id % 250 = 2")
def v01_table_differences(spark, d):
    a = view(spark, d, "samples").select("sample_id", "quality", (F.col("redundancy") / 3).alias("x"))
    b = a.where("sample_id % 250 <> 2").select("sample_id", F.when(F.col("sample_id") % 100 == 1, F.col("quality") + 1).otherwise(F.col("quality")).alias("quality"), (F.col("x") + 1e-14).alias("x"))
    return Q.table_differences(a, b, ["sample_id"])


@query("SELECT sample_id, 'cases_have_samples' AS rule FROM (SELECT DISTINCT sample_id FROM cases) WHERE sample_id NOT IN (SELECT sample_id FROM samples) UNION ALL SELECT sample_id, 'quality_known' FROM samples WHERE quality IS NULL UNION ALL SELECT sample_id, 'quality_in_range' FROM samples WHERE quality IS NULL OR quality > 99")
def v02_violations(spark, d):
    s = view(spark, d, "samples")
    rules = Q.violations(s, "sample_id", {"quality_known": F.col("quality").isNotNull(), "quality_in_range": F.col("quality").between(0, 99)})
    orphans = view(spark, d, "cases").select("sample_id").distinct().join(s, "sample_id", "left_anti").select("sample_id", F.lit("cases_have_samples").alias("rule"))
    return orphans.unionByName(rules)


@query("WITH p AS (SELECT workflow, shot, count(*) AS rows, count(DISTINCT task_id) AS tasks FROM samples GROUP BY ALL) SELECT *, (SELECT count(DISTINCT task_id) FROM samples) AS all_tasks FROM p WHERE rows <> tasks OR tasks <> (SELECT count(DISTINCT task_id) FROM samples)")
def v02_coverage_gaps(spark, d):
    return Q.coverage_gaps(view(spark, d, "samples"), ["workflow", "shot"], "task_id")


@query("SELECT sample_id, 'quality' AS metric, CAST(quality AS DOUBLE) + 0.5 AS shown, CAST(quality AS DOUBLE) AS score FROM samples WHERE sample_id % 300 = 7 AND quality IS NOT NULL")
def v03_score_mismatches(spark, d):
    long = view(spark, d, "samples").select("sample_id", F.col("quality").cast("double").alias("quality"), F.col("redundancy").cast("double").alias("redundancy")).unpivot(["sample_id"], ["quality", "redundancy"], "metric", "score")
    bad = (F.col("sample_id") % 300 == 7) & (F.col("metric") == "quality")
    wide = sinks.wide_scores(long.withColumn("score", F.when(bad, F.col("score") + 0.5).otherwise(F.col("score"))).withColumn("status", F.lit("ok")), "sample_id", ["quality", "redundancy"])
    return Q.score_mismatches(wide, "sample_id", long, ["quality", "redundancy"])


@query("SELECT workflow, model, shot, stage, eligible, min(sample_id) AS sample_id FROM samples GROUP BY workflow, model, shot, stage, eligible")
def v05_audit_sample(spark, d):
    s = view(spark, d, "samples").select("workflow", "model", "shot", "stage", "eligible", "sample_id")
    return Q.stratified_first(s, ["workflow", "model", "shot", "stage", "eligible"], "sample_id")


@query("SELECT candidate_id, concat(replace(replace(concat(operator, '::', status), '::', '__'), '/', '_'), '_', split_part(concat('a/b/', operator), '/', -1)) AS name FROM candidates")
def f16_file_names(spark, d):
    c = view(spark, d, "candidates")
    return c.select("candidate_id", F.concat_ws("_", sinks.file_safe(F.concat_ws("::", "operator", "status")), sinks.last_segment(F.concat(F.lit("a/b/"), "operator"))).alias("name"))


@query("""
WITH e AS (SELECT candidate_id, points % 5 <> 0 AS cb, points % 7 <> 0 AS ca, points % 6 = 0 AS ok, ['type', 'proof', 'index'][points % 3 + 1] AS t, points % 4 AS bit, points % 10 AS o1, points % 9 AS o2, points % 5 AS e1, points % 6 AS e2 FROM candidates),
f AS (SELECT *, CASE WHEN bit % 2 = 1 THEN ['type'] ELSE [] END || CASE WHEN bit >= 2 THEN ['proof', 'index'] ELSE [] END AS errs FROM e)
SELECT candidate_id, CASE WHEN cb AND NOT ca THEN 'compilation regression' WHEN ok THEN 'verified' WHEN NOT list_contains(errs, t) THEN 'resolved ' || t WHEN o2 >= o1 AND e2 <= e1 THEN 'score stable or improved' ELSE 'score regressed' END AS reason FROM f""")
def y19_acceptance_rule(spark, d):
    p = F.col("points")
    errs = F.concat(F.when(p % 4 % 2 == 1, F.array(F.lit("type"))).otherwise(F.array().cast("array<string>")), F.when(p % 4 >= 2, F.array(F.lit("proof"), F.lit("index"))).otherwise(F.array().cast("array<string>")))
    t = F.element_at(F.array(F.lit("type"), F.lit("proof"), F.lit("index")), (p % 3 + 1).cast("int"))
    rule = S.acceptance_rule(p % 5 != 0, p % 7 != 0, p % 6 == 0, t, errs, (p % 10, p % 9), (p % 5, p % 6))
    return view(spark, d, "candidates").select("candidate_id", rule["reason"].alias("reason"))


@query("SELECT sample_id, CASE WHEN quality > 60 THEN true WHEN quality < 30 THEN false END AS decision FROM samples")
def y08_dual_proof(spark, d):
    return view(spark, d, "samples").select("sample_id", S.dual_proof(F.coalesce(F.col("quality") > 60, F.lit(False)), F.coalesce(F.col("quality") < 30, F.lit(False))).alias("decision"))


@query("SELECT workflow, model, task_id FROM (SELECT DISTINCT workflow FROM samples), (SELECT DISTINCT model FROM samples), (SELECT DISTINCT task_id FROM samples) EXCEPT SELECT workflow, model, task_id FROM samples WHERE stage = 'accepted'")
def y14_work_list(spark, d):
    from trivane.operators.joins import work_list

    s = view(spark, d, "samples")
    return work_list([s.select(k).distinct() for k in ("workflow", "model", "task_id")], s.where("stage = 'accepted'"), ["workflow", "model", "task_id"])


@query("SELECT split_part(concat(operator, '__', status), '__', 1) AS project, count(*) AS done, CAST(max(total) AS BIGINT) AS total, count(*) >= max(total) AS complete FROM candidates JOIN (SELECT operator AS op, count(*) AS total FROM candidates GROUP BY operator) t ON t.op = operator WHERE status <> 'error' GROUP BY ALL")
def y18_progress(spark, d):
    c = view(spark, d, "candidates")
    total = c.groupBy("operator").agg(F.count(F.lit(1)).alias("total"))
    done = c.where("status <> 'error'").select(F.split_part(F.concat_ws("__", "operator", "status"), F.lit("__"), F.lit(1)).alias("project")).groupBy("project").agg(F.count(F.lit(1)).alias("done"))
    return done.join(total, F.col("project") == F.col("operator")).select("project", "done", "total", (F.col("done") >= F.col("total")).alias("complete"))


@query("SELECT sample_id, coalesce(nullif(CASE WHEN quality % 3 = 0 THEN '' ELSE CAST(quality AS VARCHAR) END, ''), nullif(CAST(redundancy AS VARCHAR), ''), 'default') AS setting, greatest(coalesce(CAST(quality AS DOUBLE), 0) / 100, coalesce(CAST(redundancy AS DOUBLE), 0) / 100) AS redundancy_rate FROM samples")
def y16_y23_settings(spark, d):
    q = F.when(F.col("quality") % 3 == 0, "").otherwise(F.col("quality").cast("string"))
    z = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) / 100
    return view(spark, d, "samples").select("sample_id", F.coalesce(F.nullif(q, F.lit("")), F.nullif(F.col("redundancy").cast("string"), F.lit("")), F.lit("default")).alias("setting"), F.greatest(z("quality"), z("redundancy")).alias("redundancy_rate"))


@query("""
WITH a AS (SELECT DISTINCT sample_id, part_id FROM cases WHERE kind = 'io_correct'), b AS (SELECT DISTINCT sample_id, part_id FROM cases WHERE kind = 'io_wrong')
SELECT coalesce(a.sample_id, b.sample_id) AS sample_id, count(*) FILTER (a.part_id IS NOT NULL AND b.part_id IS NOT NULL) AS matched, count(*) FILTER (b.part_id IS NULL) AS missing, count(*) FILTER (a.part_id IS NULL) AS extra FROM a FULL JOIN b ON a.sample_id = b.sample_id AND a.part_id = b.part_id GROUP BY ALL""")
def y24_alignment(spark, d):
    """Blocks of two sides by name: matched, missing on the right, extra there; one aggregation instead of a full join."""
    c = view(spark, d, "cases").where("kind <> 'io_invalid'").groupBy("sample_id", "part_id").agg(F.bool_or(F.col("kind") == "io_correct").alias("l"), F.bool_or(F.col("kind") == "io_wrong").alias("r"))
    return c.groupBy("sample_id").agg(S.long_if(F.col("l") & F.col("r")).alias("matched"), S.long_if(F.col("l") & ~F.col("r")).alias("missing"), S.long_if(~F.col("l") & F.col("r")).alias("extra"))


@query("""
WITH b AS (SELECT s.*, coalesce(io_correct_passed, 0) AS p, coalesce(io_correct_failed, 0) AS f, coalesce(io_correct_unresolved, 0) AS u, s.quality % 4 AS v FROM samples s LEFT JOIN outcomes o ON s.sample_id = o.sample_id)
SELECT concat_ws('|', workflow, model, shot, sample_id) AS sample_id, stage AS verification_stage, CASE WHEN 'invalid' IN (pre_ref_to_gen, post_gen_to_ref, pre_gen_to_ref, post_ref_to_gen) THEN 'unfavorable' WHEN pre_ref_to_gen = 'valid' AND post_gen_to_ref = 'valid' AND pre_gen_to_ref = 'valid' AND post_ref_to_gen = 'valid' THEN 'favorable' ELSE 'other' END AS formal_state,
  CAST(p AS BIGINT) AS io_correct_passed, CASE WHEN f > 0 THEN 'unfavorable' WHEN p > 0 AND u = 0 THEN 'favorable' ELSE 'other' END AS io_state, CASE WHEN quality IS NULL THEN 'unknown' WHEN v = 0 THEN 'equivalent' WHEN v = 1 THEN 'too_strong' ELSE 'incorrect' END AS llm_intent_verdict,
  CASE WHEN quality IS NULL THEN 'other' WHEN v = 0 THEN 'favorable' ELSE 'unfavorable' END AS llm_intent_state, coalesce(v = 1, false) AS llm_intent_advisory, CASE WHEN redundancy IS NULL THEN 'missing' ELSE 'ok' END AS redundancy_status, 1.0::DOUBLE - CAST(redundancy AS DOUBLE) / 100 AS redundancy_score,
  concat_ws(';', CASE WHEN pre_false = 'unfavorable' THEN 'pre_false' END, CASE WHEN post_true = 'unfavorable' THEN 'post_true' END, CASE WHEN pre_false <> 'unfavorable' AND post_true <> 'unfavorable' THEN 'none' END) AS triviality_form FROM b""")
def p07_p08_p20_flatten(spark, d):
    """Nested records flattened to labels and outcomes in one projection."""
    from trivane.sources.records import NAMES, flatten

    x = view(spark, d, "samples").join(view(spark, d, "outcomes"), "sample_id", "left").fillna(0, IO_COLUMNS)
    q, v = F.col("quality"), F.col("quality") % 4
    total = F.col("io_correct_passed") + F.col("io_correct_failed") + F.col("io_correct_unresolved")
    io = F.struct(F.struct(F.col("io_correct_passed").alias("passed"), F.col("io_correct_failed").alias("failed"), F.col("io_correct_unresolved").alias("unknown"), total.alias("total")).alias("generated"))
    verdict = F.when(v == 0, "equivalent").when(v == 1, "over_strong").otherwise("incorrect")
    notes = F.when(v == 1, F.array(F.lit(" "), F.lit("x"))).otherwise(F.array(F.lit(" ")))
    intent = F.when(q.isNotNull(), F.struct(F.lit("ok").alias("status"), F.lit(1.0).alias("score"), F.struct(F.lit("ok").alias("status"), verdict.alias("verdict"), notes.alias("vacuity_risks")).alias("generated"), F.struct(F.lit("ok").alias("status")).alias("llm")))
    red = F.when(F.col("redundancy").isNotNull(), F.struct(F.lit("ok").alias("status"), (F.col("redundancy") / 100).alias("score")))
    target = F.struct(
        F.concat_ws("|", "workflow", "model", "shot", F.col("sample_id").cast("string")).alias("sample_id"),
        F.col("stage").alias("verification_stage"),
        F.col("eligible").alias("analysis_eligible"),
        F.struct("pre_ref_to_gen", "post_gen_to_ref", "pre_gen_to_ref", "post_ref_to_gen").alias("directions"),
        F.struct(F.col("pre_false").alias("precondition_falsity"), F.col("post_true").alias("postcondition_truth")).alias("triviality"),
    )
    metrics = F.struct(io.alias(NAMES["io_correct"]), intent.alias(NAMES["intent"]), red.alias(NAMES["redundancy"]))
    out = flatten(x.select(F.parse_json(F.to_json(F.struct(target.alias("target_evaluation"), metrics.alias("metrics")))).alias("record")))
    return out.select("sample_id", "verification_stage", "formal_state", "io_correct_passed", "io_state", "llm_intent_verdict", "llm_intent_state", "llm_intent_advisory", "redundancy_status", "redundancy_score", "triviality_form")

"""Queries for the aggregation operators (A1-A39), each on the evidence views."""

from __future__ import annotations

from pyspark.sql import functions as F

from trivane.functions import states as S
from trivane.operators import aggregates as A
from trivane.plans.registry import query
from trivane.views import DIRECTIONS, KINDS, view

IO_COLUMNS = [f"{k}_{s}" for k in KINDS for s in ("passed", "failed", "unresolved")]


def profiles(spark, d):
    """Accepted samples with their case outcome and formal states (P13); samples without cases have zero counts."""
    s = view(spark, d, "samples").where("stage = 'accepted'")
    o = view(spark, d, "outcomes")
    x = s.join(o, "sample_id", "left").fillna(0, IO_COLUMNS)
    total = lambda state: sum((F.col(f"{k}_{state}") for k in KINDS[1:]), F.col(f"{KINDS[0]}_{state}"))
    x = x.withColumns({"passed": total("passed"), "failed": total("failed"), "unresolved": total("unresolved")})
    return x.withColumns(
        {
            "io_state": S.profile_state("passed", "failed", "unresolved"),
            "kinds": F.size(F.filter(F.array(*[S.io_total(k) for k in KINDS]), lambda n: n > 0)).cast("long"),
            "equivalence": S.formal_state(*DIRECTIONS),
            "reliability": S.formal_state("pre_ref_to_gen", "post_gen_to_ref"),
            "completeness": S.formal_state("pre_gen_to_ref", "post_ref_to_gen"),
        }
    )


PROFILE_SQL = """
prof AS (SELECT s.*, coalesce(io_correct_passed + io_wrong_passed + io_invalid_passed, 0) AS passed, coalesce(io_correct_failed + io_wrong_failed + io_invalid_failed, 0) AS failed,
    coalesce(io_correct_unresolved + io_wrong_unresolved + io_invalid_unresolved, 0) AS unresolved,
    coalesce(CAST(io_correct_passed + io_correct_failed + io_correct_unresolved > 0 AS INT), 0) + coalesce(CAST(io_wrong_passed + io_wrong_failed + io_wrong_unresolved > 0 AS INT), 0) + coalesce(CAST(io_invalid_passed + io_invalid_failed + io_invalid_unresolved > 0 AS INT), 0) AS kinds,
    CASE WHEN 'invalid' IN (pre_ref_to_gen, post_gen_to_ref, pre_gen_to_ref, post_ref_to_gen) THEN 'fail' WHEN pre_ref_to_gen = 'valid' AND post_gen_to_ref = 'valid' AND pre_gen_to_ref = 'valid' AND post_ref_to_gen = 'valid' THEN 'pass' ELSE 'unresolved' END AS equivalence,
    CASE WHEN 'invalid' IN (pre_ref_to_gen, post_gen_to_ref) THEN 'fail' WHEN pre_ref_to_gen = 'valid' AND post_gen_to_ref = 'valid' THEN 'pass' ELSE 'unresolved' END AS reliability,
    CASE WHEN 'invalid' IN (pre_gen_to_ref, post_ref_to_gen) THEN 'fail' WHEN pre_gen_to_ref = 'valid' AND post_ref_to_gen = 'valid' THEN 'pass' ELSE 'unresolved' END AS completeness
  FROM samples s LEFT JOIN outcomes o ON s.sample_id = o.sample_id WHERE s.stage = 'accepted'),
p AS (SELECT *, CASE WHEN failed > 0 THEN 'failed' WHEN passed > 0 AND unresolved = 0 THEN 'passed' WHEN unresolved > 0 THEN 'unresolved' ELSE 'unavailable' END AS io_state FROM prof)
"""


@query(
    "WITH "
    + PROFILE_SQL
    + """
SELECT CASE WHEN grouping(workflow) = 1 THEN 'ALL' ELSE workflow END AS workflow, CASE WHEN grouping(workflow) = 1 THEN 'ALL' ELSE model END AS model, CASE WHEN grouping(workflow) = 1 THEN 'ALL' ELSE shot END AS shot,
  count(*) AS accepted, count(*) FILTER (io_state = 'passed') AS io_passed, count(*) FILTER (io_state = 'failed') AS io_failed, count(*) FILTER (io_state = 'unresolved') AS io_unresolved, count(*) FILTER (io_state = 'unavailable') AS io_unavailable,
  CAST(count(*) FILTER (io_state = 'passed') AS DOUBLE) / count(*) AS io_pass_rate,
  count(*) FILTER (io_state = 'passed' AND equivalence = 'pass') AS proved_given_pass, count(*) FILTER (io_state = 'passed' AND equivalence = 'fail') AS rejected_given_pass,
  CASE WHEN count(*) FILTER (io_state = 'passed') > 0 THEN CAST(count(*) FILTER (io_state = 'passed' AND equivalence = 'pass') AS DOUBLE) / count(*) FILTER (io_state = 'passed') END AS proved_rate
FROM p GROUP BY GROUPING SETS ((workflow, model, shot), ())"""
)
def conditional_rates(spark, d):
    """A6, A8, P13, P40: outcome rates among accepted samples by configuration, with the grand total."""
    io, eq = F.col("io_state"), F.col("equivalence")
    passed = io == "passed"
    aggs = [
        F.count(F.lit(1)).alias("accepted"),
        *[S.long_if(io == s).alias(f"io_{s}") for s in ("passed", "failed", "unresolved", "unavailable")],
        S.ratio(S.long_if(passed), F.count(F.lit(1))).alias("io_pass_rate"),
        S.long_if(passed & (eq == "pass")).alias("proved_given_pass"),
        S.long_if(passed & (eq == "fail")).alias("rejected_given_pass"),
        S.ratio(S.long_if(passed & (eq == "pass")), S.long_if(passed)).alias("proved_rate"),
    ]
    return A.with_grand_total(profiles(spark, d), ["workflow", "model", "shot"], aggs)


@query("SELECT count(*) AS n, count(DISTINCT task_id) AS n_task_id, count(DISTINCT workflow) AS n_workflow FROM samples WHERE eligible")
def a01_population(spark, d):
    return A.population(view(spark, d, "samples").where("eligible"), "task_id", "workflow")


@query("SELECT stage, eligible, count(*) AS n FROM samples GROUP BY stage, eligible")
def a02_histogram(spark, d):
    return A.histogram(view(spark, d, "samples"), "stage", "eligible")


@query("SELECT workflow, count(*) FILTER (stage = 'accepted') AS accepted, count(*) FILTER (quality > 50) AS good, count(*) FILTER (eligible AND stage = 'proof_failed') AS failed FROM samples GROUP BY workflow")
def a03_conditional_counts(spark, d):
    s = view(spark, d, "samples")
    return s.groupBy("workflow").agg(S.long_if(F.col("stage") == "accepted").alias("accepted"), S.long_if(F.col("quality") > 50).alias("good"), S.long_if(F.col("eligible") & (F.col("stage") == "proof_failed")).alias("failed"))


A04_ORACLE = """
WITH l AS (SELECT workflow, model, shot, stage, eligible, 'quality' AS metric, CASE WHEN eligible THEN quality END AS v FROM samples UNION ALL SELECT workflow, model, shot, stage, eligible, 'redundancy', CASE WHEN eligible THEN redundancy END FROM samples)
SELECT workflow, model, shot, metric, count(v) AS n, count(*) AS total, count(*) FILTER (eligible) AS eligible, count(*) FILTER (eligible AND v IS NULL) AS missing,
  CAST(sum(v) AS DOUBLE) / nullif(count(v), 0) AS mean, count(*) - count(*) FILTER (eligible) AS excluded, CAST(count(v) AS DOUBLE) / nullif(count(*) FILTER (eligible), 0) AS coverage
FROM l GROUP BY workflow, model, shot, metric"""


def long_metrics(spark, d):
    s = view(spark, d, "samples")
    known = lambda c: F.when(F.col("eligible"), F.col(c)).alias(c)
    ids = ["workflow", "model", "shot", "stage", "eligible", "task_id"]
    return A.unpivot(s.select(*ids, known("quality"), known("redundancy")), ids, ["quality", "redundancy"], "metric", "v")


@query(A04_ORACLE)
def a04_mean_coverage(spark, d):
    return A.mean_coverage(long_metrics(spark, d), ["workflow", "model", "shot", "metric"], "v", F.col("eligible"))


@query("""
WITH l AS (SELECT workflow, stage, count(quality) AS n, count(*) AS total FROM samples WHERE NOT (workflow = '1' AND stage = 'accepted') GROUP BY workflow, stage),
w AS (SELECT DISTINCT workflow FROM samples), s AS (SELECT DISTINCT stage FROM samples)
SELECT w.workflow, s.stage, coalesce(n, 0) AS n, coalesce(total, 0) AS total FROM w CROSS JOIN s LEFT JOIN l ON l.workflow = w.workflow AND l.stage = s.stage""")
def a05_dense_grid(spark, d):
    s = view(spark, d, "samples")
    agg = s.where("NOT (workflow = '1' AND stage = 'accepted')").groupBy("workflow", "stage").agg(F.count("quality").alias("n"), F.count(F.lit(1)).alias("total"))
    return A.densify(agg, [s.select("workflow").distinct(), s.select("stage").distinct()], ["workflow", "stage"], ["n", "total"])


@query("WITH " + PROFILE_SQL + """
SELECT scope, workflow, count(*) AS n, count(*) FILTER (io_state = 'passed') AS passed FROM (SELECT 'all' AS scope, * FROM p UNION ALL SELECT 'three_kinds', * FROM p WHERE kinds = 3) GROUP BY scope, workflow""")
def a07_scopes(spark, d):
    x = A.scoped(profiles(spark, d), {"all": F.lit(True), "three_kinds": F.col("kinds") == 3})
    return x.groupBy("scope", "workflow").agg(F.count(F.lit(1)).alias("n"), S.long_if(F.col("io_state") == "passed").alias("passed"))


@query("WITH " + PROFILE_SQL + "SELECT io_state, equivalence, count(*) AS n FROM p GROUP BY io_state, equivalence")
def a09_crosstab(spark, d):
    return A.histogram(profiles(spark, d), "io_state", "equivalence")


@query("""
WITH f AS (SELECT pre_ref_to_gen = 'invalid' AS a, post_gen_to_ref = 'invalid' AS b, pre_gen_to_ref = 'invalid' AS c, post_ref_to_gen = 'invalid' AS d FROM samples WHERE stage = 'accepted')
SELECT a, b, c, d, count(*) AS n, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS share FROM f WHERE a OR b OR c OR d GROUP BY a, b, c, d""")
def a10_combinations(spark, d):
    s = view(spark, d, "samples").where("stage = 'accepted'")
    f = s.select(*[(F.col(k) == "invalid").alias(n) for k, n in zip(DIRECTIONS, "abcd", strict=True)]).where("a OR b OR c OR d")
    return A.combination_shares(f, ["a", "b", "c", "d"])


MASK_SQL = "WITH " + PROFILE_SQL + """, c AS (SELECT sample_id, equivalence AS formal, CASE WHEN failed > 0 THEN 'fail' WHEN passed > 0 AND unresolved = 0 THEN 'pass' ELSE 'none' END AS io,
  CASE WHEN 'unfavorable' IN (pre_false, post_true) THEN 'fail' WHEN pre_false = 'favorable' AND post_true = 'favorable' THEN 'pass' ELSE 'unresolved' END AS triviality FROM p),
m AS (SELECT *, concat(CASE WHEN formal = 'fail' THEN '1' ELSE '0' END, CASE WHEN io = 'fail' THEN '1' ELSE '0' END, CASE WHEN triviality = 'fail' THEN '1' ELSE '0' END) AS flag_mask,
  formal IN ('pass', 'fail') AND io IN ('pass', 'fail') AND triviality IN ('pass', 'fail') AS complete FROM c)
"""


def checks(spark, d):
    """Three checks of accepted samples, the mask of those that failed, and whether all are decided (P16)."""
    c = profiles(spark, d).select("sample_id", F.col("equivalence").alias("formal"), S.io_state("passed", "failed", "unresolved").alias("io"), S.triviality_state("pre_false", "post_true").alias("triviality"))
    known = lambda k: F.col(k).isin("pass", "fail")
    return c.withColumn("flag_mask", S.mask("formal", "io", "triviality")).withColumn("complete", known("formal") & known("io") & known("triviality"))


@query(MASK_SQL + """, o AS (SELECT * FROM (VALUES ('000'), ('001'), ('010'), ('011'), ('100'), ('101'), ('110'), ('111')) v(flag_mask))
SELECT o.flag_mask, count(m.sample_id) AS n, count(m.sample_id) FILTER (NOT m.complete) AS incomplete FROM o LEFT JOIN m ON m.flag_mask = o.flag_mask GROUP BY o.flag_mask""")
def a11_regions(spark, d):
    agg = checks(spark, d).groupBy("flag_mask").agg(F.count(F.lit(1)).alias("n"), S.long_if(~F.col("complete")).alias("incomplete"))
    order = spark.range(8).select(F.lpad(F.bin("id"), 3, "0").alias("flag_mask"))
    return A.densify(agg, [order], ["flag_mask"], ["n", "incomplete"])


@query(MASK_SQL + "SELECT count(*) FILTER (formal = 'fail') AS formal, count(*) FILTER (io = 'fail') AS io, count(*) FILTER (triviality = 'fail') AS triviality FROM m")
def a12_marginals(spark, d):
    return checks(spark, d).agg(*[S.long_if(F.col(k) == "fail").alias(k) for k in ("formal", "io", "triviality")])


SIGNAL_SQL = """
WITH a AS (SELECT *, post_true = 'unfavorable' AND post_gen_to_ref = 'valid' AS s1, pre_false = 'unfavorable' AS s2, post_gen_to_ref = 'valid' AND post_ref_to_gen = 'invalid' AS s3, pre_gen_to_ref = 'valid' AND pre_ref_to_gen = 'invalid' AS s4 FROM samples WHERE stage = 'accepted'),
g AS (SELECT task_id, count(*) AS accepted, bool_or(s1) AS s1, bool_or(s2) AS s2, count(*) >= 6 AND CAST(count(*) FILTER (s3) AS DOUBLE) / count(*) >= 0.15 AND count(DISTINCT model) FILTER (s3) >= 3 AS s3,
  count(*) >= 6 AND CAST(count(*) FILTER (s4) AS DOUBLE) / count(*) >= 0.15 AND count(DISTINCT model) FILTER (s4) >= 3 AS s4, count(*) FILTER (s3) AS s3_samples, count(*) FILTER (s4) AS s4_samples FROM a GROUP BY task_id),
t AS (SELECT DISTINCT task_id FROM samples),
r AS (SELECT DISTINCT c_custkey % 60 AS task_id, CASE WHEN c_custkey % 60 % 3 = 0 THEN 'yes' WHEN c_custkey % 60 % 3 = 1 THEN 'no' END AS defect FROM customer WHERE c_custkey % 60 % 3 < 2),
screen AS (SELECT t.task_id, coalesce(accepted, 0) AS accepted, coalesce(s1, false) AS s1, coalesce(s2, false) AS s2, coalesce(s3, false) AS s3, coalesce(s4, false) AS s4, coalesce(s3_samples, 0) AS s3_samples, coalesce(s4_samples, 0) AS s4_samples, coalesce(defect, 'not_reviewed') AS defect
  FROM t LEFT JOIN g ON t.task_id = g.task_id LEFT JOIN r ON t.task_id = r.task_id)
"""


def screen(spark, d, least=6, share=0.15, models=3):
    """Screening signals per task (A13, A14) with review labels (J3); the share is 0.8 in production use."""
    s = view(spark, d, "samples")
    valid, invalid = (lambda k: F.col(k) == "valid"), (lambda k: F.col(k) == "invalid")
    rows = s.where("stage = 'accepted'").withColumns(
        {
            "s1": (F.col("post_true") == "unfavorable") & valid("post_gen_to_ref"),
            "s2": F.col("pre_false") == "unfavorable",
            "s3": valid("post_gen_to_ref") & invalid("post_ref_to_gen"),
            "s4": valid("pre_gen_to_ref") & invalid("pre_ref_to_gen"),
        }
    )
    n = F.count(F.lit(1))
    strong = lambda c: (n >= least) & (S.ratio(S.long_if(F.col(c)), n) >= share) & (F.countDistinct(F.when(F.col(c), F.col("model"))) >= models)
    per = rows.groupBy("task_id").agg(n.alias("accepted"), F.bool_or("s1").alias("s1"), F.bool_or("s2").alias("s2"), strong("s3").alias("s3"), strong("s4").alias("s4"), S.long_if(F.col("s3")).alias("s3_samples"), S.long_if(F.col("s4")).alias("s4_samples"))
    review = view(spark, d, "customer").select((F.col("c_custkey") % 60).alias("task_id")).distinct().withColumn("defect", F.when(F.col("task_id") % 3 == 0, "yes").when(F.col("task_id") % 3 == 1, "no")).where("defect IS NOT NULL")
    out = s.select("task_id").distinct().join(per, "task_id", "left").join(review, "task_id", "left")
    defaults = dict.fromkeys(("accepted", "s3_samples", "s4_samples"), 0) | dict.fromkeys(("s1", "s2", "s3", "s4"), False) | {"defect": "not_reviewed"}
    return out.fillna(defaults)


@query(SIGNAL_SQL + "SELECT * FROM screen")
def a13_a14_screening(spark, d):
    return screen(spark, d)


@query(SIGNAL_SQL + """, l AS (SELECT 's1' AS signal, s1 AS flagged, defect FROM screen UNION ALL SELECT 's2', s2, defect FROM screen UNION ALL SELECT 's3', s3, defect FROM screen UNION ALL SELECT 's4', s4, defect FROM screen UNION ALL SELECT 'selected', s1 OR s2 OR s3 OR s4, defect FROM screen)
SELECT signal, count(*) FILTER (flagged) AS n, count(*) FILTER (flagged AND defect = 'yes') AS yes, count(*) FILTER (flagged AND defect = 'no') AS no, count(*) FILTER (flagged AND defect = 'not_reviewed') AS not_reviewed FROM l GROUP BY signal""")
def a15_signal_rollup(spark, d):
    x = screen(spark, d).withColumn("selected", F.col("s1") | F.col("s2") | F.col("s3") | F.col("s4"))
    return A.signal_rollup(x, ["s1", "s2", "s3", "s4", "selected"], "defect", ["yes", "no", "not_reviewed"])


@query("""
WITH f AS (SELECT * FROM samples WHERE stage = 'accepted' AND 'invalid' IN (pre_ref_to_gen, post_gen_to_ref, pre_gen_to_ref, post_ref_to_gen)),
l AS (SELECT c.cohort, k.direction, CASE k.direction WHEN 'pre_ref_to_gen' THEN pre_ref_to_gen WHEN 'post_gen_to_ref' THEN post_gen_to_ref WHEN 'pre_gen_to_ref' THEN pre_gen_to_ref ELSE post_ref_to_gen END = 'invalid' AS bad
  FROM f, (VALUES ('all'), ('without_candidates')) c(cohort), (VALUES ('pre_ref_to_gen'), ('post_gen_to_ref'), ('pre_gen_to_ref'), ('post_ref_to_gen')) k(direction) WHERE c.cohort = 'all' OR f.task_id % 3 <> 0)
SELECT cohort, direction, count(*) FILTER (bad) AS samples, count(*) AS denominator, CAST(count(*) FILTER (bad) AS DOUBLE) / count(*) AS share FROM l GROUP BY cohort, direction""")
def a16_sensitivity(spark, d):
    s = view(spark, d, "samples").where(F.col("stage") == "accepted").where(S.combine(list(DIRECTIONS), "valid", "invalid") == "unfavorable")
    x = A.scoped(s, {"all": F.lit(True), "without_candidates": F.col("task_id") % 3 != 0})
    long = A.unpivot(x.select("scope", *DIRECTIONS), ["scope"], list(DIRECTIONS), "direction", "v")
    out = long.groupBy(F.col("scope").alias("cohort"), "direction").agg(S.long_if(F.col("v") == "invalid").alias("samples"), F.count(F.lit(1)).alias("denominator"))
    return out.withColumn("share", S.ratio("samples", "denominator"))


@query("""
WITH s AS (SELECT candidate_id, base_id, operator, CASE points % 4 WHEN 0 THEN 'behavior_detected' WHEN 1 THEN 'diagnostic_only' WHEN 2 THEN 'missed' ELSE 'unresolved' END AS positive, CASE points % 3 WHEN 0 THEN 'behavior_detected' WHEN 1 THEN 'missed' ELSE 'unresolved' END AS negative, CASE points % 5 WHEN 0 THEN 'diagnostic_only' ELSE 'missed' END AS invalid FROM candidates WHERE status = 'confirmed' OR operator <> 'signup'),
u AS (SELECT *, CASE WHEN 'behavior_detected' IN (positive, negative, invalid) THEN 'behavior_detected' WHEN 'diagnostic_only' IN (positive, negative, invalid) THEN 'diagnostic_only' WHEN positive = 'missed' AND negative = 'missed' AND invalid = 'missed' THEN 'missed' ELSE 'unresolved' END AS "union" FROM s),
l AS (SELECT operator, base_id, 'positive' AS category, positive AS state FROM u UNION ALL SELECT operator, base_id, 'negative', negative FROM u UNION ALL SELECT operator, base_id, 'invalid', invalid FROM u UNION ALL SELECT operator, base_id, 'union', "union" FROM u),
g AS (SELECT * FROM (SELECT DISTINCT operator FROM candidates) o, (VALUES ('positive'), ('negative'), ('invalid'), ('union')) c(category))
SELECT g.operator, g.category, count(l.state) AS n, count(DISTINCT l.base_id) AS tasks, count(*) FILTER (state = 'behavior_detected') AS behavior_detected, count(*) FILTER (state = 'diagnostic_only') AS diagnostic_only, count(*) FILTER (state = 'missed') AS missed, count(*) FILTER (state = 'unresolved') AS unresolved,
  CAST(count(*) FILTER (state = 'behavior_detected') AS DOUBLE) / nullif(count(l.state), 0) AS detected_rate
FROM g LEFT JOIN l ON g.operator = l.operator AND g.category = l.category GROUP BY g.operator, g.category""")
def a17_detection_matrix(spark, d):
    c = view(spark, d, "candidates")
    pick = lambda m, *names: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("points") % m + 1).cast("int"))
    s = c.where((F.col("status") == "confirmed") | (F.col("operator") != "signup")).select("operator", "base_id", pick(4, "behavior_detected", "diagnostic_only", "missed", "unresolved").alias("positive"), pick(3, "behavior_detected", "missed", "unresolved").alias("negative"), pick(5, "diagnostic_only", *["missed"] * 4).alias("invalid"))
    s = s.withColumn("union", S.union_state("positive", "negative", "invalid"))
    names = ["positive", "negative", "invalid", "union"]
    long = A.unpivot(s, ["operator", "base_id"], names, "category", "state")
    states = ("behavior_detected", "diagnostic_only", "missed", "unresolved")
    agg = long.groupBy("operator", "category").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("base_id").alias("tasks"), *[S.long_if(F.col("state") == v).alias(v) for v in states])
    grid = A.densify(agg, [c.select("operator").distinct(), spark.createDataFrame([(n,) for n in names], "category string")], ["operator", "category"], ["n", "tasks", *states])
    return grid.withColumn("detected_rate", S.ratio("behavior_detected", "n"))


@query("""
SELECT operator, count(*) AS selected, count(DISTINCT base_id) AS applicable, count(*) FILTER (pos <= 3) AS budgeted, count(*) FILTER (pos <= 3 AND status <> 'error') AS attempted, count(DISTINCT CASE WHEN pos <= 3 AND status = 'confirmed' THEN base_id END) AS retained,
  count(*) FILTER (pos <= 3 AND status = 'confirmed') AS confirmed, count(*) FILTER (pos <= 3 AND status = 'rejected') AS rejected, count(*) FILTER (pos <= 3 AND status = 'unresolved') AS unresolved FROM candidates GROUP BY operator""")
def a18_funnel(spark, d):
    c = view(spark, d, "candidates")
    tried, st = F.col("pos") <= 3, F.col("status")
    return c.groupBy("operator").agg(F.count(F.lit(1)).alias("selected"), F.countDistinct("base_id").alias("applicable"), S.long_if(tried).alias("budgeted"), S.long_if(tried & (st != "error")).alias("attempted"), F.countDistinct(F.when(tried & (st == "confirmed"), F.col("base_id"))).alias("retained"), *[S.long_if(tried & (st == v)).alias(v) for v in ("confirmed", "rejected", "unresolved")])


@query("""
WITH s AS (SELECT workflow, quality, row_number() OVER (PARTITION BY workflow ORDER BY quality) - 1 AS i, count(*) OVER (PARTITION BY workflow) AS n FROM samples WHERE quality IS NOT NULL)
SELECT workflow, count(*) AS scored, round(avg(quality), 4) AS mean, round(median(quality), 4) AS median, round(coalesce(stddev_samp(quality), 0), 4) AS stdev, CAST(min(quality) AS BIGINT) AS min, CAST(max(quality) AS BIGINT) AS max, CAST(max(quality) FILTER (i = n // 4) AS BIGINT) AS q25, CAST(max(quality) FILTER (i = 3 * n // 4) AS BIGINT) AS q75 FROM s GROUP BY workflow""")
def a19_summary_statistics(spark, d):
    return A.summary_statistics(view(spark, d, "samples"), ["workflow"], "quality")


@query("""
WITH i AS (SELECT workflow, coalesce(CAST(quality AS DOUBLE) / 100, 0.0) AS hi, coalesce(CAST(redundancy AS DOUBLE) / 100, 1.0) AS lo FROM samples)
SELECT workflow, round(avg(hi), 6) AS mean_high, round(avg(lo), 6) AS mean_low, median(hi) AS median_high, median(lo) AS median_low FROM i GROUP BY workflow""")
def a20_imputed_means(spark, d):
    i = view(spark, d, "samples").select("workflow", S.imputed(F.col("quality") / 100, F.lit(False), F.lit(False)).alias("hi"), S.imputed(F.col("redundancy") / 100, F.lit(True), F.lit(False)).alias("lo"))
    return i.groupBy("workflow").agg(F.round(F.avg("hi"), 6).alias("mean_high"), F.round(F.avg("lo"), 6).alias("mean_low"), F.median("hi").alias("median_high"), F.median("lo").alias("median_low"))


@query("""
WITH f AS (SELECT c.sample_id, s.workflow, count(*) FILTER (state <> 'unresolved') AS det, count(*) AS tot, CAST(count(*) FILTER (state = 'passed') AS DOUBLE) / count(*) AS score FROM cases c JOIN samples s ON c.sample_id = s.sample_id GROUP BY c.sample_id, s.workflow)
SELECT workflow, CAST(sum(det) AS DOUBLE) / sum(tot) AS coverage, round(avg(score), 6) AS mean_score, count(*) AS files FROM f GROUP BY workflow""")
def a21_ratio_of_sums(spark, d):
    c = view(spark, d, "cases").join(view(spark, d, "samples").select("sample_id", "workflow"), "sample_id")
    f = c.groupBy("sample_id", "workflow").agg(S.long_if(F.col("state") != "unresolved").alias("det"), S.long_if(F.col("state") == "passed").alias("ok"), F.count(F.lit(1)).alias("tot"))
    return f.groupBy("workflow").agg(S.ratio(F.sum("det"), F.sum("tot")).alias("coverage"), F.round(F.avg(S.conservative("ok", "tot")), 6).alias("mean_score"), F.count(F.lit(1)).alias("files"))


CLAUSES_SQL = "SELECT sample_id, case_no AS function_no, CASE state WHEN 'passed' THEN true WHEN 'failed' THEN false END AS holds, CASE WHEN oracle_id % 3 = 0 THEN NULL ELSE oracle_id % 2 = 0 END AS backward, CASE WHEN amount % 13 = 0 THEN 'error' ELSE 'ok' END AS status, kind, amount FROM cases"


def clauses(spark, d):
    c = view(spark, d, "cases")
    holds = F.when(F.col("state") == "passed", True).when(F.col("state") == "failed", False)
    return c.select("sample_id", F.col("case_no").alias("function_no"), holds.alias("holds"), F.when(F.col("oracle_id") % 3 != 0, F.col("oracle_id") % 2 == 0).alias("backward"), F.when(F.col("amount") % 13 == 0, "error").otherwise("ok").alias("status"), "kind", "amount")


@query(f"""
WITH cl AS ({CLAUSES_SQL})
SELECT sample_id, count(*) FILTER (holds) AS passed, count(*) FILTER (NOT holds) AS failed, count(*) FILTER (holds IS NULL) AS unknown, count(*) AS total, CAST(count(*) FILTER (holds) AS DOUBLE) / nullif(count(holds), 0) AS score, CAST(count(holds) AS DOUBLE) / count(*) AS coverage,
  CASE WHEN count(holds) = 0 THEN 'not_available' WHEN count(*) > count(holds) THEN 'partial' ELSE 'ok' END AS status FROM cl GROUP BY sample_id""")
def a22_clause_rollup(spark, d):
    return A.implication_rollup(clauses(spark, d), ["sample_id"])


@query(f"""
WITH cl AS ({CLAUSES_SQL}), f AS (SELECT sample_id, function_no, CASE WHEN bool_or(holds IS FALSE) THEN false WHEN bool_or(holds IS NULL) THEN NULL ELSE true END AS at_least FROM cl GROUP BY sample_id, function_no)
SELECT sample_id, count(*) FILTER (at_least) AS passed, count(at_least) AS determined, count(*) AS total, CAST(count(*) FILTER (at_least) AS DOUBLE) / nullif(count(at_least), 0) AS score FROM f GROUP BY sample_id""")
def a23_function_proportion(spark, d):
    f = clauses(spark, d).groupBy("sample_id", "function_no").agg(S.all_true(F.col("holds")).alias("at_least"))
    out = f.groupBy("sample_id").agg(S.long_if(F.col("at_least")).alias("passed"), F.count("at_least").alias("determined"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("score", S.ratio("passed", "determined"))


@query(f"""
WITH cl AS ({CLAUSES_SQL})
SELECT sample_id, count(*) AS functions, CASE WHEN bool_and(holds IS TRUE) AND bool_and(backward IS TRUE) THEN 'equivalent' WHEN bool_and(holds IS TRUE) THEN 'generated_stronger_or_equal' WHEN bool_and(backward IS TRUE) THEN 'generated_weaker_or_equal' WHEN bool_or(status <> 'ok') THEN 'unknown' ELSE 'incomparable' END AS classification FROM cl GROUP BY sample_id""")
def a24_strength(spark, d):
    return A.strength(clauses(spark, d).withColumnRenamed("holds", "forward"), "sample_id")


@query("""
SELECT sample_id, kind, count(*) FILTER (state = 'passed') AS passed, count(*) FILTER (state = 'failed') AS failed, count(*) AS total, count(*) FILTER (state = 'unresolved') AS unknown, CAST(count(*) FILTER (state = 'passed') AS DOUBLE) / count(*) AS score,
  CAST(count(*) FILTER (state = 'passed') AS DOUBLE) / nullif(count(*) FILTER (state <> 'unresolved'), 0) AS decidable_score, CAST(count(*) FILTER (state <> 'unresolved') AS DOUBLE) / count(*) AS coverage FROM cases GROUP BY sample_id, kind""")
def a25_case_scores(spark, d):
    return A.case_scores(view(spark, d, "cases"), ["sample_id", "kind"])


@query("""
WITH n AS (SELECT oracle_id, kind, reason, count(*) AS n FROM cases WHERE reason IS NOT NULL GROUP BY oracle_id, kind, reason)
SELECT oracle_id, kind, string_agg(reason || '=' || n, ',' ORDER BY reason || '=' || n) AS histogram FROM n GROUP BY oracle_id, kind""")
def a25_unknown_reasons(spark, d):
    return A.histogram_text(view(spark, d, "cases"), ["oracle_id", "kind"], "reason")


MUTANT_SQL = "SELECT base_id, operator, CASE status WHEN 'confirmed' THEN 'killed' WHEN 'rejected' THEN 'survived' WHEN 'unresolved' THEN 'unknown' ELSE 'invalid_mutant' END AS outcome FROM candidates"


def mutants(spark, d):
    names = {"confirmed": "killed", "rejected": "survived", "unresolved": "unknown", "error": "invalid_mutant"}
    return view(spark, d, "candidates").select("base_id", "operator", F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("status")).alias("outcome"))


@query(f"""
WITH m AS ({MUTANT_SQL}), g AS (SELECT base_id, count(*) FILTER (outcome = 'killed') AS killed, count(*) FILTER (outcome = 'survived') AS survived, count(*) FILTER (outcome = 'unknown') AS unknown, count(*) FILTER (outcome = 'invalid_mutant') AS invalid_mutant FROM m GROUP BY base_id)
SELECT *, CAST(killed AS DOUBLE) / nullif(killed + survived + unknown, 0) AS score, CASE WHEN killed + survived + unknown = 0 THEN 'not_available' WHEN unknown > 0 THEN 'partial' ELSE 'ok' END AS status FROM g""")
def a26_kill_rate(spark, d):
    return A.kill_rate(mutants(spark, d), ["base_id"])


@query(f"""
WITH m AS ({MUTANT_SQL}), g AS (SELECT b.base_id, o.operator FROM (SELECT DISTINCT base_id FROM m) b, (SELECT DISTINCT operator FROM m) o)
SELECT g.base_id, g.operator, count(*) FILTER (outcome = 'killed') AS killed, count(*) FILTER (outcome = 'survived') AS survived, count(*) FILTER (outcome = 'unknown') AS unknown FROM g LEFT JOIN m ON g.base_id = m.base_id AND g.operator = m.operator GROUP BY g.base_id, g.operator""")
def a27_family_counts(spark, d):
    m = mutants(spark, d)
    agg = A.tri_counts(m, ["base_id", "operator"], "outcome", {k: k for k in ("killed", "survived", "unknown")}).drop("total")
    return A.densify(agg, [m.select("base_id").distinct(), m.select("operator").distinct()], ["base_id", "operator"], ["killed", "survived", "unknown"])


@query("""
WITH i AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), t AS (SELECT doc_id, trim(regexp_replace(line, '[ \\t\\r\\f\\x0B]+', ' ', 'g'), ' ') AS line FROM i), g AS (SELECT doc_id, line, count(*) AS n FROM t WHERE line <> '' GROUP BY doc_id, line)
SELECT doc_id, CAST(sum(n - 1) AS BIGINT) AS extra, CAST(sum(n) AS BIGINT) AS total, CAST(sum(n - 1) AS DOUBLE) / sum(n) AS rate FROM g GROUP BY doc_id""")
def a28_duplicate_lines(spark, d):
    lines = view(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.select("doc_id", F.trim(F.regexp_replace("line", r"[ \t\r\f\x0B]+", " ")).alias("line")).where("line <> ''")
    return A.duplicate_rate(lines, "doc_id", "line")


@query("SELECT oracle_id, count(*) FILTER (amount < 5 OR reason = 'timeout') AS flagged, count(*) AS total, CAST(count(*) FILTER (amount < 5 OR reason = 'timeout') AS DOUBLE) / count(*) AS rate FROM cases GROUP BY oracle_id")
def a29_flagged_rate(spark, d):
    return A.flagged_rate(view(spark, d, "cases"), "oracle_id", (F.col("amount") < 5) | (F.col("reason") == "timeout"))


@query(f"""
WITH p AS (SELECT sample_id, NOT holds AS always_false FROM ({CLAUSES_SQL}) c)
SELECT sample_id, count(*) FILTER (always_false) AS flagged, count(always_false) AS checked, count(*) AS total, CAST(count(*) FILTER (always_false) AS DOUBLE) / nullif(count(always_false), 0) AS rate, CASE WHEN count(always_false) = 0 THEN 'not_available' WHEN count(always_false) < count(*) THEN 'partial' ELSE 'ok' END AS status FROM p GROUP BY sample_id""")
def a30_probe_rate(spark, d):
    return A.probe_rate(clauses(spark, d).select("sample_id", (~F.col("holds")).alias("always_false")), "sample_id")


@query("""
WITH c AS (SELECT sample_id, amount AS nodes, case_no AS depth, state <> 'unresolved' AS ok, [kind, state] AS operators FROM cases), o AS (SELECT sample_id, string_agg(DISTINCT op, ' ' ORDER BY op) AS operators FROM (SELECT sample_id, unnest(operators) AS op FROM c) GROUP BY sample_id)
SELECT c.sample_id, CAST(coalesce(sum(nodes) FILTER (ok), 0) AS BIGINT) AS nodes, CAST(coalesce(max(depth) FILTER (ok), 0) AS BIGINT) AS depth, any_value(o.operators) AS operators, CAST(count(*) FILTER (ok) AS DOUBLE) / count(*) AS coverage FROM c JOIN o ON c.sample_id = o.sample_id GROUP BY c.sample_id""")
def a31_structure_rollup(spark, d):
    c = view(spark, d, "cases").select("sample_id", F.col("amount").alias("nodes"), F.col("case_no").alias("depth"), (F.col("state") != "unresolved").alias("ok"), F.array("kind", "state").alias("operators"))
    return A.structure_rollup(c, "sample_id")


@query("SELECT sample_id, count(*) FILTER (kind = 'io_correct') AS io_correct, count(*) FILTER (kind = 'io_wrong') AS io_wrong, count(*) FILTER (kind = 'io_invalid') AS io_invalid, count(*) AS total FROM cases GROUP BY sample_id")
def a32_kind_counts(spark, d):
    return A.pivot_counts(view(spark, d, "cases"), "sample_id", "kind", list(KINDS))


@query("""
WITH p AS (SELECT sample_id, quality < 50 AS weak, redundancy > 30 AS redundant, post_true = 'unfavorable' AS vacuous FROM samples WHERE stage = 'accepted'),
l AS (SELECT 'weak' AS deficit, sample_id FROM p WHERE weak UNION ALL SELECT 'redundant', sample_id FROM p WHERE redundant UNION ALL SELECT 'vacuous', sample_id FROM p WHERE vacuous),
r AS (SELECT *, row_number() OVER (PARTITION BY deficit ORDER BY sample_id) AS r FROM l)
SELECT deficit, count(*) AS n, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM p), 4) AS rate, string_agg(CAST(sample_id AS VARCHAR), ',' ORDER BY sample_id) FILTER (r <= 20) AS files FROM r GROUP BY deficit""")
def a33_deficits(spark, d):
    s = view(spark, d, "samples").where("stage = 'accepted'")
    return A.deficits(s, "sample_id", {"weak": F.col("quality") < 50, "redundant": F.col("redundancy") > 30, "vacuous": F.col("post_true") == "unfavorable"})


@query("""
WITH r AS (SELECT sample_id, task_id, quality % 3 AS a1, redundancy % 4 AS a2, quality % 3 AS b1, quality % 4 AS b2 FROM samples WHERE quality IS NOT NULL AND redundancy IS NOT NULL)
SELECT task_id, count(*) AS reviews, count(*) FILTER (a1 = b1 AND a2 = b2) AS agreed, count(*) FILTER (NOT (a1 = b1 AND a2 = b2)) AS adjudicated FROM r GROUP BY task_id""")
def a34_reviewer_agreement(spark, d):
    r = view(spark, d, "samples").where("quality IS NOT NULL AND redundancy IS NOT NULL")
    agree = F.struct((F.col("quality") % 3).alias("x"), (F.col("redundancy") % 4).alias("y")) == F.struct((F.col("quality") % 3).alias("x"), (F.col("quality") % 4).alias("y"))
    return r.groupBy("task_id").agg(F.count(F.lit(1)).alias("reviews"), S.long_if(agree).alias("agreed"), S.long_if(~agree).alias("adjudicated"))


@query("""
WITH b AS (SELECT sample_id, task_id, pre_ref_to_gen = 'valid' AND post_gen_to_ref = 'valid' AND pre_gen_to_ref = 'valid' AND post_ref_to_gen = 'valid' AS before_ok, coalesce(quality, 0) > 40 AS after_ok FROM samples),
c AS (SELECT sample_id, bool_and(state = 'passed') AS cases_ok FROM cases GROUP BY sample_id)
SELECT task_id, count(*) FILTER (before_ok) AS before, count(*) FILTER (after_ok) AS after, count(*) FILTER (after_ok AND coalesce(cases_ok, false)) AS repaired FROM b LEFT JOIN c ON b.sample_id = c.sample_id GROUP BY task_id""")
def a35_repair_rollup(spark, d):
    s = view(spark, d, "samples")
    ok = view(spark, d, "cases").groupBy("sample_id").agg(F.bool_and(F.col("state") == "passed").alias("cases_ok"))
    before = F.forall(F.array(*DIRECTIONS), lambda x: x == "valid")
    after = F.coalesce("quality", F.lit(0)) > 40
    x = s.join(ok, "sample_id", "left")
    return x.groupBy("task_id").agg(S.long_if(before).alias("before"), S.long_if(after).alias("after"), S.long_if(after & F.coalesce("cases_ok", F.lit(False))).alias("repaired"))


@query("SELECT operator, count(*) AS runs, count(*) FILTER (status = 'confirmed') AS done, round(100.0 * count(*) FILTER (status = 'confirmed') / count(*), 4) AS percent, CAST(sum(points) AS BIGINT) AS tokens FROM candidates GROUP BY operator")
def a36_batch_summary(spark, d):
    c = view(spark, d, "candidates")
    done = S.long_if(F.col("status") == "confirmed")
    return c.groupBy("operator").agg(F.count(F.lit(1)).alias("runs"), done.alias("done"), F.round(100.0 * done / F.count(F.lit(1)), 4).alias("percent"), F.sum("points").alias("tokens"))


@query("SELECT workflow, shot, min(quality) AS low, max(quality) AS high FROM samples GROUP BY workflow, shot")
def a37_min_max(spark, d):
    return view(spark, d, "samples").groupBy("workflow", "shot").agg(F.min("quality").alias("low"), F.max("quality").alias("high"))


@query("""
WITH f AS (SELECT sample_id, kind, part_id % 5 AS expected, amount % 7 AS other, min(case_no) AS p FROM cases WHERE part_id % 5 <> amount % 7 GROUP BY ALL),
l AS (SELECT sample_id, kind, expected, string_agg(CAST(other AS VARCHAR), ',' ORDER BY p, other) AS unexpected FROM f GROUP BY ALL), o AS (SELECT sample_id, kind, part_id % 5 AS expected, min(case_no) AS first_pos FROM cases GROUP BY ALL)
SELECT o.sample_id, o.kind, o.expected, o.first_pos, coalesce(l.unexpected, '') AS unexpected FROM o LEFT JOIN l ON o.sample_id = l.sample_id AND o.kind = l.kind AND o.expected = l.expected""")
def a38_merged_cases(spark, d):
    c = view(spark, d, "cases").select("sample_id", "kind", (F.col("part_id") % 5).alias("expected"), (F.col("amount") % 7).alias("other"), "case_no")
    return A.merged_cases(c, ["sample_id", "kind"], "expected", "other", "case_no").withColumnRenamed("first_pos", "first_pos")


@query("SELECT sample_id, count(*) FILTER (kind = 'io_invalid') AS invalid, count(*) FILTER (kind <> 'io_invalid') AS positive, CAST(coalesce(sum(amount % 4) FILTER (kind <> 'io_invalid'), 0) AS BIGINT) AS negative FROM cases GROUP BY sample_id")
def a39_case_types(spark, d):
    """Invalid cases carry a mark instead of an expected value; negatives are the sizes of the lists of wrong outputs."""
    c = view(spark, d, "cases").withColumn("wrong", F.when(F.col("kind") != "io_invalid", F.array_repeat(F.lit("x"), (F.col("amount") % 4).cast("int"))))
    inv = F.col("kind") == "io_invalid"
    return c.groupBy("sample_id").agg(S.long_if(inv).alias("invalid"), S.long_if(~inv).alias("positive"), F.coalesce(F.sum(F.size("wrong").cast("long")), F.lit(0).cast("long")).alias("negative"))

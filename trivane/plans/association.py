"""Queries for rank association, bootstrap, contrasts and resampling (ST1-ST12, ST29, M10, M11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trivane.functions import states as S
from trivane.operators import statistics as T
from trivane.plans.registry import query
from trivane.plans.relations import PAIRS_SQL, shot_pairs
from trivane.views import view

REPLICATES = 50

COUNTS_SQL = """
a AS (SELECT workflow, quality AS v, count(*) FILTER (stage = 'accepted') AS a, count(*) FILTER (stage <> 'accepted') AS b FROM samples WHERE quality IS NOT NULL GROUP BY ALL),
s AS (SELECT *, coalesce(sum(b) OVER (PARTITION BY workflow ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM a),
c AS (SELECT workflow, CAST(sum(a) AS BIGINT) AS n_acc, CAST(sum(b) AS BIGINT) AS n_other, CAST(sum(a * below) AS BIGINT) AS concordant, CAST(sum(a) * sum(b) - sum(a * below) - sum(a * b) AS BIGINT) AS discordant,
  CAST((sum(a) * (sum(a) - 1) + sum(b) * (sum(b) - 1) - sum(a * (a - 1)) - sum(b * (b - 1))) // 2 AS BIGINT) AS t_acc, CAST(sum(a * b) AS BIGINT) AS t_met FROM s GROUP BY workflow)
"""
TAU_SQL = "CASE WHEN sqrt(CAST(concordant + discordant + t_acc AS DOUBLE) * CAST(concordant + discordant + t_met AS DOUBLE)) > 0 THEN CAST(concordant - discordant AS DOUBLE) / sqrt(CAST(concordant + discordant + t_acc AS DOUBLE) * CAST(concordant + discordant + t_met AS DOUBLE)) END"


def acc():
    return F.col("stage") == "accepted"


def counts(spark, d):
    return T.pair_counts(T.by_value(view(spark, d, "samples"), ["workflow"], "quality", acc()), ["workflow"], "quality")


@query(f"WITH {COUNTS_SQL} SELECT * FROM c")
def st01_pair_counts(spark, d):
    return counts(spark, d)


@query(f"WITH {COUNTS_SQL} SELECT workflow, round({TAU_SQL}, 9) AS tau FROM c")
def st02_tau_b(spark, d):
    return counts(spark, d).select("workflow", F.round(T.tau_b(), 9).alias("tau"))


@query(f"WITH {COUNTS_SQL} SELECT workflow, round({TAU_SQL}, 9) AS tau FROM c")
def st03_rank_tau(spark, d):
    """By midranks; the oracle counts pairs, so the two formulations check each other."""
    return T.rank_tau(view(spark, d, "samples"), ["workflow"], "quality", acc()).withColumn("tau", F.round("tau", 9))


@query("""
WITH t AS (SELECT workflow, count(*) FILTER (stage = 'accepted' AND pre_false = 'unfavorable') AS n11, count(*) FILTER (stage = 'accepted' AND pre_false <> 'unfavorable') AS n10, count(*) FILTER (stage <> 'accepted' AND pre_false = 'unfavorable') AS n01, count(*) FILTER (stage <> 'accepted' AND pre_false <> 'unfavorable') AS n00 FROM samples GROUP BY workflow)
SELECT workflow, n11, n10, n01, n00, round((CAST(n11 AS DOUBLE) * n00 - CAST(n10 AS DOUBLE) * n01) / nullif(sqrt(CAST(n11 + n10 AS DOUBLE) * (n01 + n00) * (n11 + n01) * (n10 + n00)), 0), 9) AS phi FROM t""")
def st04_phi(spark, d):
    return T.phi(view(spark, d, "samples"), ["workflow"], acc(), F.col("pre_false") == "unfavorable").withColumn("phi", F.round("phi", 9))


@query(f"""
WITH r AS (SELECT workflow, quality, row_number() OVER (PARTITION BY workflow ORDER BY quality DESC) AS r, count(*) FILTER (stage = 'accepted') OVER (PARTITION BY workflow) AS n_acc FROM samples WHERE quality IS NOT NULL),
a AS (SELECT workflow, quality AS v, count(*) FILTER (r <= n_acc) AS a, count(*) FILTER (r > n_acc) AS b FROM r GROUP BY ALL), {COUNTS_SQL[COUNTS_SQL.index("s AS") :]}
SELECT workflow, round({TAU_SQL}, 9) AS max_tau FROM c""")
def st05_max_tau(spark, d):
    g = T.best_grouped(T.by_value(view(spark, d, "samples"), ["workflow"], "quality", acc()), ["workflow"], "quality")
    return T.pair_counts(g, ["workflow"], "quality").select("workflow", F.round(T.tau_b(), 9).alias("max_tau"))


WITHIN_SQL = """
p AS (SELECT x.task_id, count(*) FILTER (x.stage = 'accepted' AND y.stage <> 'accepted' AND x.quality > y.quality) + count(*) FILTER (y.stage = 'accepted' AND x.stage <> 'accepted' AND y.quality > x.quality) AS concordant,
  count(*) FILTER (x.stage = 'accepted' AND y.stage <> 'accepted' AND x.quality < y.quality) + count(*) FILTER (y.stage = 'accepted' AND x.stage <> 'accepted' AND y.quality < x.quality) AS discordant,
  count(*) FILTER ((x.stage = 'accepted') = (y.stage = 'accepted') AND x.quality <> y.quality) AS t_acc, count(*) FILTER ((x.stage = 'accepted') <> (y.stage = 'accepted') AND x.quality = y.quality) AS t_met
  FROM samples x JOIN samples y ON x.task_id = y.task_id AND x.sample_id < y.sample_id WHERE x.quality IS NOT NULL AND y.quality IS NOT NULL GROUP BY x.task_id)
"""


@query(f"WITH {WITHIN_SQL}, c AS (SELECT CAST(sum(concordant) AS BIGINT) AS concordant, CAST(sum(discordant) AS BIGINT) AS discordant, CAST(sum(t_acc) AS BIGINT) AS t_acc, CAST(sum(t_met) AS BIGINT) AS t_met FROM p) SELECT *, round({TAU_SQL}, 9) AS tau FROM c")
def st06_within_tau(spark, d):
    """The oracle compares all pairs of a cluster one by one."""
    return T.within(view(spark, d, "samples"), [], "task_id", "quality", acc()).withColumn("tau", F.round(T.tau_b(), 9))


DRAWS_SQL = f"""
k AS (SELECT task_id, row_number() OVER (ORDER BY task_id) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT task_id FROM samples)),
w AS (SELECT replicate, ('0x' || substr(md5('tau|' || replicate || '|' || k), 1, 8))::BIGINT % n AS d, count(*) AS w FROM k, range({REPLICATES}) r(replicate) GROUP BY ALL),
dr AS (SELECT w.replicate, k.task_id, w.w FROM w JOIN k ON w.d = k.k)
"""


def draws(spark, d):
    return T.portable_draws(view(spark, d, "samples").select("task_id"), "task_id", REPLICATES, "tau")


@query(f"""
WITH {DRAWS_SQL}, a AS (SELECT replicate AS workflow, quality AS v, sum(CASE WHEN stage = 'accepted' THEN w ELSE 0 END) AS a, sum(CASE WHEN stage = 'accepted' THEN 0 ELSE w END) AS b FROM samples JOIN dr ON samples.task_id = dr.task_id WHERE quality IS NOT NULL GROUP BY ALL), {COUNTS_SQL[COUNTS_SQL.index("s AS") :]}
SELECT workflow AS replicate, round({TAU_SQL}, 9) AS tau FROM c""")
def st07_bootstrap_pooled(spark, d):
    return T.bootstrap_pooled(view(spark, d, "samples"), draws(spark, d), "task_id", "quality", acc(), REPLICATES).withColumn("tau", F.round("tau", 9))


@query(f"WITH {WITHIN_SQL}, {DRAWS_SQL}, c AS (SELECT replicate, sum(concordant * w) AS concordant, sum(discordant * w) AS discordant, sum(t_acc * w) AS t_acc, sum(t_met * w) AS t_met FROM p JOIN dr ON p.task_id = dr.task_id GROUP BY replicate) SELECT replicate, round({TAU_SQL}, 9) AS tau FROM c")
def st08_bootstrap_within(spark, d):
    return T.bootstrap_within(view(spark, d, "samples"), draws(spark, d), "task_id", "quality", acc()).withColumn("tau", F.round("tau", 9))


@query(f"""
WITH {WITHIN_SQL}, {DRAWS_SQL}, c AS (SELECT replicate, sum(concordant * w) AS concordant, sum(discordant * w) AS discordant, sum(t_acc * w) AS t_acc, sum(t_met * w) AS t_met FROM p JOIN dr ON p.task_id = dr.task_id GROUP BY replicate), t AS (SELECT {TAU_SQL} AS tau FROM c)
SELECT count(tau) AS defined, CASE WHEN count(tau) >= ceil(0.95 * {REPLICATES}) THEN round(quantile_cont(tau, 0.025), 9) END AS ci_low, CASE WHEN count(tau) >= ceil(0.95 * {REPLICATES}) THEN round(quantile_cont(tau, 0.975), 9) END AS ci_high FROM t""")
def st09_interval(spark, d):
    est = T.bootstrap_within(view(spark, d, "samples"), draws(spark, d), "task_id", "quality", acc())
    return T.interval(est, [], "tau", REPLICATES).select("defined", F.round("ci_low", 9).alias("ci_low"), F.round("ci_high", 9).alias("ci_high"))


PAIRED = f'SELECT * FROM ({PAIRS_SQL}) WHERE "left" IS NOT NULL AND "right" IS NOT NULL'


@query(f"""
WITH pr AS ({PAIRED}), r AS (SELECT *, row_number() OVER (PARTITION BY workflow, model ORDER BY task_id) - 1 AS k, count(*) OVER (PARTITION BY workflow, model) AS n FROM pr),
w AS (SELECT workflow, model, replicate, ('0x' || substr(md5('pair|' || replicate || '|' || k), 1, 8))::BIGINT % n AS k, count(*) AS w FROM r, range({REPLICATES}) q(replicate) GROUP BY ALL),
b AS (SELECT w.workflow, w.model, replicate, CAST(sum(("left" - "right") * w) AS DOUBLE) / sum(w) AS delta FROM w JOIN r ON w.workflow = r.workflow AND w.model = r.model AND w.k = r.k GROUP BY ALL),
i AS (SELECT workflow, model, round(quantile_cont(delta, 0.025), 6) AS ci_low, round(quantile_cont(delta, 0.975), 6) AS ci_high FROM b GROUP BY ALL),
c AS (SELECT workflow, model, count(*) AS n_pairs, round(avg("left"), 6) AS left_mean, round(avg("right"), 6) AS right_mean, round(avg("left" - "right"), 6) AS delta FROM pr GROUP BY ALL)
SELECT c.*, ci_low, ci_high FROM c JOIN i ON c.workflow = i.workflow AND c.model = i.model""")
def st10_paired_contrast(spark, d):
    p, keys = shot_pairs(spark, d), ["workflow", "model"]
    ci = T.interval(T.bootstrap_contrast(p, keys, "task_id", REPLICATES, "pair"), keys, "delta", REPLICATES).drop("defined")
    out = T.contrast(p, keys).join(ci, keys)
    return out.select(*keys, "n_pairs", *[F.round(c, 6).alias(c) for c in ("left_mean", "right_mean", "delta", "ci_low", "ci_high")])


@query("""
WITH b AS (SELECT task_id, model, bool_or(stage = 'accepted') AS ok, bool_and(stage IN ('accepted', 'proof_failed')) AS known FROM samples GROUP BY ALL),
s AS (SELECT scope, x.task_id, x.ok AS l, y.ok AS r FROM b x JOIN b y ON x.task_id = y.task_id AND x.model = 'm0' AND y.model = 'm1', (VALUES ('all'), ('determinate')) v(scope) WHERE scope = 'all' OR (x.known AND y.known))
SELECT v.scope, count(s.task_id) AS pairs, count(*) FILTER (l) AS left_success, count(*) FILTER (r) AS right_success, CAST(count(*) FILTER (l) - count(*) FILTER (r) AS DOUBLE) / nullif(count(s.task_id), 0) AS difference FROM (VALUES ('all'), ('determinate')) v(scope) LEFT JOIN s ON s.scope = v.scope GROUP BY v.scope""")
def st11_paired_difference(spark, d):
    from trivane.operators.aggregates import densify, scoped

    b = view(spark, d, "samples").groupBy("task_id").pivot("model", ["m0", "m1"]).agg(F.bool_or(acc()).alias("ok"), F.bool_and(F.col("stage").isin("accepted", "proof_failed")).alias("known"))
    both = b.where("m0_ok IS NOT NULL AND m1_ok IS NOT NULL")
    x = scoped(both, {"all": F.lit(True), "determinate": F.col("m0_known") & F.col("m1_known")})
    agg = x.groupBy("scope").agg(F.count(F.lit(1)).alias("pairs"), S.long_if(F.col("m0_ok")).alias("left_success"), S.long_if(F.col("m1_ok")).alias("right_success"))
    out = densify(agg, [spark.createDataFrame([("all",), ("determinate",)], "scope string")], ["scope"], ["pairs", "left_success", "right_success"])
    return out.withColumn("difference", S.ratio(F.col("left_success") - F.col("right_success"), "pairs"))


@query(f"""
WITH f AS (SELECT DISTINCT sample_id FROM cases WHERE amount > 48), keep AS (SELECT * FROM samples WHERE sample_id NOT IN (SELECT sample_id FROM f)), {COUNTS_SQL.replace("FROM samples", "FROM keep")} SELECT workflow, n_acc, n_other, round({TAU_SQL}, 9) AS tau FROM c""")
def st12_leave_out(spark, d):
    keep = view(spark, d, "samples").join(view(spark, d, "cases").where("amount > 48"), "sample_id", "left_anti")
    c = T.pair_counts(T.by_value(keep, ["workflow"], "quality", acc()), ["workflow"], "quality")
    return c.select("workflow", "n_acc", "n_other", F.round(T.tau_b(), 9).alias("tau"))


@query("WITH e AS (SELECT base_id, candidate_id, exp((points % 100 - max(points % 100) OVER (PARTITION BY base_id)) / 20.0) AS e FROM candidates) SELECT base_id, candidate_id, round(e / sum(e) OVER (PARTITION BY base_id), 9) AS weight FROM e")
def m10_softmax(spark, d):
    c = view(spark, d, "candidates").select("base_id", "candidate_id", (F.col("points") % 100).alias("score"))
    return T.softmax(c, ["base_id"], "score", 20.0).select("base_id", "candidate_id", F.round("weight", 9).alias("weight"))


@query("SELECT candidate_id, round(CASE WHEN points % 7 + points % 3 > 0 THEN CAST(points % 7 AS DOUBLE) / (points % 7 + points % 3) END - (0.1 * (points % 3) + 0.04 * (points % 5)) / nullif(CAST(points % 4 AS DOUBLE), 0), 9) AS score FROM candidates")
def m11_repair_score(spark, d):
    p = F.col("points")
    return view(spark, d, "candidates").select("candidate_id", F.round(S.repair_score(p % 7, p % 3, p % 5, p % 4), 9).alias("score"))


@query("""
WITH x AS (SELECT base_id, candidate_id, points % 9 + 1 AS w, sum(points % 9 + 1) OVER (PARTITION BY base_id ORDER BY candidate_id ROWS UNBOUNDED PRECEDING) AS hi, sum(points % 9 + 1) OVER (PARTITION BY base_id) AS t FROM candidates),
u AS (SELECT x.*, i AS draw, CAST(('0x' || substr(md5('draw|' || base_id || '|' || i), 1, 8))::BIGINT AS DOUBLE) / 4294967296.0 * t AS u FROM x, range(1, 6) r(i))
SELECT base_id, candidate_id, CAST(draw AS INT) AS draw FROM u WHERE u >= hi - w AND u < hi""")
def st29_resample(spark, d):
    c = view(spark, d, "candidates").select("base_id", "candidate_id", (F.col("points") % 9 + 1).alias("w"))
    return T.resample(c, ["base_id"], "candidate_id", "w", 5, "draw").drop("w")

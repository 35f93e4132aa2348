"""Queries for joins (J), set operations (U), windows (W) and orderings (T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trivane.functions import states as S
from trivane.operators import joins as J
from trivane.operators import sets as U
from trivane.operators import windows as N
from trivane.plans.registry import query
from trivane.views import DIRECTIONS, view


@query("SELECT s.sample_id, s.stage, o.io_correct_passed FROM samples s JOIN outcomes o ON s.sample_id = o.sample_id")
def j01_checked_join(spark, d):
    o = view(spark, d, "outcomes").select("sample_id", "io_correct_passed")
    s = view(spark, d, "samples").select("sample_id", "stage").join(o.select("sample_id"), "sample_id", "left_semi")
    return J.checked_join(s, o, "sample_id")


@query("SELECT o_orderkey, c_mktsegment, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j02_star(spark, d):
    t = lambda n: view(spark, d, n)
    fact = t("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    out = J.star(fact, (t("customer").select("c_custkey", "c_mktsegment", F.col("c_nationkey").alias("n_nationkey")), "c_custkey"), (t("nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey")), "n_nationkey"), (t("region"), "r_regionkey"))
    return out.select("o_orderkey", "c_mktsegment", "n_name", "r_name")


@query("SELECT DISTINCT s.task_id, coalesce(c.seg, 'not_reviewed') AS seg FROM samples s LEFT JOIN (SELECT c_custkey AS task_id, c_mktsegment AS seg FROM customer WHERE c_acctbal > 5000) c ON s.task_id = c.task_id")
def j03_left_defaults(spark, d):
    review = view(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("task_id"), F.col("c_mktsegment").alias("seg"))
    return J.left_with_defaults(view(spark, d, "samples").select("task_id").distinct(), review, "task_id", {"seg": "not_reviewed"})


@query("SELECT c.candidate_id, c.points % 3 AS version, coalesce(s.status, 'not_attempted') AS status FROM candidates c LEFT JOIN (SELECT candidate_id, points % 2 AS version, status FROM candidates WHERE points % 5 <> 0) s ON c.candidate_id = s.candidate_id AND c.points % 3 = s.version")
def j04_against_store(spark, d):
    c = view(spark, d, "candidates")
    store = c.where("points % 5 <> 0").select("candidate_id", (F.col("points") % 2).alias("version"), "status")
    return J.against_store(c.select("candidate_id", (F.col("points") % 3).alias("version")), store, "candidate_id", "version")


@query("SELECT coalesce(s.sample_id, c.sample_id) AS sample_id, CASE WHEN c.sample_id IS NULL THEN 'left' ELSE 'right' END AS side FROM (SELECT sample_id FROM samples WHERE eligible) s FULL JOIN (SELECT DISTINCT sample_id FROM cases) c ON s.sample_id = c.sample_id WHERE s.sample_id IS NULL OR c.sample_id IS NULL")
def j05_key_difference(spark, d):
    return J.key_difference(view(spark, d, "samples").where("eligible"), view(spark, d, "cases"), "sample_id")


@query("SELECT sample_id, stage FROM samples WHERE sample_id NOT IN (SELECT sample_id FROM cases)")
def j06_anti(spark, d):
    return view(spark, d, "samples").join(view(spark, d, "cases"), "sample_id", "left_anti").select("sample_id", "stage")


@query("SELECT sample_id, stage FROM samples WHERE sample_id IN (SELECT sample_id FROM cases WHERE state = 'failed' AND amount > 45)")
def j07_semi(spark, d):
    return view(spark, d, "samples").join(view(spark, d, "cases").where("state = 'failed' AND amount > 45"), "sample_id", "left_semi").select("sample_id", "stage")


PAIRS_SQL = "SELECT workflow, model, task_id, max(CASE WHEN shot = 'few' THEN v END) AS \"left\", max(CASE WHEN shot = 'zero' THEN v END) AS \"right\" FROM (SELECT workflow, model, task_id, shot, max(quality) AS v FROM samples GROUP BY ALL) GROUP BY ALL"


def shot_pairs(spark, d):
    best = view(spark, d, "samples").groupBy("workflow", "model", "task_id", "shot").agg(F.max("quality").alias("v"))
    return J.paired(best, ["workflow", "model", "task_id"], "shot", "few", "zero", "v")


@query(f'SELECT * FROM ({PAIRS_SQL}) WHERE "left" IS NOT NULL AND "right" IS NOT NULL')
def j08_paired(spark, d):
    return shot_pairs(spark, d)


@query("""
WITH c AS (SELECT DISTINCT workflow, model, shot FROM samples), k AS (SELECT *, concat_ws('|', workflow, model, shot) AS k FROM c),
p AS (SELECT CASE WHEN a.workflow = b.workflow AND a.model = b.model AND a.shot <> b.shot THEN 'prompting' WHEN a.model = b.model AND a.shot = b.shot AND a.shot = 'few' AND '1' IN (a.workflow, b.workflow) THEN 'workflow' WHEN a.workflow = '1' AND b.workflow = '1' AND a.shot = 'few' AND b.shot = 'few' THEN 'model' END AS rule, a.k AS x, b.k AS y, a.shot AS xs FROM k a JOIN k b ON a.k < b.k)
SELECT rule, CASE WHEN rule = 'prompting' AND xs <> 'few' THEN y ELSE x END AS left_k, CASE WHEN rule = 'prompting' AND xs <> 'few' THEN x ELSE y END AS right_k FROM p WHERE rule IS NOT NULL""")
def j09_oriented_pairs(spark, d):
    c = view(spark, d, "samples").select("workflow", "model", "shot").distinct().withColumn("k", F.concat_ws("|", "workflow", "model", "shot"))
    f = lambda a, n: F.col(f"{a}.{n}")
    rules = {
        "prompting": lambda a, b: (f(a, "workflow") == f(b, "workflow")) & (f(a, "model") == f(b, "model")) & (f(a, "shot") != f(b, "shot")),
        "workflow": lambda a, b: (f(a, "model") == f(b, "model")) & (f(a, "shot") == f(b, "shot")) & (f(a, "shot") == "few") & ((f(a, "workflow") == "1") | (f(b, "workflow") == "1")),
        "model": lambda a, b: (f(a, "workflow") == "1") & (f(b, "workflow") == "1") & (f(a, "shot") == "few") & (f(b, "shot") == "few"),
    }
    return J.oriented_pairs(c, F.col("k"), rules, lambda rule, a, b: (F.col(rule) == "prompting") & (f(a, "shot") != "few")).select("rule", "left_k", "right_k")


@query("WITH m AS (SELECT DISTINCT workflow, model FROM samples) SELECT a.workflow, a.model AS left_model, b.model AS right_model FROM m a JOIN m b ON a.workflow = b.workflow AND a.model < b.model")
def j10_combinations(spark, d):
    m = view(spark, d, "samples").select("workflow", "model").distinct()
    a, b = m.alias("a"), m.alias("b")
    return a.join(b, (F.col("a.workflow") == F.col("b.workflow")) & (F.col("a.model") < F.col("b.model"))).select("a.workflow", F.col("a.model").alias("left_model"), F.col("b.model").alias("right_model"))


@query("SELECT DISTINCT task_id FROM samples WHERE model = 'm0' AND eligible AND stage = 'proof_failed' INTERSECT SELECT DISTINCT task_id FROM samples WHERE model = 'm1' AND eligible AND stage = 'proof_failed'")
def j11_common_tasks(spark, d):
    return J.common_units(view(spark, d, "samples"), "task_id", "model", "m0", "m1", F.col("eligible") & (F.col("stage") == "proof_failed"))


@query("SELECT base_id, operator, arg_max(candidate_id, pos) AS candidate_id, max(pos) AS pos FROM candidates GROUP BY base_id, operator")
def j12_last_wins(spark, d):
    return J.last_wins(view(spark, d, "candidates").select("base_id", "operator", "candidate_id", "pos"), ["base_id", "operator"], "pos")


@query("""
WITH r AS (SELECT DISTINCT sample_id, case_no FROM cases), g AS (SELECT sample_id, case_no, CASE WHEN bool_or(state = 'failed') THEN false WHEN bool_or(state = 'unresolved') THEN NULL ELSE true END AS success FROM cases WHERE case_no <> 2 GROUP BY sample_id, case_no)
SELECT r.sample_id, r.case_no, CASE WHEN g.sample_id IS NULL THEN false ELSE success END AS success, g.sample_id IS NOT NULL AS matched FROM r LEFT JOIN g ON r.sample_id = g.sample_id AND r.case_no = g.case_no""")
def j13_reference_left(spark, d):
    c = view(spark, d, "cases")
    holds = F.when(F.col("state") == "passed", True).when(F.col("state") == "failed", False)
    gen = c.where("case_no <> 2").groupBy("sample_id", "case_no").agg(S.all_true(holds).alias("success"))
    return J.reference_left(c.select("sample_id", "case_no").distinct(), gen, ["sample_id", "case_no"], "success")


@query("""
WITH n AS (SELECT p_partkey AS pos, concat(split_part(p_type, ' ', 1), '::', p_brand, '::', CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE split_part(p_type, ' ', -1) END) AS name FROM part),
c AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN concat(split_part(p_type, ' ', 1), '::', p_brand, '::', p_brand) ELSE split_part(p_type, ' ', -1) END AS call FROM part),
e AS (SELECT DISTINCT name FROM n), t AS (SELECT split_part(name, '::', -1) AS t, arg_min(name, pos) AS s FROM n GROUP BY ALL)
SELECT c.id, c.call, coalesce(e.name, t.s) AS resolved FROM c LEFT JOIN e ON c.call = e.name LEFT JOIN t ON split_part(c.call, '::', -1) = t.t""")
def j14_resolve_names(spark, d):
    p = view(spark, d, "part")
    first, last = F.split_part("p_type", F.lit(" "), F.lit(1)), F.split_part("p_type", F.lit(" "), F.lit(-1))
    names = p.select(F.col("p_partkey").alias("pos"), F.concat_ws("::", first, "p_brand", F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(last)).alias("name"))
    calls = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 4 == 0, F.concat_ws("::", first, "p_brand", "p_brand")).otherwise(last).alias("call"))
    return J.resolve_names(calls, names, "call", "name", "pos")


@query("""
WITH a AS (SELECT sample_id, list(amount ORDER BY case_no, amount, part_id) FILTER (kind = 'io_correct') AS x, list(amount ORDER BY case_no, amount, part_id) FILTER (kind = 'io_wrong') AS y FROM cases GROUP BY sample_id),
p AS (SELECT sample_id, unnest(range(greatest(coalesce(len(x), 0), coalesce(len(y), 0)))) AS pos, x, y FROM a WHERE x IS NOT NULL AND y IS NOT NULL)
SELECT sample_id, pos, x[pos + 1] AS "left", y[pos + 1] AS "right" FROM p""")
def j15_by_position(spark, d):
    c = view(spark, d, "cases")
    arr = lambda k: c.where(F.col("kind") == k).groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("case_no", "amount", "part_id"))), lambda x: x["amount"]).alias(k))
    return J.by_position(arr("io_correct"), arr("io_wrong"), "sample_id", "io_correct", "io_wrong")


@query("WITH p AS (SELECT workflow, model, count(*) AS n FROM samples GROUP BY ALL), f AS (SELECT 'm0' AS model, 'x' AS frame, '1' AS other UNION ALL SELECT 'm1', 'y', '2') SELECT p.workflow, p.model, frame, n FROM p JOIN f ON p.model = f.model WHERE p.workflow = '3' OR p.workflow = other")
def j16_inner_filter(spark, d):
    p = view(spark, d, "samples").groupBy("workflow", "model").agg(F.count(F.lit(1)).alias("n"))
    f = spark.createDataFrame([("m0", "x", "1"), ("m1", "y", "2")], "model string, frame string, other string")
    return p.join(f, "model").where("workflow = '3' OR workflow = other").select("workflow", "model", "frame", "n")


@query("""
WITH i AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM i WHERE line <> ''),
t AS (SELECT doc_id, pos, line, list_distinct(list_filter(string_split_regex(lower(line), '[^a-z0-9]+'), lambda x: x <> '')) AS t FROM n WHERE r <= 1000)
SELECT a.doc_id, a.pos AS left_pos, b.pos AS right_pos, CASE WHEN len(a.t) + len(b.t) = 0 THEN 1.0 ELSE CAST(len(list_intersect(a.t, b.t)) AS DOUBLE) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) END AS jaccard
FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.pos < b.pos AND a.line <> b.line WHERE CASE WHEN len(a.t) + len(b.t) = 0 THEN 1.0 ELSE CAST(len(list_intersect(a.t, b.t)) AS DOUBLE) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) END >= 0.6""")
def j17_near_duplicates(spark, d):
    lines = view(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where("line <> ''").withColumn("pos", F.col("pos").cast("long") + 1)
    tokens = F.filter(F.split(F.lower("line"), "[^a-z0-9]+"), lambda x: x != "")
    return J.near_duplicates(lines, "doc_id", "line", "pos", tokens, 0.6)


@query("WITH a AS (SELECT sample_id FROM samples WHERE eligible), b AS (SELECT DISTINCT sample_id FROM cases WHERE state = 'failed') SELECT (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS n_union, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS n_both, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS n_left_only, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS n_right_only")
def u01_key_algebra(spark, d):
    return U.key_algebra(view(spark, d, "samples").where("eligible"), view(spark, d, "cases").where("state = 'failed'"), "sample_id")


FEATURES_SQL = "c AS (SELECT sample_id, part_id % 10 AS feature, count(*) FILTER (kind = 'io_correct') AS n_left, count(*) FILTER (kind = 'io_wrong') AS n_right FROM cases WHERE kind <> 'io_invalid' GROUP BY ALL)"


def features(spark, d):
    c = view(spark, d, "cases").select("sample_id", (F.col("part_id") % 10).alias("feature"), "kind")
    return U.multiset(c, "sample_id", "feature", "kind", "io_correct", "io_wrong")


@query(f"WITH {FEATURES_SQL} SELECT sample_id, CAST(sum(n_left) AS BIGINT) AS \"left\", CAST(sum(n_right) AS BIGINT) AS \"right\", CAST(sum(least(n_left, n_right)) AS BIGINT) AS common, CAST(sum(greatest(n_left - n_right, 0)) AS BIGINT) AS left_only, CAST(sum(greatest(n_right - n_left, 0)) AS BIGINT) AS right_only FROM c GROUP BY sample_id")
def u02_u03_multisets(spark, d):
    return U.multiset_sizes(features(spark, d), "sample_id")


@query("SELECT cohort, count(*) AS n FROM (SELECT 'accepted' AS cohort FROM samples WHERE stage = 'accepted' UNION ALL SELECT 'failed' FROM samples WHERE stage = 'proof_failed' UNION ALL SELECT 'eligible' FROM samples WHERE eligible) GROUP BY cohort")
def u04_union_all(spark, d):
    s = view(spark, d, "samples")
    part = lambda name, cond: s.where(cond).select(F.lit(name).alias("cohort"))
    return part("accepted", "stage = 'accepted'").unionByName(part("failed", "stage = 'proof_failed'")).unionByName(part("eligible", "eligible")).groupBy("cohort").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT base_id, status, candidate_id FROM (SELECT *, row_number() OVER (PARTITION BY base_id, status ORDER BY candidate_id) AS r FROM candidates) WHERE r = 1")
def u05_dedupe_first(spark, d):
    return U.dedupe_first(view(spark, d, "candidates").select("base_id", "status", "candidate_id"), ["base_id", "status"], "candidate_id")


@query("""
WITH a AS (SELECT sample_id, coalesce(list_distinct(list(part_id % 10) FILTER (kind = 'io_correct')), []) AS x, coalesce(list_distinct(list(part_id % 10) FILTER (kind = 'io_wrong')), []) AS y FROM cases GROUP BY sample_id)
SELECT sample_id, CASE WHEN len(x) + len(y) = 0 THEN 1.0 ELSE CAST(len(list_intersect(x, y)) AS DOUBLE) / (len(x) + len(y) - len(list_intersect(x, y))) END AS jaccard FROM a""")
def u06_jaccard(spark, d):
    pick = lambda k: F.collect_set(F.when(F.col("kind") == k, F.col("part_id") % 10))
    a = view(spark, d, "cases").groupBy("sample_id").agg(pick("io_correct").alias("x"), pick("io_wrong").alias("y"))
    return a.select("sample_id", U.jaccard(F.col("x"), F.col("y")).alias("jaccard"))


@query("SELECT base_id, operator, candidate_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY base_id, operator ORDER BY pos) AS r FROM candidates WHERE status = 'confirmed') WHERE r = 1")
def w01_first_confirmed(spark, d):
    return N.first_qualifying(view(spark, d, "candidates"), ["base_id", "operator"], ["pos"], F.col("status") == "confirmed").select("base_id", "operator", "candidate_id", "pos")


@query("SELECT task_id, sample_id, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY CASE WHEN stage = 'accepted' THEN 0 ELSE 1 END, sample_id) AS r FROM samples) WHERE r <= 3")
def w02_first_three(spark, d):
    accepted_first = F.when(F.col("stage") == "accepted", 0).otherwise(1)
    return N.first_n(view(spark, d, "samples"), ["task_id"], [accepted_first, "sample_id"], 3).select("task_id", "sample_id", "rank")


@query("""
WITH a AS (SELECT *, row_number() OVER (PARTITION BY sample_id, kind ORDER BY amount DESC, part_id, case_no, oracle_id) AS r1 FROM cases), b AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY amount DESC, part_id, case_no, oracle_id) AS r2 FROM a WHERE r1 <= 2)
SELECT sample_id, kind, amount, part_id, r2 AS rank FROM b WHERE r2 <= 4""")
def w03_capped(spark, d):
    order = [F.desc("amount"), "part_id", "case_no", "oracle_id"]
    return N.capped(view(spark, d, "cases"), ["sample_id", "kind"], ["sample_id"], order, 2, 4).select("sample_id", "kind", "amount", "part_id", "rank")


@query("""
WITH h AS (SELECT base_id, operator, candidate_id, row_number() OVER (PARTITION BY base_id, operator ORDER BY md5(CAST(candidate_id AS VARCHAR)), candidate_id) AS turn FROM candidates), p AS (SELECT *, row_number() OVER (PARTITION BY base_id ORDER BY CASE WHEN turn > 2 THEN 1 ELSE 0 END, turn, operator) AS picked FROM h)
SELECT base_id, operator, candidate_id, turn, picked FROM p WHERE picked <= 13""")
def w04_budget_sample(spark, d):
    c = view(spark, d, "candidates").select("base_id", "operator", "candidate_id")
    return N.budget_sample(c, "operator", [F.md5(F.col("candidate_id").cast("string").cast("binary")), "candidate_id"], 2, 13, ["base_id"])


@query("SELECT sample_id, workflow, rank() OVER (PARTITION BY workflow ORDER BY quality) + (count(*) OVER (PARTITION BY workflow, quality) - 1) / 2 AS midrank FROM samples WHERE quality IS NOT NULL")
def w05_midranks(spark, d):
    s = view(spark, d, "samples").where("quality IS NOT NULL").select("sample_id", "workflow", "quality")
    return N.midranks(s, ["workflow"], "quality").drop("quality")


@query("WITH g AS (SELECT workflow, quality AS v, count(*) FILTER (stage = 'accepted') AS a, count(*) FILTER (stage <> 'accepted') AS b FROM samples WHERE quality IS NOT NULL GROUP BY ALL) SELECT workflow, v, a, b, CAST(coalesce(sum(b) OVER (PARTITION BY workflow ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS below FROM g")
def w06_running_counts(spark, d):
    from trivane.operators.statistics import by_value

    g = by_value(view(spark, d, "samples").withColumnRenamed("quality", "v"), ["workflow"], "v", F.col("stage") == "accepted")
    return N.running_sums(g, ["workflow"], ["v"], {"below": "b"})


@query("WITH u AS (SELECT base_id, points % 50 AS edit, min(candidate_id) AS candidate_id FROM candidates GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY base_id ORDER BY candidate_id) AS rank FROM u) SELECT base_id, edit, candidate_id, rank FROM r WHERE rank <= 5")
def w07_candidate_ranks(spark, d):
    c = view(spark, d, "candidates").select("base_id", (F.col("points") % 50).alias("edit"), "candidate_id")
    return N.first_n(U.dedupe_first(c, ["base_id", "edit"], "candidate_id"), ["base_id"], ["candidate_id"], 5)


@query("SELECT base_id, candidate_id, CASE WHEN status <> 'error' THEN CAST(sum(CASE WHEN status <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY base_id ORDER BY candidate_id ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS ordinal FROM candidates")
def w08_ordinals(spark, d):
    return N.running_ordinal(view(spark, d, "candidates").select("base_id", "candidate_id", "status"), ["base_id"], ["candidate_id"], F.col("status") != "error").drop("status")


@query("SELECT base_id, candidate_id, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY base_id ORDER BY ts DESC, candidate_id DESC) AS r FROM candidates WHERE status = 'rejected') WHERE r <= 2")
def w09_last_failures(spark, d):
    c = view(spark, d, "candidates").where("status = 'rejected'")
    return N.last_k(c, ["base_id"], [F.desc("ts"), F.desc("candidate_id")], 2).select("base_id", "candidate_id", "rank")


@query("SELECT candidate_id, coalesce(max(status = 'confirmed') OVER (PARTITION BY base_id, operator ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS earlier FROM candidates")
def w10_earlier_confirmed(spark, d):
    c = view(spark, d, "candidates")
    return N.earlier_any(c, ["base_id", "operator"], ["pos"], F.col("status") == "confirmed").select("candidate_id", "earlier")


@query("WITH g AS (SELECT DISTINCT workflow, model FROM samples), r AS (SELECT *, dense_rank() OVER (PARTITION BY workflow ORDER BY model) AS d FROM g) SELECT workflow, model, (max(d) OVER (PARTITION BY workflow) - d) % 2 = 1 AS banded FROM r")
def w11_bands(spark, d):
    return N.bands(view(spark, d, "samples").select("workflow", "model").distinct(), ["workflow"], "model")


@query("""
WITH w AS (SELECT workflow, task_id, count(*) AS n FROM samples GROUP BY ALL), r AS (SELECT *, abs(2 * sum(n) OVER (PARTITION BY workflow ORDER BY task_id ROWS UNBOUNDED PRECEDING) - sum(n) OVER (PARTITION BY workflow)) AS diff FROM w), b AS (SELECT *, row_number() OVER (PARTITION BY workflow ORDER BY diff, task_id) AS k FROM r)
SELECT workflow, task_id AS split, CAST(diff AS BIGINT) AS difference FROM b WHERE k = 1""")
def w12_split_point(spark, d):
    return N.split_point(view(spark, d, "samples").groupBy("workflow", "task_id").agg(F.count(F.lit(1)).alias("n")), ["workflow"], "task_id", "n")


@query("SELECT sample_id, row_number() OVER (ORDER BY quality NULLS FIRST, sample_id) AS position FROM samples")
def t01_sorted(spark, d):
    """A position for each row in a total order."""
    s = view(spark, d, "samples").select("sample_id", "quality")
    return N.positions(s, ["quality", "sample_id"]).select("sample_id", "position")


@query("SELECT part_id, count(*) AS n, min(sample_id) AS first_seen FROM cases GROUP BY part_id ORDER BY n DESC, first_seen, part_id LIMIT 30")
def t02_top_counts(spark, d):
    c = view(spark, d, "cases").groupBy("part_id").agg(F.count(F.lit(1)).alias("n"), F.min("sample_id").alias("first_seen"))
    return c.orderBy(F.desc("n"), "first_seen", "part_id").limit(30)


@query("WITH l AS (SELECT oracle_id, list(sample_id ORDER BY sample_id, case_no, part_id, amount) AS a FROM cases WHERE state = 'failed' GROUP BY oracle_id) SELECT oracle_id, array_to_string(a[1:20], ',') AS details, CAST(len(a) AS BIGINT) AS n FROM l")
def t03_truncated(spark, d):
    """At most 20 details a group, in order; ranks keep the rest from being collected, counts cover all."""
    c = view(spark, d, "cases").where("state = 'failed'")
    n = c.groupBy("oracle_id").agg(F.count(F.lit(1)).alias("n"))
    top = N.first_n(c, ["oracle_id"], ["sample_id", "case_no", "part_id", "amount"], 20)
    lists = top.groupBy("oracle_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "sample_id"))), lambda x: x["sample_id"].cast("string")), ",").alias("details"))
    return lists.join(n, "oracle_id")


@query("SELECT base_id, arg_max(candidate_id, [CASE WHEN status = 'error' THEN 0 ELSE 1 END, points % 7, -(points % 5), -candidate_id]) AS best FROM candidates GROUP BY base_id")
def t05_best_candidate(spark, d):
    c = view(spark, d, "candidates")
    key = F.struct(F.when(F.col("status") == "error", 0).otherwise(1), F.col("points") % 7, -(F.col("points") % 5), -F.col("candidate_id"))
    return c.groupBy("base_id").agg(F.max_by("candidate_id", key).alias("best"))


@query("WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]{12,}')) AS w, generate_subscripts(regexp_extract_all(text, '[A-Za-z]{12,}'), 1) AS p FROM documents) SELECT doc_id, arg_min(w, p * 1 - 100000000 * length(w)) AS longest FROM m GROUP BY doc_id")
def t06_longest_match(spark, d):
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]{12,}"), F.lit(0))
    best = F.aggregate(words, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    return view(spark, d, "documents").select("doc_id", best.alias("longest")).where("longest <> ''")


@query("SELECT candidate_id, points FROM (SELECT *, row_number() OVER (ORDER BY points DESC, candidate_id) AS r FROM candidates) WHERE r <= 10")
def t07_beam(spark, d):
    return view(spark, d, "candidates").orderBy(F.desc("points"), "candidate_id").limit(10).select("candidate_id", "points")


@query("SELECT sample_id, CASE WHEN 'invalid' IN (pre_ref_to_gen, post_gen_to_ref, pre_gen_to_ref, post_ref_to_gen) THEN 'flagged' WHEN pre_ref_to_gen = 'valid' AND post_gen_to_ref = 'valid' AND pre_gen_to_ref = 'valid' AND post_ref_to_gen = 'valid' THEN 'equivalent' ELSE 'unresolved' END AS state, CAST(pre_ref_to_gen = 'invalid' AS BIGINT) + CAST(post_gen_to_ref = 'invalid' AS BIGINT) + CAST(pre_gen_to_ref = 'invalid' AS BIGINT) + CAST(post_ref_to_gen = 'invalid' AS BIGINT) AS flags FROM samples")
def p28_membership(spark, d):
    s = view(spark, d, "samples")
    flags = sum((F.when(F.col(k) == "invalid", 1).otherwise(0) for k in DIRECTIONS[1:]), F.when(F.col(DIRECTIONS[0]) == "invalid", 1).otherwise(0)).cast("long")
    valid = F.forall(F.array(*DIRECTIONS), lambda x: x == "valid")
    return s.select("sample_id", F.when(flags > 0, "flagged").when(valid, "equivalent").otherwise("unresolved").alias("state"), flags.alias("flags"))

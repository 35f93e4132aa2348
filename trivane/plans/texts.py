"""Queries for lexical functions (F), text similarity (ST13-ST17), search (ST30-ST32), hashes and tags (H), and library
records (Y). Specification texts are written from rows of part, so that SQL can say what they hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from trivane.functions import parsing as P
from trivane.functions import states as S
from trivane.operators import aggregates as A
from trivane.operators import search as R
from trivane.operators import texts as T
from trivane.plans.registry import query
from trivane.session import dealt
from trivane.views import view

SPEC = """// part %1$d fn hidden()
/* outer /* inner requires */ x */
fn f%1$d(x: u32, v: &Vec<u32>) -> (r: u32)
    requires x < %2$d, v.len() > %3$d%4$s
    ensures r == x + %3$d, r >= x %5$s
{ let s = "ensures // no"; assert(r >= 0); if x < %2$d { x + %3$d } else { 0 } }
"""


def spec_texts(spark, d):
    P.ready(spark)
    p = dealt(view(spark, d, "part").select("p_partkey", "p_size"))
    extra = F.when(F.col("p_partkey") % 3 == 0, ", true").when(F.col("p_partkey") % 3 == 1, ", x >= x").otherwise("")
    more = F.when(F.col("p_partkey") % 2 == 0, "&& forall|i: int| 0 <= i ==> v[i] >= 0").otherwise("")
    return p.select("p_partkey", F.format_string(SPEC, "p_partkey", "p_size", F.col("p_partkey") % 7, extra, more).alias("text"), "p_size")


@query("SELECT p_partkey, CAST(0 AS BIGINT) AS left_over, true AS has_string FROM part")
def f01_strip_comments(spark, d):
    """Comments are gone, nested ones too; a string that looks like one stays."""
    t = spec_texts(spark, d).select("p_partkey", P.strip_comments("text").alias("t"))
    return t.select("p_partkey", F.regexp_count("t", F.lit("hidden|outer|inner")).cast("long").alias("left_over"), F.contains("t", F.lit("ensures // no")).alias("has_string"))


def text_pairs(spark, d):
    """Every turn of a conversation with the turn before it, as token arrays of the whole texts."""
    t = view(spark, d, "conversations").select("conv_id", "turn", P.words(F.coalesce("text", F.lit(""))).alias("c"))
    before = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("c").alias("r"))
    return t.join(before, ["conv_id", "turn"]).select(F.struct("conv_id", "turn").alias("item_id"), "c", "r")


_PAIRS = "tk AS (SELECT conv_id, turn, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS c FROM conversations), pr AS (SELECT a.conv_id || '.' || a.turn AS item_id, a.c, b.c AS r FROM tk a JOIN tk b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1)"


@query(f"""
WITH {_PAIRS}, g AS (SELECT item_id, true AS c, n, unnest(list_transform(range(1, len(c) - n + 2), lambda i: array_to_string(c[i:i + n - 1], ' '))) AS g FROM pr, range(1, 5) k(n) UNION ALL SELECT item_id, false, n, unnest(list_transform(range(1, len(r) - n + 2), lambda i: array_to_string(r[i:i + n - 1], ' '))) FROM pr, range(1, 5) k(n)),
k AS (SELECT item_id, n, g, count(*) FILTER (c) AS x, count(*) FILTER (NOT c) AS y FROM g GROUP BY ALL), m AS (SELECT item_id, CAST(sum(least(x, y)) FILTER (n = 1) AS DOUBLE) AS m1, CAST(coalesce(sum(least(x, y)) FILTER (n = 2), 0) AS DOUBLE) AS m2, CAST(coalesce(sum(least(x, y)) FILTER (n = 3), 0) AS DOUBLE) AS m3, CAST(coalesce(sum(least(x, y)) FILTER (n = 4), 0) AS DOUBLE) AS m4 FROM k GROUP BY ALL),
s AS (SELECT m.*, len(c) AS c, len(r) AS r, CAST(m1 = 0 AS INT) AS z1, CAST(m1 = 0 AS INT) + CAST(m2 = 0 AS INT) AS z2, CAST(m1 = 0 AS INT) + CAST(m2 = 0 AS INT) + CAST(m3 = 0 AS INT) AS z3, CAST(m1 = 0 AS INT) + CAST(m2 = 0 AS INT) + CAST(m3 = 0 AS INT) + CAST(m4 = 0 AS INT) AS z4 FROM m JOIN pr ON m.item_id = pr.item_id)
SELECT item_id, CAST(c AS INT) AS c, CAST(r AS INT) AS r, round(CASE WHEN m1 = 0 THEN 0 ELSE CASE WHEN c < r THEN exp(1 - CAST(r AS DOUBLE) / c) ELSE 1 END * exp((ln(m1 / c) + ln(CASE WHEN m2 = 0 THEN 1 / (pow(2, z2) * (c - 1)) ELSE m2 / (c - 1) END) + ln(CASE WHEN m3 = 0 THEN 1 / (pow(2, z3) * (c - 2)) ELSE m3 / (c - 2) END) + ln(CASE WHEN m4 = 0 THEN 1 / (pow(2, z4) * (c - 3)) ELSE m4 / (c - 3) END)) / 4) END, 9) AS bleu, round(CASE WHEN c < r THEN exp(1 - CAST(r AS DOUBLE) / c) ELSE 1 END, 9) AS brevity FROM s""")
def st13_m04_bleu(spark, d):
    out = T.bleu(text_pairs(spark, d), "item_id", "c", "r").withColumn("item_id", F.concat_ws(".", "item_id.conv_id", "item_id.turn"))
    return out.select("item_id", "c", "r", F.round("bleu", 9).alias("bleu"), F.round("brevity", 9).alias("brevity"))


@query(f"""
WITH RECURSIVE {_PAIRS}, t AS (SELECT item_id, c, r, 0 AS i, list_transform(range(len(r) + 1), lambda x: 0) AS row FROM pr
  UNION ALL SELECT item_id, c, r, i + 1, list_reduce(list_prepend([0], list_transform(range(1, len(r) + 1), lambda j: [CASE WHEN r[j] = c[i + 1] THEN row[j] + 1 ELSE row[j + 1] END])), lambda acc, x: list_append(acc, greatest(acc[len(acc)], x[1]))) FROM t WHERE i < len(c)),
l AS (SELECT item_id, len(c) AS c, len(r) AS r, row[len(row)] AS lcs FROM t WHERE i = len(c))
SELECT item_id, CAST(c AS INT) AS c, CAST(r AS INT) AS r, CAST(lcs AS INT) AS lcs, round(CASE WHEN lcs = 0 THEN 0 ELSE 2.0::DOUBLE * lcs / (c + r) END, 9) AS rouge FROM l""")
def st14_m03_rouge(spark, d):
    out = T.rouge_l(text_pairs(spark, d), "item_id", "c", "r").withColumn("item_id", F.concat_ws(".", "item_id.conv_id", "item_id.turn"))
    return out.withColumn("rouge", F.round("rouge", 9))


@query("""
WITH w AS (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS term FROM part)
SELECT term, count(DISTINCT p_partkey) AS n, min(p_partkey) AS first_name, max(p_partkey) AS last_name FROM w GROUP BY term""")
def st30_index(spark, d):
    i = R.index(view(spark, d, "part").withColumn("terms", F.split("p_type", " ")), "p_partkey", "terms")
    return R.postings(i, "term", "p_partkey")


_SCORE = """
WITH s AS (SELECT p_partkey, p_name, p_brand, p_type, lower(p_name || ' ' || p_type || ' ' || p_brand) AS t, lower(p_name) AS n, lower(p_brand) AS dc FROM part),
m AS (SELECT *, CAST(contains(t, 'steel') AS INT) + CAST(contains(t, '1') AS INT) + CAST(contains(t, 'brand#2') AS INT) AS hits, CAST(contains(n, 'steel') AS INT) + CAST(contains(n, '1') AS INT) + CAST(contains(n, 'brand#2') AS INT) AS names, CAST(contains(dc, 'steel') AS INT) + CAST(contains(dc, '1') AS INT) + CAST(contains(dc, 'brand#2') AS INT) AS docs FROM s),
r AS (SELECT p_partkey, p_type, hits, CAST(hits AS DOUBLE) / 3 * pow(1.5, names) * CASE WHEN docs > 0 THEN 1.2 ELSE 1.0 END AS score FROM m WHERE hits > 0)"""


def library(spark, d):
    return view(spark, d, "part")


def scored(spark, d):
    return R.full_text(library(spark, d), "the steel 1 of Brand#2", "p_name", F.concat_ws(" ", "p_name", "p_type", "p_brand"), F.col("p_brand"))


@query(_SCORE + " SELECT p_partkey, CAST(hits AS BIGINT) AS matched, round(score, 9) AS score FROM r")
def st31_full_text(spark, d):
    return scored(spark, d).select("p_partkey", "matched", F.round("score", 9).alias("score"))


@query(_SCORE + """, b AS (SELECT p_partkey, max(score) AS score, any_value(p_type) AS p_type FROM (SELECT p_partkey, p_type, score FROM r UNION ALL SELECT p_partkey, p_type, 1.0 FROM part WHERE p_size = 7) GROUP BY p_partkey)
SELECT p_partkey, round(CASE WHEN p_type LIKE 'PROMO%' THEN score * 1.5 ELSE score END, 9) AS score FROM b ORDER BY CASE WHEN p_type LIKE 'PROMO%' THEN score * 1.5 ELSE score END DESC, p_partkey LIMIT 10""")
def st32_t04_ranked(spark, d):
    s = R.structured(library(spark, d), F.col("p_size"), F.split("p_type", " "), "7", [])
    out = R.ranked([scored(spark, d).drop("matched"), s], "p_partkey", [(F.col("p_type").startswith("PROMO"), 1.5)], None, 10, "p_partkey")
    return out.select("p_partkey", F.round("score", 9).alias("score"))


_EDGES = "e AS (SELECT DISTINCT l_suppkey AS caller, l_partkey % 500 AS callee FROM lineitem)"


def edges(spark, d):
    return view(spark, d, "lineitem").select(F.col("l_suppkey").alias("caller"), (F.col("l_partkey") % 500).alias("callee")).distinct()


@query(f"WITH {_EDGES} SELECT DISTINCT callee AS id FROM e WHERE caller IN (1, 2, 3) AND callee NOT IN (1, 2, 3)")
def y20_context(spark, d):
    return R.callees_of(spark.range(1, 4), edges(spark, d), "id")


@query(f"WITH {_EDGES} SELECT callee, count(*) AS n, min(caller) AS first_caller FROM e GROUP BY callee")
def st30_callers(spark, d):
    return R.postings(R.callers(edges(spark, d)), "callee", "caller").select("callee", "n", F.col("first_name").alias("first_caller"))


@query("SELECT candidate_id, sha256(concat_ws('|', base_id, operator, trim(regexp_replace(concat('  ', status, '   x '), ' +', ' ', 'g')))) AS obligation FROM candidates")
def h02_obligation_id(spark, d):
    c = view(spark, d, "candidates")
    norm = F.trim(F.regexp_replace(F.concat(F.lit("  "), "status", F.lit("   x ")), " +", " "))
    return c.select("candidate_id", F.sha2(F.concat_ws("|", F.col("base_id").cast("string"), "operator", norm).cast("binary"), 256).alias("obligation"))


@query("SELECT sample_id, kind, count(*) AS n FROM cases WHERE state <> 'unresolved' GROUP BY ALL")
def h03_deep_walk(spark, d):
    """Nested records walked at the known depth, with the context that each level hands down."""
    inner = view(spark, d, "cases").groupBy("sample_id", "kind").agg(F.collect_list(F.struct("case_no", "state")).alias("checks"))
    doc = inner.groupBy("sample_id").agg(F.to_json(F.collect_list(F.struct("kind", "checks"))).alias("js"))
    top = doc.select("sample_id", F.explode(F.from_json("js", "array<struct<kind:string,checks:array<struct<case_no:bigint,state:string>>>>")).alias("k"))
    leaf = top.select("sample_id", "k.kind", F.explode("k.checks").alias("c")).where("c.state <> 'unresolved'")
    return leaf.groupBy("sample_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH a AS (SELECT sample_id, list(amount) AS v FROM cases WHERE kind = 'io_correct' GROUP BY sample_id), s AS (SELECT sample_id, v FROM a UNION ALL SELECT sample_id, [] FROM samples WHERE sample_id NOT IN (SELECT sample_id FROM a))
SELECT sample_id, CASE WHEN len(v) = 0 THEN 'empty' WHEN len(v) = 1 THEN 'single' ELSE 'multi' END AS size_tag, len(list_distinct(v)) < len(v) AS duplicate FROM s""")
def h05_value_tags(spark, d):
    a = view(spark, d, "cases").groupBy("sample_id").agg(F.collect_list(F.when(F.col("kind") == "io_correct", F.col("amount"))).alias("v"))
    s = view(spark, d, "samples").select("sample_id").join(a, "sample_id", "left").withColumn("v", F.coalesce("v", F.array().cast("array<bigint>")))
    n = F.size("v")
    return s.select("sample_id", F.when(n == 0, "empty").when(n == 1, "single").otherwise("multi").alias("size_tag"), (F.size(F.array_distinct("v")) < n).alias("duplicate"))


@query("SELECT p_partkey, CAST(CASE WHEN p_partkey % 3 < 2 THEN 3 ELSE 2 END AS BIGINT) AS requires, CAST(2 AS BIGINT) AS ensures, CAST(1 AS BIGINT) AS \"assert\", CAST(CASE WHEN p_partkey % 3 < 2 THEN 6 ELSE 5 END AS BIGINT) AS total FROM part")
def a32_clause_counts(spark, d):
    c = spec_texts(spark, d).select("p_partkey", F.explode(P.clauses("text")).alias("c")).select("p_partkey", "c.kind")
    return A.pivot_counts(c, "p_partkey", "kind", ["requires", "ensures", "assert"])


@query("SELECT item_id, CAST(length(regexp_replace(text, '[^A-Za-z]+', '', 'g')) AS BIGINT) AS letters, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS words FROM benchmark")
def f04_f05_compaction(spark, d):
    b = view(spark, d, "benchmark")
    return b.select("item_id", F.length(F.regexp_replace("text", "[^A-Za-z]+", "")).cast("long").alias("letters"), F.size(P.words(F.col("text"))).cast("long").alias("words"))


@query("SELECT sample_id, count(*) AS clauses, count(*) FILTER (state = 'passed') AS passed, CASE kind WHEN 'io_correct' THEN 'pre_reliability' WHEN 'io_wrong' THEN 'pre_completeness' ELSE 'post_reliability' END AS metric FROM cases GROUP BY sample_id, kind")
def st18_st19_presets(spark, d):
    """Clause metrics as presets of side, kind and direction: one roll-up, the preset a column."""
    preset = {"io_correct": "pre_reliability", "io_wrong": "pre_completeness", "io_invalid": "post_reliability"}
    name = F.element_at(F.create_map(*[F.lit(x) for kv in preset.items() for x in kv]), F.col("kind"))
    return view(spark, d, "cases").groupBy("sample_id", name.alias("metric")).agg(F.count(F.lit(1)).alias("clauses"), S.long_if(F.col("state") == "passed").alias("passed"))


@query("SELECT sample_id, CASE WHEN pre_false = 'other' AND post_true = 'other' THEN NULL ELSE (coalesce(CASE pre_false WHEN 'unfavorable' THEN 1.0 WHEN 'favorable' THEN 0.0 END, 0)::DOUBLE + coalesce(CASE post_true WHEN 'unfavorable' THEN 1.0 WHEN 'favorable' THEN 0.0 END, 0)) / (CAST(pre_false <> 'other' AS INT) + CAST(post_true <> 'other' AS INT)) END AS ratio, CASE WHEN pre_false = 'other' AND post_true = 'other' THEN 'not_available' WHEN pre_false = 'other' OR post_true = 'other' THEN 'partial' ELSE 'ok' END AS status FROM samples")
def st21_triviality_ratio(spark, d):
    """Mean of the probes that are usable, with equal weight."""
    v = lambda c: F.when(F.col(c) == "unfavorable", 1.0).when(F.col(c) == "favorable", 0.0)
    usable = F.array_compact(F.array(v("pre_false"), v("post_true")))
    n = F.size(usable)
    mean = F.when(n > 0, F.aggregate(usable, F.lit(0.0), lambda a, x: a + x) / n)
    return view(spark, d, "samples").select("sample_id", mean.alias("ratio"), F.when(n == 0, "not_available").when(n == 1, "partial").otherwise("ok").alias("status"))


@query("SELECT DISTINCT concat_ws('|', workflow, model, shot, task_id) AS sample_id, workflow, model, shot, CAST(task_id AS VARCHAR) AS task_id FROM samples")
def s08_sample_identity(spark, d):
    """Identities joined and split again; a part that is empty or holds the separator is an error."""
    from trivane.sources.scans import split_sample_id

    s = view(spark, d, "samples").select(F.concat_ws("|", "workflow", "model", "shot", F.col("task_id").cast("string")).alias("sample_id")).distinct()
    return split_sample_id(s)


@query("SELECT l_orderkey, l_linenumber, printf('%.1f%%', 100 * l_discount) AS discount, concat(l_returnflag, ' & ', l_linestatus, ' \\\\') AS row FROM lineitem WHERE l_linenumber = 1")
def s20_table_rows(spark, d):
    from trivane.sources import sinks

    li = view(spark, d, "lineitem").where("l_linenumber = 1")
    row = F.concat(F.concat_ws(" & ", "l_returnflag", "l_linestatus"), F.lit(r" \\"))
    return li.select("l_orderkey", "l_linenumber", sinks.percent(F.col("l_discount")).alias("discount"), row.alias("row"))


@query("SELECT p_partkey, v FROM (SELECT p_partkey, unnest(list_distinct([p_size - 1, p_size + 1, 0, 1, -1, 7])) AS v, p_size FROM part) WHERE v <> p_size")
def m09_boundary_values(spark, d):
    p = view(spark, d, "part")
    n = F.col("p_size")
    return p.select("p_partkey", F.explode(F.array_distinct(F.array(n - 1, n + 1, F.lit(0), F.lit(1), F.lit(-1), F.lit(7)))).alias("v"), "p_size").where("v <> p_size").drop("p_size")


@query("SELECT p_partkey, NOT (p_size > 10 AND p_size <= 12) AS all_hold, p_size > 11 AS some_hold FROM part")
def m07_finite_quantifiers(spark, d):
    """Quantifiers over the finite domain -1..10, implications decided in three values: forall i: i < 11 ==> i + n <> 21 or
    i + n <> 22 in that range, and exists i: i + 1 = 11 with n > 11; nothing of the text is ever evaluated as code."""
    domain = F.sequence(F.lit(-1), F.lit(10))
    n = F.col("p_size")
    every = F.forall(domain, lambda i: (i < 10) | ((i + n != 21) & (i + n != 22)))
    some = F.exists(domain, lambda i: (i + 1 == 11) & (n > 11))
    return view(spark, d, "part").select("p_partkey", every.alias("all_hold"), some.alias("some_hold"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN true WHEN p_size % 2 = 0 THEN NULL ELSE false END AS holds FROM part")
def m07_decided_conditions(spark, d):
    """Conditions decided on given inputs; a name without a value leaves them open unless the rest settles it."""
    P.ready(spark)
    even = F.col("p_size") % 2 == 0
    cond = F.when(even, "n >= 10 ==> missing > 0").otherwise("n < 10 || exists|i: int| i > 0 && i + n == 0")
    env = F.to_json(F.struct(F.col("p_size").alias("n")))
    return view(spark, d, "part").select("p_partkey", P.decided(cond, env).alias("holds"))


@query("""
SELECT p_partkey, operator, n FROM (SELECT p_partkey, unnest(['PRE_REMOVE', 'PRE_REFINE', 'PRE_RELAX', 'POST_REMOVE', 'POST_REFINE', 'POST_RELAX']) AS operator,
  unnest([CASE WHEN p_partkey % 3 < 2 THEN 3 ELSE 2 END, CASE WHEN p_partkey % 3 = 1 THEN 1 ELSE 0 END, 2, 2, CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 1 END, CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 1 END]) AS n FROM part) WHERE n > 0""")
def st28_variants(spark, d):
    """At most three controlled changes per operator."""
    v = spec_texts(spark, d).select("p_partkey", F.explode(P.variants("text", F.concat(F.lit("f"), F.col("p_partkey").cast("string")), F.lit("s"))).alias("v"))
    return v.groupBy("p_partkey", "v.operator").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("SELECT p_partkey, 'a::b,g' AS callees, CASE WHEN p_partkey % 2 = 0 THEN 'parameter_count' ELSE 'parameter_type,return_type' END AS issues FROM part")
def y02_y05_y21_binding(spark, d):
    P.ready(spark)
    gen = F.when(F.col("p_partkey") % 2 == 0, "fn f(x: u32) -> u8 { g(x); a::b(x) }").otherwise("fn f(x: u64, y: u8) -> u16 { g(a::b(x)) }")
    ref = F.lit("fn f(x: u32, y: u8) -> u8 { 0 }")
    x = view(spark, d, "part").select("p_partkey", gen.alias("gen"))
    return x.select("p_partkey", F.array_join(P.callees("gen"), ",").alias("callees"), F.array_join(P.binding_issues(ref, F.col("gen"), F.lit("f")), ",").alias("issues"))


@query("SELECT p_partkey, substr(sha256('{\"a\":[' || p_size || '],\"b\":\"é\"}'), 1, 16) AS key FROM part")
def h01_canonical_key(spark, d):
    """Equal values have equal keys, whatever the order of their keys."""
    P.ready(spark)
    js = F.when(F.col("p_partkey") % 2 == 0, F.format_string('{ "b": "é", "a": [ %d ] }', "p_size")).otherwise(F.format_string('{"a":[%d],"b":"é"}', "p_size"))
    return view(spark, d, "part").select("p_partkey", P.canonical_key(js).alias("key"))


@query("SELECT p_partkey, CASE WHEN p_size = 1 OR p_size = 2 THEN 5 ELSE 6 END - CASE WHEN p_size = 1 THEN 1 ELSE 0 END AS n FROM part")
def st33_candidate_cases(spark, d):
    P.ready(spark)
    js = F.format_string('[{"x": %d}]', "p_size")
    return view(spark, d, "part").select("p_partkey", F.size(P.candidate_inputs(js, F.lit(256))).alias("n"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'ok' WHEN p_partkey % 5 = 0 THEN 'not_available' WHEN p_size % 3 = 0 THEN 'ok' WHEN p_size % 2 = 0 THEN 'ok' ELSE 'pending' END AS status, CASE WHEN p_partkey % 4 = 0 THEN 0.0 WHEN p_partkey % 5 = 0 THEN NULL WHEN p_size % 3 = 0 THEN 1.0 WHEN p_size % 2 = 0 THEN 0.5 END::DOUBLE AS score FROM part")
def st25_judge_gate(spark, d):
    k, n = F.col("p_partkey"), F.col("p_size")
    gate = P.judge_gate(k % 4 != 0, k % 5 != 0, F.lit("h"), F.when(n % 3 == 0, "h").otherwise("o"), F.when(n % 2 == 0, 0.5))
    return view(spark, d, "part").select("p_partkey", gate.alias("g")).select("p_partkey", "g.status", "g.score")


@query("SELECT p_partkey, CASE WHEN p_size % 3 < 2 THEN true END AS holds, CASE p_size % 3 WHEN 0 THEN 'empty_consequent' WHEN 1 THEN 'true_consequent' END AS reason FROM part")
def st26_trivial_implication(spark, d):
    n = F.col("p_size") % 3
    after = F.when(n == 0, F.array(F.lit(" "))).when(n == 1, F.array(F.lit("true"), F.lit("true"))).otherwise(F.array(F.lit("x > 0")))
    return view(spark, d, "part").select("p_partkey", P.trivial_implication(after).alias("t")).select("p_partkey", "t.holds", "t.reason")


@query("""
WITH c AS (SELECT l_orderkey AS batch, l_linenumber AS id, l_linenumber * 10 AS s, l_linenumber * 10 + 6 AS e FROM lineitem GROUP BY ALL), d AS (SELECT l_orderkey AS batch, l_linenumber * 10 + l_partkey % 8 AS line FROM lineitem WHERE l_returnflag = 'R'),
m AS (SELECT d.batch, d.line, c.id FROM d LEFT JOIN c ON c.batch = d.batch AND d.line BETWEEN c.s AND c.e), b AS (SELECT batch, bool_or(id IS NULL) AS lost FROM m GROUP BY batch)
SELECT c.batch, c.id, CASE WHEN coalesce(b.lost, false) THEN NULL ELSE NOT EXISTS (SELECT 1 FROM m WHERE m.batch = c.batch AND m.id = c.id) END AS success FROM c LEFT JOIN b ON b.batch = c.batch""")
def y07_batch_results(spark, d):
    """Diagnostics mapped back to cases by line; one that no case holds leaves its whole batch open."""
    from trivane.operators.joins import batch_results

    li = view(spark, d, "lineitem")
    n = F.col("l_linenumber").cast("long")
    cases = li.select(F.col("l_orderkey").alias("batch"), F.col("l_linenumber").alias("id"), (n * 10).alias("start"), (n * 10 + 6).alias("end")).distinct()
    diag = li.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("batch"), (n * 10 + F.col("l_partkey") % 8).alias("line"))
    return batch_results(cases, diag, "batch", "id").select("batch", "id", "success")

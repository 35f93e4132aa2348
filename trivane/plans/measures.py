"""One query for each metric of a specification against a reference (X1, ST16-ST24), over evidence from the tables: samples give
stages and verdicts, cases give outcomes, turns of conversations give texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivane.functions import parsing as P
from trivane.functions import registry
from trivane.functions.metrics import MEASURES, removal_plan, satisfiability_items
from trivane.plans.programs import FUNCTIONS, WORDS, number, program, turn_pairs, turns, words_of_turns
from trivane.plans.registry import QUERIES, query
from trivane.views import view

DIRECTIONS = {"at_least": ("pre_ref_to_gen", "post_gen_to_ref"), "at_most": ("pre_gen_to_ref", "post_ref_to_gen")}
CLAUSES = {"pre_reliability": "io_correct", "pre_completeness": "io_wrong", "post_reliability": "io_invalid"}


def evidence(spark, d) -> DataFrame:
    """Every sample against a reference that passes everything."""
    c = view(spark, d, "cases").groupBy("sample_id").agg(F.collect_list(F.struct("kind", "state", "amount")).alias("c"))
    s = view(spark, d, "samples").join(c, "sample_id", "left").withColumn("c", F.coalesce("c", F.expr("cast(array() AS array<struct<kind:string,state:string,amount:bigint>>)")))
    verdict = lambda x: F.when(x == "passed", True).when(x == "failed", False)
    direction = lambda x: F.when(F.col(x) == "valid", True).when(F.col(x) == "invalid", False)
    probe = lambda x: F.when(F.col(x) == "unfavorable", True).when(F.col(x) == "favorable", False)
    of = lambda kind: F.filter("c", lambda x: x["kind"] == kind)
    own = {
        "text": F.when(F.col("sample_id") % 7 == 0, "same").otherwise("own"),
        "frontend": F.when(~F.col("eligible"), "timeout").when(F.col("stage") == "parse_failed", "parse_error").when(F.col("stage") == "frontend_failed", "type_error").otherwise("ok"),
        "verified": F.when(F.col("stage") == "accepted", True).when(F.col("stage") == "proof_failed", False),
        "seconds": F.col("quality") / 100,
        "pre_false": probe("pre_false"),
        "post_true": probe("post_true"),
        **{k: F.array(direction(a) & direction(b)) for k, (a, b) in DIRECTIONS.items()},
        **{k: F.transform(of(kind), lambda x: verdict(x["state"])) for k, kind in CLAUSES.items()},
        "post_completeness": F.transform("c", lambda x: verdict(x["state"])),
        **{k: F.transform(of(k), lambda x: x["state"]) for k in ("io_correct", "io_wrong", "io_invalid")},
        "mutants": F.transform("c", lambda x: F.when(x["state"] == "passed", "killed").when(x["state"] == "failed", "survived").when(x["amount"] % 2 == 0, "unknown").otherwise("invalid_mutant")),
        "removals": F.transform("c", lambda x: F.when(x["state"] == "passed", "removed").when(x["state"] == "failed", "necessary").otherwise("unknown")),
        "judged": F.col("redundancy") / 100,
        "judged_code": F.col("quality") / 100,
    }
    yes, passed = F.array(F.lit(True)), F.array(F.lit("passed"))
    best = {k: yes for k in (*DIRECTIONS, *CLAUSES, "post_completeness")} | {k: passed for k in ("io_correct", "io_wrong", "io_invalid")}
    best |= {"text": F.lit("same"), "frontend": F.when(F.col("sample_id") % 5 == 0, "type_error").otherwise("ok"), "verified": F.lit(True), "seconds": F.lit(0.25), "pre_false": F.lit(False), "post_true": F.lit(False), "mutants": F.array(F.lit("killed")), "removals": F.array(F.lit("necessary"))}
    return s.select("sample_id", registry.side(own).alias("generated"), registry.side(best).alias("ground"))


_V = "CASE {x} WHEN 'valid' THEN true WHEN 'invalid' THEN false END"
_SIDES = f"""ev AS (SELECT s.sample_id, s.stage, s.eligible, s.quality, s.redundancy, s.pre_false, s.post_true,
  {", ".join(f"({_V.format(x=a)}) AND ({_V.format(x=b)}) AS {k}" for k, (a, b) in DIRECTIONS.items())},
  CASE WHEN NOT eligible THEN 'timeout' WHEN stage = 'parse_failed' THEN 'parse_error' WHEN stage = 'frontend_failed' THEN 'type_error' ELSE 'ok' END AS frontend,
  CASE stage WHEN 'accepted' THEN true WHEN 'proof_failed' THEN false END AS verified FROM samples s),
n AS (SELECT sample_id, {", ".join(f"count(*) FILTER (state = '{st}' AND kind = '{k}') AS {k}_{st}" for k in ("io_correct", "io_wrong", "io_invalid") for st in ("passed", "failed", "unresolved"))},
  count(*) FILTER (state = 'passed') AS yes, count(*) FILTER (state = 'failed') AS no, count(*) FILTER (state = 'unresolved') AS open, count(*) FILTER (state = 'unresolved' AND amount % 2 = 0) AS unknown FROM cases GROUP BY sample_id),
e AS (SELECT ev.*, {", ".join(f"coalesce({c}, 0) AS {c}" for c in [f"{k}_{st}" for k in ("io_correct", "io_wrong", "io_invalid") for st in ("passed", "failed", "unresolved")] + ["yes", "no", "open", "unknown"])} FROM ev LEFT JOIN n ON ev.sample_id = n.sample_id)"""


def _decided(yes: str, no: str, open_: str) -> tuple[str, str]:
    return f"CASE WHEN {yes} + {no} + {open_} = 0 THEN 'not_available' WHEN {open_} = 0 THEN 'ok' ELSE 'partial' END", f"CAST({yes} AS DOUBLE) / nullif({yes} + {no}, 0)"


def _flag(x: str) -> tuple[str, str]:
    return f"CASE WHEN {x} IS NULL THEN 'partial' ELSE 'ok' END", f"CAST(CAST({x} AS INT) AS DOUBLE)"


def _io(k: str) -> tuple[str, str]:
    p, f, u = (f"{k}_{x}" for x in ("passed", "failed", "unresolved"))
    return f"CASE WHEN {p} + {f} + {u} = 0 THEN 'not_available' WHEN {u} > 0 THEN 'partial' ELSE 'ok' END", f"CAST({p} AS DOUBLE) / nullif({p} + {f} + {u}, 0)"


def _front(passes: str) -> tuple[str, str]:
    return "CASE WHEN frontend = 'timeout' THEN 'timeout' ELSE 'ok' END", f"CASE WHEN frontend <> 'timeout' THEN CAST(CAST({passes} AS INT) AS DOUBLE) END"


def _judge(score: str) -> tuple[str, str]:
    gate = "WHEN frontend <> 'ok' THEN {a} WHEN sample_id % 5 = 0 THEN {b} WHEN sample_id % 7 = 0 THEN {c}"
    return f"CASE {gate.format(a=chr(39) + 'ok' + chr(39), b=chr(39) + 'not_available' + chr(39), c=chr(39) + 'ok' + chr(39))} WHEN {score} IS NULL THEN 'pending' ELSE 'ok' END", f"CASE {gate.format(a='0.0', b='NULL', c='1.0')} ELSE CAST({score} AS DOUBLE) / 100 END"


_SEEN = "(CAST(pre_false <> 'other' AS INT) + CAST(post_true <> 'other' AS INT))"
_SCORED = "(yes + no + unknown)"
#: Per metric the SQL of its status and score, and the score of the reference.
SQL: dict[str, tuple[str, str, str]] = {
    "trivial_spec_ratio": (f"CASE {_SEEN} WHEN 0 THEN 'not_available' WHEN 1 THEN 'partial' ELSE 'ok' END", f"CAST(CAST(pre_false = 'unfavorable' AS INT) + CAST(post_true = 'unfavorable' AS INT) AS DOUBLE) / nullif({_SEEN}, 0)", "0.0"),
    "llm_as_judge_intent_consistency": (*_judge("redundancy"), "CASE WHEN sample_id % 5 = 0 THEN 0.0 ELSE 1.0 END"),
    "llm_as_judge_spec_code_intent_consistency": (*_judge("quality"), "CASE WHEN sample_id % 5 = 0 THEN 0.0 ELSE 1.0 END"),
    "parse_rate": (*_front("frontend <> 'parse_error'"), "1.0"),
    "type_check_rate": (*_front("frontend = 'ok'"), "CASE WHEN sample_id % 5 = 0 THEN 0.0 ELSE 1.0 END"),
    "verification_pass_rate": ("CASE WHEN verified IS NULL THEN 'not_available' ELSE 'ok' END", "CAST(CAST(verified AS INT) AS DOUBLE)", "1.0"),
    "verification_time": ("CASE WHEN quality IS NULL THEN 'not_available' ELSE 'ok' END", "CAST(quality AS DOUBLE) / 100", "0.25"),
    "proportion_at_least_gt": (*_flag("at_least"), "1.0"),
    "proportion_at_most_gt": (*_flag("at_most"), "1.0"),
    "precondition_clause_reliability_rate": (*_decided("io_correct_passed", "io_correct_failed", "io_correct_unresolved"), "1.0"),
    "precondition_clause_completeness_rate": (*_decided("io_wrong_passed", "io_wrong_failed", "io_wrong_unresolved"), "1.0"),
    "postcondition_clause_reliability_rate": (*_decided("io_invalid_passed", "io_invalid_failed", "io_invalid_unresolved"), "1.0"),
    "postcondition_clause_completeness_rate": (*_decided("yes", "no", "open"), "1.0"),
    "correct_io_pass_rate": (*_io("io_correct"), "1.0"),
    "wrong_io_reject_rate": (*_io("io_wrong"), "1.0"),
    "invalid_test_filtering_rate": (*_io("io_invalid"), "1.0"),
    "mutation_kill_rate": (
        f"CASE WHEN verified IS NULL THEN 'not_available' WHEN NOT verified THEN 'skipped' WHEN yes + no + open = 0 THEN 'no_mutants' WHEN {_SCORED} = 0 THEN 'no_valid_mutants' WHEN open > 0 THEN 'partial' ELSE 'ok' END",
        f"CASE WHEN verified THEN CAST(yes AS DOUBLE) / nullif({_SCORED}, 0) END",
        "1.0",
    ),
    "spec_redundancy_rate": (
        "CASE WHEN verified IS NULL THEN 'not_available' WHEN NOT verified THEN 'skipped' WHEN yes + no + open = 0 THEN 'no_testable_clauses' WHEN open > 0 THEN 'partial' ELSE 'ok' END",
        "CASE WHEN verified THEN coalesce(CAST(yes AS DOUBLE) / nullif(yes + no + open, 0), 0.0) END",
        "0.0",
    ),
}


def _register(name: str) -> None:
    status, score, ground = SQL[name]
    sql = f"WITH {_SIDES}, m AS (SELECT sample_id, {status} AS status, {score} AS score, CAST({ground} AS DOUBLE) AS ground FROM e) SELECT sample_id, '{name}' AS metric, status, score, ground, score - ground AS delta FROM m"

    @query(sql, name=f"x01_{name}")
    def run(spark, d):
        return registry.measured(evidence(spark, d), "sample_id", [name])


for _name in SQL:
    _register(_name)


def text_pairs(spark, d) -> DataFrame:
    """The program of every turn against that of the turn before it."""
    pairs = turn_pairs(words_of_turns(spark, d))
    return pairs.select("item_id", registry.side({"text": program(FUNCTIONS)}).alias("generated"), registry.side({"text": program(FUNCTIONS, ws="before")}).alias("ground"))


# What a statement of FUNCTIONS adds to each scope, as tokens behind its kind.
_TOKENS = {
    "full": {0: "['requires', 'x', '<', '#', 'requires', 'x', '>', '1']", 1: "['ensures', 'true', 'assert', 'x', '==', '#']", 2: "['spec_fn', 'spec', 'fn', 'h#', '(', ')', '->', 'int', '{', '#', '}']", 3: "['invariant', 'i', '<', '#', 'invariant', 'j', 'decreases', '#']"},
    "spec_only": {0: "['requires', 'x', '<', '#', 'requires', 'x', '>', '1']", 1: "['ensures', 'true']", 2: "['spec_fn', 'spec', 'fn', 'h#', '(', ')', '->', 'int', '{', '#', '}']"},
    "proof": {1: "['assert', 'x', '==', '#']", 3: "['invariant', 'i', '<', '#', 'invariant', 'j', 'decreases', '#']"},
}
_LOG = "ln(CASE WHEN m{k} = 0 THEN 1 / (pow(2, z{k}) * (c - {j})) ELSE m{k} / (c - {j}) END)"


def _bleu_sql(scope: str, name: str) -> str:
    list_of = " ".join(f"WHEN {k} THEN list_transform({v}, lambda t: replace(t, '#', CAST(x AS VARCHAR)))" for k, v in _TOKENS[scope].items())
    m = ", ".join(f"CAST(coalesce(sum(least(x, y)) FILTER (n = {k}), 0) AS DOUBLE) AS m{k}" for k in range(1, 5))
    z = ", ".join(f"{' + '.join(f'CAST(m{j} = 0 AS INT)' for j in range(1, k + 1))} AS z{k}" for k in range(1, 5))
    logs = " + ".join(f"CASE WHEN c >= {k} THEN {_LOG.format(k=k, j=k - 1)} ELSE 0 END" for k in range(1, 5))
    grams = lambda side: f"unnest(list_transform(range(1, len({side}) - n + 2), lambda i: array_to_string({side}[i:i + n - 1], ' ')))"
    return f"""WITH {WORDS}, l AS (SELECT item_id, split_part(item_id, '.', 1) AS conv, CAST(split_part(item_id, '.', 2) AS INT) AS turn, flatten(list_transform(n, lambda x: CASE x % 4 {list_of} ELSE CAST([] AS VARCHAR[]) END)) AS t FROM tk),
pr AS (SELECT a.item_id, a.t AS c, b.t AS r FROM l a JOIN l b ON a.conv = b.conv AND a.turn = b.turn + 1),
g AS (SELECT item_id, true AS c, n, {grams('c')} AS g FROM pr, range(1, 5) k(n) UNION ALL SELECT item_id, false, n, {grams('r')} FROM pr, range(1, 5) k(n)),
k AS (SELECT item_id, n, g, count(*) FILTER (c) AS x, count(*) FILTER (NOT c) AS y FROM g GROUP BY ALL), m AS (SELECT item_id, {m} FROM k GROUP BY ALL),
s AS (SELECT pr.item_id, coalesce(m1, 0) AS m1, coalesce(m2, 0) AS m2, coalesce(m3, 0) AS m3, coalesce(m4, 0) AS m4, len(c) AS c, len(r) AS r FROM pr LEFT JOIN m ON m.item_id = pr.item_id),
v AS (SELECT *, {z} FROM s),
b AS (SELECT item_id, CASE WHEN c = 0 OR r = 0 THEN CAST(c = 0 AND r = 0 AS INT) WHEN m1 = 0 THEN 0 ELSE least(1, CASE WHEN c < r THEN exp(1 - CAST(r AS DOUBLE) / c) ELSE 1 END * exp(({logs}) / least(c, 4))) END AS score FROM v)
SELECT item_id, '{name}' AS metric, 'ok' AS status, round(CAST(score AS DOUBLE), 9) AS score, 1.0::DOUBLE AS ground, round(CAST(score AS DOUBLE) - 1, 9) AS delta FROM b"""


def _register_text(name: str, sql: str) -> None:
    @query(sql, name=f"x01_{name}")
    def run(spark, d):
        out = registry.measured(text_pairs(spark, d), "item_id", [name])
        return out.withColumn("score", F.round("score", 9)).withColumn("delta", F.round("delta", 9))


for _scope, _name in (("full", "textual_similarity"), ("spec_only", "textual_similarity_spec_only"), ("proof", "textual_similarity_proof")):
    _register_text(_name, _bleu_sql(_scope, _name))

# Nodes that a statement of FUNCTIONS adds to each scope.
for _name, _nodes in (("spec_size_complexity", (6, 4, 1, 5)), ("spec_size_complexity_spec_only", (6, 1, 1, 0)), ("spec_size_complexity_proof", (0, 3, 0, 5))):
    _sum = " + ".join(f"{x} * {number(k, 4)}" for k, x in enumerate(_nodes))
    _register_text(
        _name,
        f"""WITH {WORDS}, s AS (SELECT item_id, split_part(item_id, '.', 1) AS conv, CAST(split_part(item_id, '.', 2) AS INT) AS turn, CAST({_sum} AS DOUBLE) AS nodes FROM tk)
SELECT a.item_id, '{_name}' AS metric, 'ok' AS status, a.nodes AS score, b.nodes AS ground, a.nodes - b.nodes AS delta FROM s a JOIN s b ON a.conv = b.conv AND a.turn = b.turn + 1""",
    )


@query("""WITH """ + _SIDES + """, m AS (SELECT """ + SQL["wrong_io_reject_rate"][1] + """ AS a, """ + SQL["mutation_kill_rate"][1] + """ AS b FROM e)
SELECT 'wrong_io_reject_rate' AS metric, count(*) AS pairs, count(a) AS scored, round(avg(a), 9) AS mean, CAST(count(a) AS DOUBLE) / count(*) AS coverage FROM m UNION ALL SELECT 'mutation_kill_rate', count(*), count(b), round(avg(b), 9), CAST(count(b) AS DOUBLE) / count(*) FROM m""")
def x03_x08_summary(spark, d):
    """Several metrics evaluated in one pass and summed up, under older names too."""
    out = registry.summary(registry.measured(evidence(spark, d), "sample_id", ["wrong_io_reject_rate", "tool_mutation_kill_rate"]))
    return out.withColumn("mean", F.round("mean", 9))


# Categories and directions of the metrics that evidence of samples decides.
_CATALOG = """
trivial_spec_ratio spec_triviality lower
llm_as_judge_intent_consistency intent_consistency higher
llm_as_judge_spec_code_intent_consistency intent_consistency higher
parse_rate formal_validity higher
type_check_rate formal_validity higher
verification_pass_rate formal_validity higher
verification_time time_efficiency lower
proportion_at_least_gt spec_reliability higher
proportion_at_most_gt spec_completeness higher
precondition_clause_reliability_rate spec_reliability higher
precondition_clause_completeness_rate spec_completeness higher
postcondition_clause_reliability_rate spec_reliability higher
postcondition_clause_completeness_rate spec_completeness higher
correct_io_pass_rate io_testing higher
wrong_io_reject_rate io_testing higher
invalid_test_filtering_rate io_testing higher
mutation_kill_rate robustness higher
spec_redundancy_rate simplicity lower
"""
_KNOWN = [line.split() for line in _CATALOG.strip().splitlines()]


@query(f"WITH {_SIDES} " + " UNION ALL ".join(f"SELECT '{n}' AS name, '{c}' AS category, '{r}' AS direction, count(*) AS pairs, count({SQL[n][1]}) AS scored FROM e" for n, c, r in _KNOWN))
def x02_catalog(spark, d):
    """The catalog of metrics, with how many samples there are and how many of them each metric scores."""
    found = registry.summary(registry.measured(evidence(spark, d), "sample_id", list(SQL))).select(F.col("metric").alias("name"), "pairs", "scored")
    return registry.catalog(spark).join(found, "name").select("name", "category", "direction", "pairs", "scored")


@query(f"WITH {WORDS} SELECT item_id, {number(1, 4)} + 3 * {number(3, 4)} AS candidates, greatest(60, 3 * ({number(1, 4)} + 3 * {number(3, 4)}) + 4) AS attempts, CASE WHEN {number(1, 4)} + {number(3, 4)} > 0 THEN CASE list_filter(n, lambda x: x % 4 IN (1, 3))[1] % 4 WHEN 1 THEN 'assert' ELSE 'invariant' END END AS first_kind FROM tk")
def st24_removal_plan(spark, d):
    """The deletions that a prover is asked about: clauses of proofs in order of place, and how many are tried at most."""
    from trivane.functions.metrics import attempts

    plan = lambda c: P.applied(lambda t: (lambda p: {"n": len(p), "attempts": attempts(len(p)), "first": p[0]["kind"] if p else None})(removal_plan(t)), "struct<n:long,attempts:long,first:string>", c)
    t = turns(spark, d).select("item_id", plan(program(FUNCTIONS)).alias("p"))
    return t.select("item_id", F.col("p.n").alias("candidates"), "p.attempts", F.col("p.first").alias("first_kind"))


@query(f"WITH {WORDS} SELECT item_id, {number(0, 4)} AS functions, len(list_filter(n, lambda x: x % 4 = 0)) AS open, len(list_filter(n, lambda x: x % 4 = 1)) AS refuted, len(list_filter(n, lambda x: x % 4 = 2)) AS settled FROM tk")
def st27_satisfiability_items(spark, d):
    """Preconditions by what is known of them before a solver is asked: open, false on their face, true whatever the values."""
    text = program(("fn f#(x: u32) requires x < #, x > 1 { }", "fn g#(x: u32) requires x < 1, x > # { }", "fn h#(x: u32) requires x >= x, true { }", "fn k#(x: u32) ensures x > # { }"))
    t = turns(spark, d).withColumn("s", P.applied(lambda t: [x["satisfiable"] for x in satisfiability_items(t)], "array<boolean>", text))
    count = lambda f: F.size(F.filter("s", f)).cast("long")
    opened = count(lambda x: x.isNull())
    return t.select("item_id", opened.alias("functions"), opened.alias("open"), count(lambda x: ~x).alias("refuted"), count(lambda x: x).alias("settled"))


assert all(f"x01_{n}" in QUERIES for n in MEASURES)

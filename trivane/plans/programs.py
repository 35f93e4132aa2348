"""Queries of text functions over programs made of real texts: every word of a conversation's turn becomes a statement chosen
by the word's length, so that SQL can count from the words what the functions must find in the program.

In a statement # stands for the word's length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trivane.functions import parsing as P
from trivane.plans.registry import query
from trivane.session import dealt
from trivane.views import view

#: item_id and n, the lengths of the words of a turn.
WORDS = "tk AS (SELECT conv_id || '.' || turn AS item_id, list_transform(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> ''), lambda x: length(x)) AS n FROM conversations)"


def number(k: int, of: int) -> str:
    """SQL: how many words give statement k."""
    return f"len(list_filter(n, lambda x: x % {of} = {k}))"


def words_of_turns(spark, d) -> DataFrame:
    P.ready(spark)
    return view(spark, d, "conversations").select(F.concat_ws(".", "conv_id", "turn").alias("item_id"), P.words(F.coalesce("text", F.lit(""))).alias("ws"))


def turns(spark, d) -> DataFrame:
    """Every turn's words; parsing the program that they make is dear, so the turns are dealt out first."""
    return dealt(words_of_turns(spark, d))


def turn_pairs(t: DataFrame) -> DataFrame:
    """(item_id, ws, before): every turn with the words of the turn before it, after each other in stretches of 16 turns, so
    that a task that has read a text as the one side finds it again as the other."""
    t = t.select("item_id", F.split_part("item_id", F.lit("."), F.lit(1)).alias("c"), F.split_part("item_id", F.lit("."), F.lit(2)).cast("int").alias("t"), "ws")
    both = t.join(t.select("c", (F.col("t") + 1).alias("t"), F.col("ws").alias("before")), ["c", "t"])
    return dealt(both, F.col("c"), F.floor(F.col("t") / 16)).sortWithinPartitions("c", "t").select("item_id", "ws", "before")


def program(statements: tuple[str, ...], head: str = "", tail: str = "", sep: str = "\n", ws: str = "ws") -> Column:
    known = F.array(*[F.lit(s) for s in statements])
    one = lambda w: F.replace(F.element_at(known, F.length(w) % len(statements) + 1), F.lit("#"), F.length(w).cast("string"))
    return F.concat(F.lit(head), F.array_join(F.transform(ws, one), sep), F.lit(tail))


FUNCTIONS = (
    "fn f#(x: u32) requires x < #, x > 1 { }",
    "fn g#(x: u32, y: u8) -> bool ensures true { assert(x == #); }",
    "spec fn h#() -> int { # } // fn c(a: u8)",
    "fn w#() { while c invariant i < #, j decreases # { } }",
)
EDITS = ("if a < # { }", "b = a * c;", "c = a && b;", "d = true;", "e = p;", "assert(a <= #);")
CLAUSES = ("true", "x >= x", "a + 0 == a", "p ==> p", "x < #", "v.len() >= 0", "b || !b", "q ==> true", "forall|i: int| i == i", "x && true")
CALLS = ("assume( false );", "todo!()", "// admit()", "fn a#() {}", "admit()", "assume(x > #);", "/* axiom */")


@query(f"WITH {WORDS} SELECT item_id, {number(0, 5)} + 3 * {number(1, 5)} + {number(3, 5)} + 6 * {number(4, 5)} AS n, CAST(list_sum(list_transform(n, lambda x: CASE x % 5 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 3 THEN 1 WHEN 4 THEN 6 ELSE 0 END)) AS BIGINT) AS normalized FROM tk WHERE len(n) > 0")
def f02_f03_tokens(spark, d):
    """Tokens, and whether each lies where its span says; the normalised text is as many words."""
    t = turns(spark, d).where("size(ws) > 0").withColumn("text", program(("a#b", "x <= #", "/* # */", "'\"'", "v[#]==>'c'"), sep=" "))
    t = t.withColumn("s", P.token_spans("text"))
    ok = F.forall("s", lambda x: F.substr("text", x["start"] + 1, x["end"] - x["start"]) == x["text"])
    return t.select("item_id", F.when(ok, F.size("s")).otherwise(-1).cast("long").alias("n"), F.size(P.words(P.normalized("text"))).cast("long").alias("normalized"))


@query(f"WITH {WORDS}, c AS (SELECT item_id, unnest(['requires', 'ensures', 'assert', 'invariant', 'decreases']) AS kind, unnest([2 * {number(0, 4)}, {number(1, 4)}, {number(1, 4)}, 2 * {number(3, 4)}, {number(3, 4)}]) AS n FROM tk) SELECT item_id, kind, n FROM c WHERE n > 0")
def f08_clauses(spark, d):
    c = turns(spark, d).select("item_id", F.explode(P.clauses(program(FUNCTIONS))).alias("c"))
    return c.groupBy("item_id", F.col("c.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {WORDS} SELECT item_id, scope, CASE scope WHEN 'full' THEN 2 * {number(0, 4)} + 2 * {number(1, 4)} + {number(2, 4)} + 3 * {number(3, 4)} WHEN 'spec_only' THEN 2 * {number(0, 4)} + {number(1, 4)} + {number(2, 4)} ELSE {number(1, 4)} + 3 * {number(3, 4)} END AS n FROM tk, (VALUES ('full'), ('spec_only'), ('proof')) s(scope)")
def f09_st16_text_items(spark, d):
    """What each scope compares of a text."""
    t = turns(spark, d).withColumn("scope", F.explode(F.array(F.lit("full"), F.lit("spec_only"), F.lit("proof"))))
    return t.select("item_id", "scope", F.size(P.text_items(program(FUNCTIONS), "scope")).cast("long").alias("n"))


@query(f"""WITH {WORDS} SELECT item_id, {number(0, 4)} + {number(1, 4)} + {number(3, 4)} AS exec, {number(2, 4)} AS spec, {number(0, 4)} + 2 * {number(1, 4)} AS parameters,
  list_last(list_transform(list_filter(n, lambda x: x % 4 < 2), lambda x: CASE x % 4 WHEN 0 THEN 'f' ELSE 'g' END || x)) AS with_contract FROM tk WHERE {number(0, 4)} + {number(1, 4)} > 0""")
def f10_f11_y01_functions(spark, d):
    """Functions by mode, their parameters, and the target: the last executable function with a contract."""
    t = turns(spark, d).withColumn("text", program(FUNCTIONS)).where(F.exists("ws", lambda w: F.length(w) % 4 < 2))
    t = t.select("item_id", P.functions("text").alias("f"), P.target("text", F.lit("no_such"), F.lit(None).cast("string")).alias("with_contract"))
    mode = lambda m: F.size(F.filter("f", lambda x: x["mode"] == m)).cast("long").alias(m)
    parameters = F.aggregate("f", F.lit(0), lambda a, x: a + F.regexp_count(F.split_part(x["signature"], F.lit("->"), F.lit(1)), F.lit(":")))
    return t.select("item_id", mode("exec"), mode("spec"), parameters.cast("long").alias("parameters"), "with_contract")


@query(f"WITH {WORDS}, b AS (SELECT item_id, unnest(['assume_false', 'unimplemented', 'admit', 'assume_any']) AS kind, unnest([{number(0, 7)}, {number(1, 7)}, {number(4, 7)}, {number(5, 7)}]) AS n FROM tk) SELECT item_id, kind, n FROM b WHERE n > 0")
def f15_blacklist(spark, d):
    b = turns(spark, d).select("item_id", F.explode(P.blacklisted(program(CALLS))).alias("b"))
    return b.groupBy("item_id", F.col("b.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {WORDS}, m AS (SELECT *, list_filter(n, lambda x: x % 3 = 0) AS f FROM tk), l AS (SELECT *, list_max(list_transform(f, lambda x: length(CAST(x AS VARCHAR)))) AS longest FROM m)
SELECT item_id, list_filter(f, lambda x: length(CAST(x AS VARCHAR)) = longest)[1] || chr(10) AS code, '{{"k": [' || list_filter(n, lambda x: x % 3 = 1)[1] || ', "}}"]}}' AS js FROM l WHERE len(f) > 0""")
def f17_f18_salvage(spark, d):
    """The longest fenced block, and the first balanced object."""
    t = turns(spark, d).where(F.exists("ws", lambda w: F.length(w) % 3 == 0)).withColumn("text", program(("```rust\n#\n```", '{"k": [#, "}"]}', "so ] is }")))
    return t.select("item_id", P.fenced(F.col("text")).alias("code"), P.json_slice("text").alias("js"))


@query(f"WITH {WORDS} SELECT item_id, left(array_to_string(list_transform(list_filter(n, lambda x: x % 4 = 0), lambda x: 'let x = ' || x || ';'), chr(10)), 8000) AS runs FROM tk")
def f19_views(spark, d):
    """What runs of a body: assertions, proof blocks and comments are gone."""
    return turns(spark, d).select("item_id", P.executable_view(program(("let x = #;", "assert(x == #);", "// c #", "proof { lemma(#); }"))).alias("runs"))


@query("SELECT p_partkey, list_sort(list_concat(string_split(p_type, ' '), CASE WHEN list_contains(string_split(p_type, ' '), p_brand) THEN [] ELSE [p_brand] END || ['end'])) AS lines FROM part")
def f20_merged_lines(spark, d):
    """Lines of two versions, common ones once; the function header that the second changes is replaced by it."""
    P.ready(spark)
    p = view(spark, d, "part").withColumn("w", F.split("p_type", " "))
    a = F.concat(F.lit("pub fn f(a: u8) {\n"), F.array_join("w", "\n"))
    b = F.concat(F.lit("pub fn f(b: u8) {\n"), F.col("w")[0], F.lit("\n// new\n"), F.col("p_brand"), F.lit("\nend"))
    lines = F.filter(F.split(P.merged_lines(a, b), "\n"), lambda x: x != "pub fn f(b: u8) {")
    return p.select("p_partkey", F.array_sort(lines).alias("lines"))


@query(f"""WITH {WORDS}, r AS (SELECT item_id, unnest(['literal_true', 'self_comparison', 'arithmetic_identity', 'implication_self', 'nonneg_tautology', 'excluded_middle', 'low_information_implication', 'quantifier_trivial_body']) AS reason,
  unnest([{number(0, 10)}, {number(1, 10)}, {number(2, 10)}, {number(3, 10)}, {number(5, 10)}, {number(6, 10)}, {number(7, 10)}, {number(8, 10)}]) AS n FROM tk) SELECT item_id, reason, n FROM r WHERE n > 0""")
def m05_y22_tautologies(spark, d):
    c = turns(spark, d).select("item_id", F.explode(P.clauses(program(CLAUSES, "fn f() requires ", " { }", ", "))).alias("c"))
    return c.select("item_id", P.tautology("c.text").alias("reason")).where("reason IS NOT NULL").groupBy("item_id", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {WORDS}, b AS (SELECT item_id, list_max(list_filter(n, lambda x: x % 2 = 0)) AS lo, list_min(list_filter(n, lambda x: x % 2 = 1)) AS hi FROM tk)
SELECT item_id, CASE WHEN lo > hi THEN 'inconsistent_bounds:x' ELSE '' END AS finding FROM b""")
def m05_contradictions(spark, d):
    """Bounds that a turn's words put on a name, even lengths from below and odd ones from above."""
    return turns(spark, d).select("item_id", F.array_join(P.contradictions(program(("x >= #", "x < #"), sep=" && ")), ",").alias("finding"))


@query(f"WITH {WORDS} SELECT item_id, 3 * {number(0, 3)} + 5 * {number(1, 3)} + 6 * {number(2, 3)} + len(n) - 1 AS nodes, {number(2, 3)} AS quantifiers FROM tk WHERE len(n) > 1")
def m06_structure(spark, d):
    s = turns(spark, d).where("size(ws) > 1").select("item_id", P.structure(program(("a < #", "a + b < #", "(forall|i: int| p ==> i == #)"), sep=" && ")).alias("s"))
    return s.select("item_id", F.col("s.nodes").cast("long").alias("nodes"), F.col("s.quantifiers").cast("long").alias("quantifiers"))


@query(f"WITH {WORDS} SELECT item_id, len(list_filter(n, lambda x: x % 5 = 1 AND x * 100 > 255 OR x % 5 <> 1 AND x > 255)) = 0 AS ok FROM tk")
def m08_y11_typed_values(spark, d):
    """Printed values read as their type; one out of range is not ok."""
    from trivane.functions import specs

    ok = lambda c: P.applied(lambda t: specs.typed_value(t, "Vec<u8>")[0], "boolean", c)
    return turns(spark, d).select("item_id", ok(program(("#", "#00", " #", "# ", "#"), "[", "]", ", ")).alias("ok"))


@query(f"WITH {WORDS} SELECT item_id, 2 * {number(0, 4)} - 2 AS delta FROM tk")
def st17_structure_delta(spark, d):
    """Difference of a count between two sides: every text against one with two preconditions."""
    n = lambda c: F.size(F.filter(P.clauses(c), lambda x: x["kind"] == "requires"))
    base = F.lit("fn g(x: u32) requires x > 1, x < 9 { }")
    return turns(spark, d).select("item_id", (n(program(FUNCTIONS)) - n(base)).cast("long").alias("delta"))


@query(f"""WITH {WORDS}, m AS (SELECT item_id, unnest(['ROR', 'UOI_UOD', 'AOR', 'COR_LOR', 'BOUNDARY', 'SVR']) AS family, unnest([3 * {number(0, 6)}, {number(0, 6)}, 3 * {number(1, 6)}, {number(2, 6)}, {number(3, 6)}, {number(4, 6)}]) AS n FROM tk)
SELECT item_id, family, n FROM m WHERE n > 0""")
def st23_mutants(spark, d):
    m = turns(spark, d).select("item_id", F.explode(P.mutants(program(EDITS, "fn f(p: u8, q: u8) {\n", "\n}"))).alias("m"))
    return m.groupBy("item_id", F.col("m.family").alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {WORDS} SELECT item_id, {number(3, 4)} = 0 AS same FROM tk WHERE len(n) > 0")
def y06_alpha_equal(spark, d):
    """Definitions that differ in bound names alone are equal; those with another relation are not."""
    one = ("(forall|z: int| z > a + #)", "a > #", "(exists|z: int| z == a)", "a < #")
    two = ("(forall|y: int| y > b + #)", "b > #", "(exists|y: int| y == b)", "b <= #")
    full = lambda s, name: P.alpha_normalized(program(s, f"spec fn g({name}: int) -> bool {{ ", " }", " && "))
    return turns(spark, d).where("size(ws) > 0").select("item_id", (full(one, "a") == full(two, "b")).alias("same"))


@query(f"WITH {WORDS} SELECT item_id, metric, 'ok' AS status, CASE metric WHEN 'requires_count' THEN 2.0 * {number(0, 4)} ELSE 0.0 END::DOUBLE AS score, CASE metric WHEN 'requires_count' THEN 2.0 * {number(0, 4)} - 1 ELSE -1.0 END::DOUBLE AS delta FROM tk, (VALUES ('requires_count'), ('keyword_blacklist')) m(metric)")
def x01_x04_metrics(spark, d):
    """Registered metrics on two sides, with the difference of their scores; one under an older name."""
    from trivane.functions import registry

    t = turns(spark, d).withColumn("text", program(FUNCTIONS))
    other = F.lit("fn g(x: u32) requires x > 1 { admit() }")
    one = lambda n: t.select("item_id", F.lit(registry.metric(n).name).alias("metric"), registry.two_sided(n, F.col("text"), other).alias("m"))
    return one("requires_count").unionByName(one("blacklist")).select("item_id", "metric", "m.generated.status", "m.generated.score", "m.delta")


@query(f"WITH {WORDS}, d AS (SELECT item_id, list_distinct(n) AS n FROM tk) SELECT item_id, {number(0, 4)} AS structs, {number(1, 4)} AS aliases, {number(2, 4)} AS enums, CASE WHEN {number(0, 4)} > 0 THEN 'struct {{ a : u32 }}' END AS shape FROM d")
def y12_types(spark, d):
    """Types by name, the kinds of their definitions and the shape of the structs."""
    from trivane.functions import specs

    m = lambda c: P.applied(lambda t: list(specs.types(t).items()), "map<string,string>", c)
    t = turns(spark, d).select("item_id", m(program(("struct S# { a: u32 }", "type T# = Vec<u8>;", "enum E# { A, B }", "fn f#() { }"))).alias("m"))
    of = lambda kind: F.filter(F.map_values("m"), lambda x: x.startswith(kind))
    count = lambda kind: F.size(of(kind)).cast("long")
    return t.select("item_id", count("struct ").alias("structs"), count("type ").alias("aliases"), count("enum ").alias("enums"), F.array_min(of("struct ")).alias("shape"))


# Features that the clauses of a statement of FUNCTIONS have: how often, by statement.
_FEATURES = {"kr": (2, 0, 0), "x": (2, 1, 0), "lt": (1, 0, 1), "gt": (1, 0, 0), "ke": (0, 1, 0), "true": (0, 1, 0), "ka": (0, 1, 0), "eq": (0, 1, 0), "ki": (0, 0, 2), "i": (0, 0, 1), "j": (0, 0, 1), "kd": (0, 0, 1)}
_HAS = lambda side: ", ".join(f"{a} * {side}0 + {b} * {side}1 + {c} * {side}3" for a, b, c in _FEATURES.values())


@query(f"""WITH {WORDS}, v AS (SELECT split_part(item_id, '.', 1) AS conv, CAST(split_part(item_id, '.', 2) AS INT) AS turn, item_id, {number(0, 4)} AS v0, {number(1, 4)} AS v1, {number(3, 4)} AS v3 FROM tk),
p AS (SELECT b.item_id, a.v0 AS a0, a.v1 AS a1, a.v3 AS a3, b.v0 AS b0, b.v1 AS b1, b.v3 AS b3 FROM v a JOIN v b ON a.conv = b.conv AND b.turn = a.turn + 1 WHERE a.v0 + a.v1 + a.v3 > 0 AND b.v0 + b.v1 + b.v3 > 0),
f AS (SELECT item_id, unnest([{_HAS('a')}]) AS x, unnest([{_HAS('b')}]) AS y FROM p)
SELECT item_id, CAST(sum(y) AS BIGINT) AS "right", round(sum(least(x, y)) / CAST(sum(y) AS DOUBLE), 9) AS recall FROM f GROUP BY item_id""")
def st15_st16_key_features(spark, d):
    """Feature recall of a turn's program by that of the turn before it: clause kinds, key tokens and identifiers as multisets."""
    from trivane.operators import sets as U
    from trivane.operators import texts as T

    t = words_of_turns(spark, d).where(F.exists("ws", lambda w: F.length(w) % 4 != 2))
    sides = F.array(F.struct(F.lit("gen").alias("side"), program(FUNCTIONS, ws="before").alias("text")), F.struct(F.lit("ref").alias("side"), program(FUNCTIONS).alias("text")))
    both = turn_pairs(t).select("item_id", F.explode(sides).alias("s"))
    c = both.select("item_id", "s.side", F.explode(P.clauses("s.text")).alias("c")).select("item_id", "side", "c.kind", "c.normalized")
    out = U.recall(U.multiset(T.features(c, "item_id", "side", "kind", "normalized"), "item_id", "feature", "side", "gen", "ref"), "item_id")
    return out.select("item_id", "right", F.round("recall", 9).alias("recall"))

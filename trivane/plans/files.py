"""Queries for scans and sinks by round trips through files in the shared folder (S), for edits of texts (F12-F14, Y3, Y4, X9)
and for small functions that others rest on (F6, F7, H6, X5, X6, V4)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivane.functions import actions, contracts, lexer, registry, specs
from trivane.functions import parsing as P
from trivane.functions import states as S
from trivane.operators import aggregates as A
from trivane.operators import statistics as ST
from trivane.plans.programs import WORDS, number, program, turns
from trivane.plans.registry import query
from trivane.session import shared_dir
from trivane.sources import archives, scans, sinks
from trivane.streaming import incremental as I
from trivane.views import view


def folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"


@query("SELECT c_custkey, c_name, c_nationkey, CAST(round(c_acctbal * 100) AS BIGINT) AS cents, c_mktsegment FROM customer")
def s01_s15_csv_round_trip(spark, d):
    """A table written under a fixed header and read under its schema."""
    path = folder(spark, "csv")
    c = view(spark, d, "customer").withColumn("cents", F.round(F.col("c_acctbal") * 100).cast("long"))
    sinks.write_new(c, path, ["c_custkey", "c_name", "c_nationkey", "cents", "c_mktsegment"])
    kinds = dict(c.dtypes)
    return scans.csv_table(spark, path, ", ".join(f"{n} {kinds[n]}" for n in ("c_custkey", "c_name", "c_nationkey", "cents", "c_mktsegment")))


@query("SELECT n_nationkey AS key, n_name AS name, n_regionkey >= 2 AS flag FROM nation")
def s05_flagged_union(spark, d):
    """CSV tables of two folders together, with a flag for one of them."""
    base = folder(spark, "flags")
    n = view(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), "n_regionkey")
    for name, cond in (("verified", "n_regionkey < 2"), ("unverified", "n_regionkey >= 2")):
        sinks.write_new(n.where(cond), f"{base}/{name}", ["key", "name"])
    kinds = dict(n.dtypes)
    return scans.flagged_union(spark, [f"{base}/verified", f"{base}/unverified"], f"key {kinds['key']}, name {kinds['name']}", "unverified")


@query("SELECT CAST(n_nationkey AS BIGINT) AS key, 'nation ' || n_name || chr(10) || 'région ' || n_regionkey || chr(10) AS text FROM nation")
def s07_source_texts(spark, d):
    """Whole files as texts, with the folder of each."""
    path = folder(spark, "texts")
    n = view(spark, d, "nation").select("n_nationkey", F.concat(F.lit("nation "), "n_name", F.lit("\nrégion "), F.col("n_regionkey").cast("string")).alias("text"))
    n.write.partitionBy("n_nationkey").text(path)
    return scans.source_texts(spark, f"{path}/*/*.txt").select(F.regexp_extract("path", "n_nationkey=([0-9]+)", 1).cast("long").alias("key"), "text")


@query("SELECT o_orderkey, o_orderstatus, [o_custkey, o_orderkey % 7] AS keys FROM orders")
def s18_json_sink(spark, d):
    path = folder(spark, "json")
    o = view(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.array("o_custkey", F.col("o_orderkey") % 7).alias("keys"))
    sinks.write_json(o, path)
    return scans.json_lines(spark, path, o.schema)


@query("SELECT p_partkey, count(*) AS n FROM (SELECT p_partkey FROM part UNION ALL SELECT p_partkey FROM part WHERE p_partkey % 3 = 0) GROUP BY p_partkey")
def y17_append_only(spark, d):
    path = folder(spark, "manifest")
    p = view(spark, d, "part").select("p_partkey")
    sinks.append(p, path)
    sinks.append(p.where("p_partkey % 3 = 0"), path)
    return spark.read.parquet(path).groupBy("p_partkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, c_name FROM customer")
def s22_archive_round_trip(spark, d):
    """A file cut into parts of 10,000 bytes, checked against their manifest and put together again."""
    base = folder(spark, "archive")
    c = view(spark, d, "customer").select("c_custkey", "c_name")
    c.coalesce(1).write.json(f"{base}/whole")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{base}/whole")
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(jvm.org.apache.hadoop.fs.Path(f"{base}/whole/part-*"))
    parts = archives.split(spark, files[0].getPath().toString(), f"{base}/parts", 10_000)
    archives.restore(spark, parts, f"{base}/parts", f"{base}/again/all.json")
    return scans.json_lines(spark, f"{base}/again", c.schema)


@query("SELECT count(*) AS n, 3::BIGINT AS batches FROM events")
def r02_progressive(spark, d):
    """Results are there batch by batch, as they are completed."""
    base = folder(spark, "progress")
    e = view(spark, d, "events").select("user_id", "event_id")
    e.repartition(6).write.parquet(f"{base}/landing")
    I.upsert(I.read_stream(spark, f"{base}/landing", e.schema, files_per_batch=2), f"{base}/target", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/target").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("batch").alias("batches"))


ARGUMENTS = ("#", "(#, a)", "[#, {b}]", "'\"', #")


@query(f"WITH {WORDS} SELECT item_id, len(n) + {number(3, 4)} AS parts, true AS closed FROM tk WHERE len(n) > 0")
def f06_f07_brackets(spark, d):
    """The bracket that closes a call, and what stands between its commas."""
    run = lambda c: P.applied(lambda t: {"closed": lexer.matching(t, 1) == len(t) - 1, "parts": len(lexer.split_commas(t[2:-1]))}, "struct<closed:boolean,parts:long>", c)
    t = turns(spark, d).where("size(ws) > 0").select("item_id", run(program(ARGUMENTS, "f(", ")", ", ")).alias("x"))
    return t.select("item_id", "x.parts", "x.closed")


@query(f"WITH {WORDS} SELECT item_id, array_to_string(list_transform(n, lambda x: CASE WHEN x % 2 = 0 THEN 'even' ELSE CAST(x AS VARCHAR) END), ' + ') AS text FROM tk")
def f12_splice(spark, d):
    """Edits of one text at once."""
    run = lambda c: P.applied(lambda t: specs.splice(t, [(x.start, x.end, "even") for x in lexer.tokens(t) if x.kind == "number" and int(x.text) % 2 == 0]), "string", c)
    return turns(spark, d).select("item_id", run(program(("#",), sep=" + ")).alias("text"))


@query(f"WITH {WORDS} SELECT item_id, list_concat(['x > 0'], list_transform(n[2:], lambda x: 'x < ' || x)) AS clauses, list_transform(n, lambda x: 'x < ' || x) AS masked FROM tk WHERE len(n) > 0")
def f13_f14_x09_edits(spark, d):
    """A clause taken out and another put in, by name of the action; and a contract masked."""

    def run(t):
        own = actions.apply("insert_clause", actions.apply("remove_clause", t, "f", "requires", 0), "f", "requires", "x > 0")
        rest, contract = specs.masked(t, "f")
        return {"clauses": [c.normalized for c in specs.clauses(own)], "masked": contract["requires"] if not specs.clauses(rest) else None}

    kinds = "struct<clauses:array<string>,masked:array<string>>"
    t = turns(spark, d).where("size(ws) > 0").select("item_id", P.applied(run, kinds, program(("x < #",), "fn f(x: u32) requires ", " { }", ", ")).alias("x"))
    return t.select("item_id", "x.clauses", "x.masked")


@query(f"""WITH {WORDS} SELECT item_id, list_concat(list_concat(CASE WHEN len(n) <> 2 THEN ['parameter_count'] ELSE [] END, CASE WHEN len(n) > 0 AND n[1] % 2 = 1 THEN ['parameter_type:0'] ELSE [] END), CASE WHEN len(n) > 1 AND n[2] % 2 = 0 THEN ['parameter_type:1'] ELSE [] END) AS issues,
  len(n) = 2 AND n[1] % 2 = 0 AND n[2] % 2 = 1 AS same FROM tk""")
def y03_y04_signatures(spark, d):
    """Differences of two signatures by position, and whether they bind."""
    ref = specs.functions("fn f(x: u32, y: u8) -> u8 { 0 }")[0]

    def run(t):
        gen = specs.functions(t)[0]
        return {"issues": specs.signature_issues(ref, gen), "same": not contracts.binding_issues(ref, gen)}

    t = turns(spark, d).select("item_id", P.applied(run, "struct<issues:array<string>,same:boolean>", program(("p#: u32", "p#: u8"), "fn f(", ") -> u8 { 0 }", ", ")).alias("x"))
    return t.select("item_id", "x.issues", "x.same")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS BIGINT) ELSE -1 END AS inner_size, p_size % 2 = 0 AS even FROM part")
def h06_nested_fields(spark, d):
    """Fields of nested records by path with a default, and membership in lists that may be missing."""
    p = view(spark, d, "part")
    js = F.when(F.col("p_size") % 3 == 0, F.format_string('{"a": {"b": [%d]}}', "p_size")).when(F.col("p_size") % 3 == 1, '{"a": {"b": ["x"]}}').otherwise("{}")
    evens = F.when(F.col("p_size") % 4 < 3, F.array(F.lit(0), F.lit(2)))
    return p.select("p_partkey", S.nested(F.parse_json(js), "$.a.b[0]", "long", -1).alias("inner_size"), S.member(evens, F.col("p_size") % 4).alias("even"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'target_mismatch' ELSE 'not_available' END AS status, CASE WHEN p_size % 2 = 0 THEN 0.0 END::DOUBLE AS score, CASE p_size % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'spec_only' ELSE 'other' END AS scope FROM part")
def x05_x06_unavailable(spark, d):
    """A metric that doesn't apply has a status and no score, one of the wrong function a score of 0; scopes by their other names."""
    even = F.col("p_size") % 2 == 0
    none, wrong = registry.unavailable("no suite"), registry.target_mismatch()
    scope = F.when(F.col("p_size") % 4 == 0, registry.scope("Whole-File")).when(F.col("p_size") % 4 == 1, registry.scope(" specification ")).otherwise("other")
    return view(spark, d, "part").select("p_partkey", F.when(even, wrong["status"]).otherwise(none["status"]).alias("status"), F.when(even, wrong["score"]).otherwise(none["score"]).alias("score"), scope.alias("scope"))


def mismatches(a: DataFrame, b: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """One row: groups that both recomputations have, and those in which they differ."""
    x = a.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_l")).join(b.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_r")), keys, "full_outer")
    same = F.col("_a").eqNullSafe(F.col("_b")) | (F.abs(F.col("_a") - F.col("_b")) <= 1e-9)
    return x.agg(F.count(F.lit(1)).alias("groups"), S.long_if(~(F.col("_l") & F.col("_r") & same) | F.col("_l").isNull() | F.col("_r").isNull()).alias("differing")).select(F.lit(name).alias("measure"), "groups", "differing")


@query("""
SELECT 'tau' AS measure, count(DISTINCT workflow) AS groups, 0::BIGINT AS differing FROM judged UNION ALL SELECT 'case_score', count(*), 0 FROM (SELECT DISTINCT sample_id, kind FROM cases)
UNION ALL SELECT 'mean', count(DISTINCT workflow), 0 FROM samples WHERE quality IS NOT NULL UNION ALL SELECT 'kill_rate', count(DISTINCT base_id), 0 FROM candidates""")
def v04_recomputed(spark, d):
    """Results computed a second time in another way: pair counts against rank sums, scores against means of indicators,
    statistics against sums, outcome counts against shares."""
    from trivane.plans.aggregations import mutants

    judged, cases, samples = (view(spark, d, v) for v in ("judged", "cases", "samples"))
    ok = F.col("accepted") == 1
    one = ST.pair_counts(ST.by_value(judged, ["workflow"], "measure", ok), ["workflow"], "measure").select("workflow", ST.tau_b().alias("tau"))
    out = mismatches(one, ST.rank_tau(judged, ["workflow"], "measure", ok), ["workflow"], "tau", "tau")
    again = cases.groupBy("sample_id", "kind").agg(F.avg((F.col("state") == "passed").cast("double")).alias("score"))
    out = out.unionByName(mismatches(A.case_scores(cases, ["sample_id", "kind"]), again, ["sample_id", "kind"], "score", "case_score"))
    sums = samples.where("quality IS NOT NULL").groupBy("workflow").agg(F.round(F.sum("quality") / F.count("quality"), 4).alias("mean"))
    out = out.unionByName(mismatches(A.summary_statistics(samples, ["workflow"], "quality"), sums, ["workflow"], "mean", "mean"))
    m = mutants(spark, d)
    shares = m.groupBy("base_id").agg(F.avg(F.when(F.col("outcome") != "invalid_mutant", (F.col("outcome") == "killed").cast("double"))).alias("score"))
    return out.unionByName(mismatches(A.kill_rate(m, ["base_id"]), shares, ["base_id"], "score", "kill_rate"))


@query("""WITH g AS (SELECT workflow, count(*) AS n, count(*) FILTER (stage = 'accepted') AS a FROM samples GROUP BY workflow), h AS (SELECT workflow, stage, count(*) AS n FROM samples GROUP BY ALL)
SELECT 'bars' AS figure, count(*) AS marks, CAST(sum(n) AS DOUBLE) AS total FROM g UNION ALL SELECT 'heatmap', count(*), sum(n) FROM h UNION ALL SELECT 'dots', count(*), sum(a) FROM g""")
def s21_figures(spark, d):
    """Figures of small tables: as many marks as rows, each with its value."""
    from trivane.sources import figures

    s = view(spark, d, "samples")
    g = s.groupBy("workflow").agg(F.count(F.lit(1)).alias("n"), S.long_if(F.col("stage") == "accepted").alias("a"))
    h = s.groupBy("workflow", "stage").agg(F.count(F.lit(1)).alias("n"))
    drawn = [("bars", figures.bars(g, "workflow", "n")), ("heatmap", figures.heatmap(h, "workflow", "stage", "n")), ("dots", figures.dots(g.withColumn("z", F.lit(0)), "workflow", "a", "z", "n"))]
    values = F.regexp_extract_all("svg", F.lit('data-value="([^"]*)"'), F.lit(1)).alias("v")
    f = spark.createDataFrame(drawn, "figure string, svg string").select("figure", values)
    return f.select("figure", F.size("v").cast("long").alias("marks"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("total"))

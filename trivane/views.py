"""The evidence model over the available tables.

Samples are orders, cases are line items, tasks are customers: every view has the shape of an evidence table (FIXTURES.md
part A). The text is plain SQL that Spark and DuckDB read alike; operators never depend on it, they take DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = tuple("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())

_DIRECTION = "CASE WHEN (o_orderkey * 7 + {i} * 3) % 10 < 5 THEN 'valid' WHEN (o_orderkey * 7 + {i} * 3) % 10 < 7 THEN 'invalid' WHEN (o_orderkey * 7 + {i} * 3) % 10 < 9 THEN 'unknown' ELSE 'unavailable' END"
_TRIVIAL = "CASE WHEN (o_orderkey * 11 + {i} * 5) % 10 < 6 THEN 'favorable' WHEN (o_orderkey * 11 + {i} * 5) % 10 < 8 THEN 'unfavorable' ELSE 'other' END"
DIRECTIONS = ("pre_ref_to_gen", "post_gen_to_ref", "pre_gen_to_ref", "post_ref_to_gen")
KINDS = ("io_correct", "io_wrong", "io_invalid")
STATES = ("passed", "failed", "unresolved")

VIEWS: dict[str, str] = {
    # one row per sample: identity, stage, eligibility, scores in hundredths (null: not measured) and states
    "samples": f"""
SELECT o_orderkey AS sample_id, o_custkey % 60 AS task_id, substr(o_orderpriority, 1, 1) AS workflow, concat('m', CAST(o_orderkey % 3 AS VARCHAR(4))) AS model,
  CASE WHEN o_orderkey % 2 = 0 THEN 'few' ELSE 'zero' END AS shot,
  CASE WHEN o_orderstatus = 'F' THEN 'accepted' WHEN o_orderstatus = 'P' THEN 'proof_failed' WHEN o_orderkey % 10 = 7 THEN 'parse_failed' ELSE 'frontend_failed' END AS stage,
  o_orderkey % 11 <> 0 AS eligible,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(floor(o_totalprice * 100) AS BIGINT) % 101 END AS quality,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) % 101 END AS redundancy,
  {", ".join(_DIRECTION.format(i=i) + f" AS {d}" for i, d in enumerate(DIRECTIONS))},
  {_TRIVIAL.format(i=0)} AS pre_false, {_TRIVIAL.format(i=1)} AS post_true
FROM orders""",
    # one row per checked case; (sample_id, case_no) repeats
    "cases": """
SELECT l_orderkey AS sample_id, CAST(l_linenumber AS BIGINT) AS case_no, CASE l_linenumber % 3 WHEN 1 THEN 'io_correct' WHEN 2 THEN 'io_wrong' ELSE 'io_invalid' END AS kind,
  CASE l_returnflag WHEN 'A' THEN 'passed' WHEN 'R' THEN 'failed' ELSE 'unresolved' END AS state,
  CASE WHEN l_returnflag <> 'N' THEN NULL WHEN l_linestatus = 'F' THEN 'timeout' ELSE 'solver' END AS reason,
  CAST(floor(l_quantity) AS BIGINT) AS amount, l_partkey AS part_id, l_suppkey AS oracle_id
FROM lineitem""",
    # one row per sample that has cases: counts by kind and state
    "outcomes": f"""
SELECT sample_id, {", ".join(f"CAST(sum(CASE WHEN kind = '{k}' AND state = '{s}' THEN 1 ELSE 0 END) AS BIGINT) AS {k}_{s}" for k in KINDS for s in STATES)}
FROM cases GROUP BY sample_id""",
    # candidate edits of a base, in rank order
    "candidates": """
SELECT event_id AS candidate_id, user_id % 200 AS base_id, event_type AS operator, CAST(row_number() OVER (PARTITION BY user_id % 200, event_type ORDER BY ts, event_id) AS BIGINT) AS pos,
  CASE CAST(floor(value * 100) AS BIGINT) % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'rejected' WHEN 2 THEN 'unresolved' ELSE 'error' END AS status,
  CAST(floor(value * 100) AS BIGINT) AS points, ts
FROM events""",
    # labelled texts: acceptance and measures
    "judged": """
SELECT d.doc_id AS sample_id, d.lang AS workflow, d.source AS task_id, l.quality AS accepted, l.toxic AS flagged, d.n_chars % 97 AS measure, d.n_chars AS size
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
}


def _needs(sql: str) -> list[str]:
    """The views that sql names, those they need first."""
    out: list[str] = []
    for name, text in VIEWS.items():
        if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql, re.I):
            out += [x for x in [*_needs(text), name] if x not in out]
    return list(dict.fromkeys(out))


def with_views(sql: str) -> str:
    """Oracle SQL with the views that it names in front."""
    head = ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in _needs(sql))
    body = sql.strip()
    if not head:
        return body
    if re.match(r"WITH\s+RECURSIVE\b", body, re.I):
        return f"WITH RECURSIVE {head}, " + re.sub(r"^WITH\s+RECURSIVE\s", "", body, flags=re.I)
    if re.match(r"WITH\b", body, re.I):
        return f"WITH {head}, " + re.sub(r"^WITH\s", "", body, flags=re.I)
    return f"WITH {head} {body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table by its name."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    sql = VIEWS[name]
    used = [t for t in (*TABLES, *VIEWS) if re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", sql)]
    for t in used:
        sql = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: view(spark, sf_dir, t) for t in used})

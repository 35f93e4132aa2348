"""Metrics by name: what each means, which way is better, and how it is computed from columns.

An entry's function takes the generated and the reference column and returns a struct (status, score); a row whose
evaluation fails has status exception, and the others go on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trivane.functions import specs
from trivane.functions.metrics import EVIDENCE, MEASURES, Measure
from trivane.functions.parsing import applied
from trivane.session import ship


@dataclass(frozen=True)
class Metric:
    name: str
    title: str
    category: str
    direction: str  # higher, lower or descriptive
    analyse: Callable[[str], float | None]


def _count(kind: str) -> Callable[[str], float | None]:
    return lambda text: float(specs.clause_counts(specs.clauses(text))[kind])


def _share(flag: Callable[[str], object]) -> Callable[[str], float | None]:
    def rate(text: str) -> float | None:
        found = specs.clauses(text)
        return sum(bool(flag(c.text)) for c in found) / len(found) if found else None

    return rate


def _duplicates(text: str) -> float | None:
    found = [c.normalized for c in specs.clauses(text)]
    return (len(found) - len(set(found))) / len(found) if found else 0.0


METRICS: dict[str, Metric] = {
    m.name: m
    for m in (
        Metric("requires_count", "Preconditions", "structure", "descriptive", _count("requires")),
        Metric("ensures_count", "Postconditions", "structure", "descriptive", _count("ensures")),
        Metric("trivial_clause_rate", "Trivial clauses", "triviality", "lower", _share(specs.tautology)),
        Metric("contradictory_clause_rate", "Contradictory clauses", "triviality", "lower", _share(specs.contradictions)),
        Metric("duplicate_clause_rate", "Repeated clauses", "redundancy", "lower", _duplicates),
        Metric("keyword_blacklist", "Unsound keywords", "triviality", "lower", lambda t: 1.0 if specs.blacklisted(t) else 0.0),
        Metric("spec_nodes", "Expression size", "structure", "descriptive", lambda t: float(sum(specs.structure(c.text).nodes for c in specs.clauses(t)))),
        Metric("mutant_count", "Mutants", "mutation", "descriptive", lambda t: float(len(specs.mutants(t)))),
    )
}
#: Older names.
ALIASES = {
    "clause_redundancy": "duplicate_clause_rate", "vacuity_rate": "trivial_clause_rate", "blacklist": "keyword_blacklist",
    "spec_score": "textual_similarity", "llm_as_judge": "llm_as_judge_intent_consistency", "pass": "verification_pass_rate",
    "proportion_ge_gt": "proportion_at_least_gt", "proportion_le_gt": "proportion_at_most_gt", "redundancy_rate": "spec_redundancy_rate",
}
#: Parts of a text that its metrics look at, with their other names.
SCOPES = {"full": "full", "whole_file": "full", "all": "full", "spec_only": "spec_only", "spec": "spec_only", "specification": "spec_only"}


def scope(name: str) -> str:
    key = name.strip().lower().replace("-", "_")
    if key not in SCOPES:
        raise ValueError(f"unknown scope {name}")
    return SCOPES[key]


def metric(name: str) -> Metric:
    return METRICS[ALIASES.get(name, name)]


def measure(name: str) -> Measure:
    """A metric of evidence by its name, an older one, or either behind the name of a tool and an underscore."""
    for n in (name, name.partition("_")[2]):
        n = ALIASES.get(n, n)
        if n in MEASURES:
            return MEASURES[n]
    raise ValueError(f"unknown metric {name}")


def catalog(spark: SparkSession) -> DataFrame:
    """The catalog as a table: one small row per metric, those of evidence first."""
    every = [*MEASURES.values(), *METRICS.values()]
    return spark.createDataFrame([(m.name, m.title, m.category, m.direction) for m in every], "name string, title string, category string, direction string")


def side(columns: dict[str, Column]) -> Column:
    """Evidence from some of its fields."""
    unknown = set(columns) - set(EVIDENCE)
    if unknown:
        raise ValueError(f"no such evidence: {sorted(unknown)}")
    return F.struct(*[columns.get(k, F.lit(None)).cast(t).alias(k) for k, t in EVIDENCE.items()])


def measured(pairs: DataFrame, key: str, names: list[str] | None = None) -> DataFrame:
    """(key, metric, status, score, ground, delta) for every pair (key, generated, ground) of evidence and every metric, in one
    pass; delta only if both sides have a score. The ground side is measured against itself."""
    ship(pairs.sparkSession)
    rows = []
    for n in names or list(MEASURES):
        m = measure(n)
        g, r = m.score(F.col("generated"), F.col("ground")), m.score(F.col("ground"), F.col("ground"))
        rows.append(F.struct(F.lit(m.name).alias("metric"), g.alias("g"), r.alias("r")))
    out = pairs.select(key, F.explode(F.array(*rows)).alias("m"))
    return out.select(key, "m.metric", "m.g.status", "m.g.score", F.col("m.r.score").alias("ground"), (F.col("m.g.score") - F.col("m.r.score")).alias("delta"))


def summary(scores: DataFrame) -> DataFrame:
    """Per metric: pairs, those with a score, their mean, and the share that has one."""
    n, scored = F.count(F.lit(1)), F.count("score")
    return scores.groupBy("metric").agg(n.alias("pairs"), scored.alias("scored"), F.avg("score").alias("mean"), (scored / n).alias("coverage"))


def evaluated(name: str, text: Column) -> Column:
    """struct(status, score) of one side."""
    run = metric(name).analyse

    def safe(t):
        if t is None:
            return {"status": "not_available", "score": None}
        try:
            score = run(t)
        except Exception as e:  # one row's failure stays its own
            return {"status": f"exception: {type(e).__name__}", "score": None}
        return {"status": "ok" if score is not None else "not_available", "score": score}

    return applied(safe, "struct<status:string,score:double>", text)


def two_sided(name: str, generated: Column, reference: Column) -> Column:
    """struct(generated, ground, delta): delta only if both sides have a score."""
    g, r = evaluated(name, generated), evaluated(name, reference)
    return F.struct(g.alias("generated"), r.alias("ground"), (g["score"] - r["score"]).alias("delta"))


def unavailable(reason: str) -> Column:
    return F.struct(F.lit("not_available").alias("status"), F.lit(None).cast("double").alias("score"), F.lit(reason).alias("reason"))


def target_mismatch() -> Column:
    """Scores 0 and not null: the wrong function was specified."""
    return F.struct(F.lit("target_mismatch").alias("status"), F.lit(0.0).alias("score"))

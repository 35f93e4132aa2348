"""Decisions over single records, as columns: safety of a text, where clauses were rejected, states of categories, runs of a
matrix, contracts without clauses, time stamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a text must not hold once white space is gone and letters are small, in the order of the reasons.
FORBIDDEN = {
    "assume(": "assume is forbidden",
    "admit(": "admit is forbidden",
    "#[verifier::external]": "external verifier is forbidden",
    "#[verifier::external_body]": "external body is forbidden",
    "ensurestrue": "ensures true is forbidden",
}
REQUIRED = {"ensures": "generated program has no ensures clause", "verus!": "generated output is not a Verus program"}


def unsafe_reason(code: Column) -> Column:
    """The first thing that makes a text unsafe: a forbidden one, else a required one that is missing; null if it is safe."""
    bare = F.lower(F.regexp_replace(code, r"\s+", ""))
    rules = [(F.contains(bare, F.lit(n)), why) for n, why in FORBIDDEN.items()] + [(~F.contains(code, F.lit(n)), why) for n, why in REQUIRED.items()]
    return F.coalesce(*[F.when(cond, why) for cond, why in rules])


def materialized(clauses: Column, kind: str, inject: bool = True) -> Column:
    """array<struct(kind, text, normalized, implicit)> of clauses given as structs of kind, text and normalized: empty ones are
    left out, and a contract without any is the one implicit clause true."""
    text, norm = (lambda c: F.trim(F.coalesce(c["text"], F.lit("")))), (lambda c: F.trim(F.coalesce(c["normalized"], F.lit(""))))
    full = F.transform(
        F.filter(F.coalesce(clauses, F.array().cast("array<struct<kind:string,text:string,normalized:string>>")), lambda c: (text(c) != "") | (norm(c) != "")),
        lambda c: F.struct(
            F.coalesce(c["kind"], F.lit(kind)).alias("kind"),
            F.when(text(c) != "", text(c)).otherwise(norm(c)).alias("text"),
            F.when(norm(c) != "", norm(c)).otherwise(text(c)).alias("normalized"),
            F.lit(False).alias("implicit"),
        ),
    )
    if not inject or kind not in ("requires", "ensures", "default_ensures"):
        return full
    one = F.struct(F.lit(kind).alias("kind"), F.lit("true").alias("text"), F.lit("true").alias("normalized"), F.lit(True).alias("implicit"))
    return F.when(F.size(full) == 0, F.array(one)).otherwise(full)


def localisation(clauses: Column, antecedent: Column, consequent: Column, kind: Column) -> Column:
    """struct(status, clauses, rejected, passed, rejected_text): whether saved checks of clauses say which one was rejected.

    clauses: array of struct(text, status, antecedent, antecedent_kinds, consequent); antecedent and consequent: what the
    checks must have been about. White space is evened out before texts are compared."""
    even = lambda a: F.transform(a, lambda x: F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " ")))
    c = F.coalesce(clauses, F.array().cast("array<struct<text:string,status:string,antecedent:array<string>,antecedent_kinds:array<string>,consequent:array<string>>>"))
    none = F.array().cast("array<string>")
    some = lambda x: F.coalesce(x, none)
    state = lambda x: F.coalesce(x["status"], F.lit("unknown"))
    rejected = F.filter(c, lambda x: state(x) == "invalid")
    status = (
        F.when((F.size(c) == 0) | antecedent.isNull() | consequent.isNull(), "missing_target_clause_context")
        .when(even(F.transform(c, lambda x: x["text"])) != even(consequent), "consequent_coverage_mismatch")
        .when(F.exists(c, lambda x: even(some(x["antecedent"])) != even(antecedent)), "antecedent_mismatch")
        .when(F.exists(c, lambda x: F.exists(some(x["antecedent_kinds"]), lambda k: k != kind)), "different_premise_policy")
        .when(F.exists(c, lambda x: even(some(x["consequent"])) != even(F.array(x["text"]))), "consequent_context_mismatch")
        .when(F.exists(c, lambda x: ~state(x).isin("valid", "invalid")), "unresolved_clause_checks")
        .when(F.size(rejected) == 0, "no_rejected_clause_in_saved_checks")
        .otherwise("localized_proof_rejection")
    )
    return F.struct(
        status.alias("status"), F.size(c).cast("long").alias("clauses"), F.size(rejected).cast("long").alias("rejected"),
        F.size(F.filter(c, lambda x: state(x) == "valid")).cast("long").alias("passed"), F.transform(rejected, lambda x: x["text"]).alias("rejected_text"),
    )


def selected_runs(runs: DataFrame, chosen: dict[str, str | None]) -> DataFrame:
    """Runs of a matrix that match the fields that are given (None and 'all' match everything).

    Reading the result fails if a run occurs twice; an empty selection is an error at once."""
    for k, v in chosen.items():
        runs = runs if v in (None, "all") else runs.where(F.col(k) == v)
    if runs.isEmpty():
        raise ValueError("no run matches the selection")
    keys = list(chosen)
    n = runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in runs.columns if c not in keys])
    return n.where(F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.concat(F.lit("run given twice: "), F.concat_ws("/", *keys))))).select(*runs.columns)


def iso_stamp(time: Column) -> Column:
    """A time as ISO text in seconds; texts in that form sort as the times do."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")


def elapsed(start: Column, end: Column, digits: int = 3) -> Column:
    """Seconds from start to end, never below 0; null if either is missing."""
    seconds = (F.unix_micros(end) - F.unix_micros(start)) / 1e6
    return F.round(F.when(seconds < 0, 0.0).otherwise(seconds), digits)

"""Nested evaluation records to typed tables: every rule of the flattening in one projection over a variant column.

A record has target_evaluation (identity, stage, eligibility, directions, triviality) and metrics by name, each with a
generated side or none. Missing counts are 0, missing scores null, a missing status is `missing`; values outside their
domain and counts that don't add up are errors when the row is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trivane.functions import states as S

DIRECTIONS = ("pre_ref_to_gen", "post_gen_to_ref", "pre_gen_to_ref", "post_ref_to_gen")
STAGES = ("parse_failed", "frontend_failed", "proof_failed", "accepted")
#: Names of the metrics in a record; a corpus with other names passes its own.
NAMES = {
    "io_correct": "correct_io_pass_rate",
    "io_wrong": "wrong_io_reject_rate",
    "io_invalid": "invalid_test_filtering_rate",
    "text": "textual_similarity_spec_only",
    "intent": "llm_as_judge_intent_consistency",
    "spec_code": "llm_as_judge_spec_code_intent_consistency",
    "mutation": "mutation_kill_rate",
    "redundancy": "spec_redundancy_rate",
    "spec": "spec_size_complexity_spec_only",
    "proof": "spec_size_complexity_proof",
    "time": "verification_time",
}
KINDS = ("io_correct", "io_wrong", "io_invalid")
UNFAVORABLE_VERDICTS = ("missing_constraints", "too_strong", "too_weak", "incomparable", "incorrect")


def _get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def _node(record: Column, name: str) -> Column:
    """The generated side if there is one, else the metric."""
    m = _get(record, f"metrics.{name}")
    return F.coalesce(_get(m, "generated"), m)


def _one_of(x: Column, domain: tuple[str, ...], what: str) -> Column:
    return F.when(x.isin(*domain), x).otherwise(F.raise_error(F.concat(F.lit(f"{what}: "), F.coalesce(x, F.lit("null")))))


def _long(v: Column, field: str) -> Column:
    return F.coalesce(_get(v, field, "bigint"), F.lit(0).cast("long"))


def _some_text(v: Column) -> Column:
    """A list with an item that isn't blank, or a text that isn't."""
    items = v.try_cast("array<string>") if hasattr(v, "try_cast") else v.cast("array<string>")
    text = _get_text(v)
    return F.coalesce(F.exists(items, lambda x: F.trim(x) != ""), F.trim(text) != "", F.lit(False))


def _get_text(v: Column) -> Column:
    return v.try_cast("string") if hasattr(v, "try_cast") else v.cast("string")


def flatten(records: DataFrame, record: str = "record", path: Column | None = None, target: Column | None = None, audited: Column | None = None, names: dict[str, str] = NAMES) -> DataFrame:
    """One row per record with all label and outcome columns.

    path: where the record lies (its grandparent folder tells whether it was generated on the verified side). target: the
    catalogued function; audited: rows whose target was chosen by hand, for which a judged intent needs that function."""
    r = F.col(record)
    t = _get(r, "target_evaluation")
    sample = _get(t, "sample_id", "string")
    parts = F.split(sample, "[|]")
    stage = _one_of(_get(t, "verification_stage", "string"), STAGES, "unknown stage")
    ways = {d: _one_of(_get(t, f"directions.{d}", "string"), ("valid", "invalid", "unknown", "unavailable"), "invalid direction") for d in DIRECTIONS}
    tri = ("favorable", "unfavorable", "other")
    base = records.select(
        sample.alias("sample_id"),
        *[parts[k].alias(n) for k, n in enumerate(("workflow", "model", "shot", "task_id"))],
        ((F.element_at(F.split(path, "/"), -3) == "verified") if path is not None else F.lit(None).cast("boolean")).alias("verified_side"),
        stage.alias("verification_stage"),
        _get(t, "analysis_eligible", "boolean").alias("analysis_eligible"),
        *[c.alias(d) for d, c in ways.items()],
        _one_of(_get(t, "triviality.precondition_falsity", "string"), tri, "invalid triviality").alias("triviality_pre_false_state"),
        _one_of(_get(t, "triviality.postcondition_truth", "string"), tri, "invalid triviality").alias("triviality_post_true_state"),
        *[_node(r, names[k]).alias(f"_{k}") for k in (*KINDS, "mutation", "redundancy", "time")],
        *[_get(r, f"metrics.{names[k]}").alias(f"_{k}") for k in ("text", "intent", "spec_code", "spec", "proof")],
        (target if target is not None else F.lit(None).cast("string")).alias("_target"),
        F.coalesce(audited if audited is not None else F.lit(False), F.lit(False)).alias("_audited"),
    )
    out = _counts(base)
    return _labels(out).drop(*[c for c in out.columns if c.startswith("_")])


def _counts(df: DataFrame) -> DataFrame:
    cols = {}
    for k in KINDS:
        n = F.col(f"_{k}")
        p, f, u = _long(n, "passed"), _long(n, "failed"), _long(n, "unknown")
        sound = (F.least(p, f, u) >= 0) & (p + f + u == _long(n, "total"))
        cols[f"{k}_passed"] = F.when(sound, p).otherwise(F.raise_error(F.concat(F.lit(f"inconsistent counts of {k}: "), F.col("sample_id"))).cast("long"))
        cols |= {f"{k}_failed": f, f"{k}_unresolved": u, f"{k}_skipped": F.lit(0).cast("long")}
        cols[f"{k}_state"] = F.when(f > 0, "unfavorable").when((p > 0) & (u == 0), "favorable").otherwise("other")
        cols |= {f"{k}_score": _get(n, "score", "double"), f"{k}_status": _get(n, "status", "string")}
    return df.withColumns(cols)


def _labels(df: DataFrame) -> DataFrame:
    c = F.col
    total = lambda s: c(f"io_correct_{s}") + c(f"io_wrong_{s}") + c(f"io_invalid_{s}")
    spec, mutation, redundancy, judge = c("_spec"), c("_mutation"), c("_redundancy"), _get(c("_spec_code"), "generated")
    intent, node, raw = c("_intent"), _get(c("_intent"), "generated"), _get(c("_intent"), "raw_judge")
    verdict = F.lower(F.coalesce(F.nullif(_get(node, "verdict", "string"), F.lit("")), F.nullif(_get(raw, "verdict", "string"), F.lit("")), F.lit("unknown")))
    verdict = F.when(verdict == "over_strong", "too_strong").otherwise(verdict)
    ok = lambda v, p="status": F.coalesce(_get(v, p, "string") == "ok", F.lit(False))
    aligned = ok(intent, "target_alignment.status") & F.coalesce(_get(intent, "target_alignment.function", "string") == c("_target"), F.lit(False))
    done = ok(intent) & ok(node) & ok(intent, "llm.status") & (~c("_audited") | aligned)
    score = S.unit(_get(intent, "score", "double"))
    advisory = F.lit(False)
    for key in ("missing_constraints", "extra_or_overstrong_constraints", "vacuity_risks"):
        advisory = advisory | _some_text(F.coalesce(_get(node, key), _get(raw, key)))
    code_verdict, code_score = _get(judge, "verdict", "string"), S.unit(_get(judge, "score", "double"))
    code_status = F.coalesce(F.nullif(_get(judge, "llm.status", "string"), F.lit("")), F.lit("missing"))
    code_done = (code_status == "ok") & (F.coalesce(code_verdict, F.lit("")) != "") & code_score.isNotNull()
    status = lambda v: F.coalesce(F.nullif(_get(v, "status", "string"), F.lit("")), F.lit("missing"))
    valid, removable, rate = _long(mutation, "valid_mutants"), _long(redundancy, "removable_clause_candidates"), S.unit(_get(redundancy, "score", "double"))
    judged = status(mutation).isin("ok", "partial") & (valid > 0)
    forms = F.array_compact(
        F.array(
            F.when(c("triviality_pre_false_state") == "unfavorable", "pre_false"),
            F.when(c("triviality_post_true_state") == "unfavorable", "post_true"),
            F.when(_get(spec, "gen.breakdown.contract_clauses", "bigint") == 0, "empty_contract"),
        )
    )
    decided = [F.when(c(d).isin("valid", "invalid"), 0).otherwise(1) for d in DIRECTIONS]
    invalid = [F.when(c(d) == "invalid", 1).otherwise(0) for d in DIRECTIONS]
    return df.withColumns(
        {
            "verification_state": F.when(c("verification_stage") == "accepted", "favorable").otherwise("unfavorable"),
            "formal_unknown_dirs": sum(decided[1:], decided[0]).cast("long"),
            "formal_invalid_dirs": sum(invalid[1:], invalid[0]).cast("long"),
            "formal_reliability_state": S.combine(list(DIRECTIONS[:2]), "valid", "invalid"),
            "formal_completeness_state": S.combine(list(DIRECTIONS[2:]), "valid", "invalid"),
            "formal_state": S.combine(list(DIRECTIONS), "valid", "invalid"),
            "io_state": F.when(F.array_contains(F.array(*[c(f"{k}_state") for k in KINDS]), "unfavorable"), "unfavorable").when((total("passed") > 0) & (total("unresolved") == 0), "favorable").otherwise("other"),
            "triviality_state": S.combine(["triviality_pre_false_state", "triviality_post_true_state"]),
            "triviality_form": F.when(F.size(forms) > 0, F.array_join(forms, ";")).otherwise("none"),
            **{f"text_{k}": S.number(_get(c("_text"), f"components.{k}.score", "double")) for k in ("bleu", "rouge_l", "key_spec_match")},
            "llm_intent_state": F.when(done & (verdict == "equivalent") & F.coalesce(F.abs(score - 1) <= 1e-12, F.lit(False)), "favorable").when(done & verdict.isin(*UNFAVORABLE_VERDICTS), "unfavorable").otherwise("other"),
            "llm_intent_verdict": verdict,
            "llm_intent_score": score,
            "llm_intent_advisory": advisory,
            "llm_spec_code_state": F.when(code_done, F.when(code_verdict == "aligned", "favorable").otherwise("unfavorable")).otherwise("other"),
            "llm_spec_code_verdict": F.coalesce(F.nullif(code_verdict, F.lit("")), F.lit("unknown")),
            "llm_spec_code_status": code_status,
            "llm_spec_code_score": code_score,
            "mutation_state": F.when(judged, F.when(_long(mutation, "survived_mutants") > 0, "unfavorable").when(_long(mutation, "unknown_mutants") > 0, "other").otherwise("favorable")).otherwise("other"),
            "mutation_valid_mutants": valid,
            "mutation_status": status(mutation),
            "mutation_score": S.unit(_get(mutation, "score", "double")),
            "redundancy_state": F.when(removable > 0, "unfavorable").when(status(redundancy).isin("ok", "no_testable_clauses"), "favorable").otherwise("other"),
            "redundancy_removable": removable,
            "redundancy_status": status(redundancy),
            "redundancy_rate": rate,
            "redundancy_score": 1.0 - rate,
            "spec_node_count": _get(spec, "gen.node_count", "bigint"),
            "spec_status": status(spec),
            "proof_node_count": _get(c("_proof"), "gen.node_count", "bigint"),
            "proof_status": status(c("_proof")),
            "verification_time_seconds": S.number(F.coalesce(_get(c("_time"), "elapsed_seconds", "double"), _get(c("_time"), "score", "double"))),
        }
    )

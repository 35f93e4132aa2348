"""Column functions for three-valued evidence: encoders, rules for unknowns, ratios. Each names what unknown means to it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str


def _c(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


def long_if(cond: Column) -> Column:
    """How many rows a condition holds for, as a long; null counts as no."""
    return F.count(F.when(cond, F.lit(1)))


# numbers


def number(x: Col) -> Column:
    """The value as a double; null stays null, NaN and infinities are errors."""
    v = _c(x).cast("double")
    bad = F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(v.isNotNull() & bad, F.raise_error(F.lit("not a finite number")).cast("double")).otherwise(v)


def unit(x: Col, slack: float = 1e-12) -> Column:
    """A score in [0, 1]; up to slack outside is clamped, further is an error."""
    v = number(x)
    bad = (v < -slack) | (v > 1 + slack)
    return F.when(bad, F.raise_error(F.lit("score outside [0, 1]")).cast("double")).when(v.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)))


def clamp_score(text: Col) -> Column:
    """The number in a text clamped to [0, 1]; null for what is no finite number."""
    v = F.expr(f"try_cast({text} AS double)") if isinstance(text, str) else text.cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(F.when(v.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))))


def ratio(n: Col, d: Col) -> Column:
    """n / d as a double, null where d is 0 or null."""
    return F.try_divide(_c(n).cast("double"), _c(d).cast("double"))


def f1(p: Col, r: Col) -> Column:
    """Harmonic mean; null if either is null, 0 if both are 0."""
    p, r = _c(p), _c(r)
    return F.when(p.isNull() | r.isNull(), None).when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


def first_present(*xs: Col) -> Column:
    return F.coalesce(*[_c(x) for x in xs])


def finite_or_null(x: Col) -> Column:
    v = _c(x)
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


# three values


def combine(states: list[Col], positive: str = "favorable", negative: str = "unfavorable") -> Column:
    """unfavorable if any state is negative, favorable if all are positive, else other."""
    cs = [_c(s) for s in states]
    any_neg = reduce(lambda a, b: a | b, [F.coalesce(c == negative, F.lit(False)) for c in cs])
    all_pos = reduce(lambda a, b: a & b, [F.coalesce(c == positive, F.lit(False)) for c in cs])
    return F.when(any_neg, "unfavorable").when(all_pos, "favorable").otherwise("other")


def kleene_and(*xs: Col) -> Column:
    """Three-valued conjunction: false wins, then unknown."""
    return reduce(lambda a, b: a & b, [_c(x) for x in xs])


def all_true(x: Column) -> Column:
    """The conjunction over a group: false if any value is false, else null if any is unknown, else true (also if empty)."""
    return F.when(F.coalesce(F.bool_or(x == F.lit(False)), F.lit(False)), False).when(F.coalesce(F.bool_or(x.isNull()), F.lit(False)), None).otherwise(True)


def formal_state(*directions: Col) -> Column:
    """fail if any direction is invalid, pass if all are valid, else unresolved."""
    return F.when(combine(list(directions), "valid", "invalid") == "unfavorable", "fail").when(combine(list(directions), "valid", "invalid") == "favorable", "pass").otherwise("unresolved")


def triviality_state(pre: Col, post: Col) -> Column:
    s = combine([pre, post])
    return F.when(s == "unfavorable", "fail").when(s == "favorable", "pass").otherwise("unresolved")


def io_total(kind: str) -> Column:
    return F.col(f"{kind}_passed") + F.col(f"{kind}_failed") + F.col(f"{kind}_unresolved")


def io_score(kind: str) -> Column:
    """Passed of all checked: unresolved counts as not passed; null if nothing was checked."""
    return ratio(F.col(f"{kind}_passed"), io_total(kind))


def io_state(passed: Col, failed: Col, unresolved: Col) -> Column:
    """fail if any failed, pass if some passed and none is unresolved, else none."""
    p, f, u = (F.coalesce(_c(x), F.lit(0)) for x in (passed, failed, unresolved))
    return F.when(f > 0, "fail").when((p > 0) & (u == 0), "pass").otherwise("none")


def profile_state(passed: Col, failed: Col, unresolved: Col) -> Column:
    """Four outcomes: failed, unavailable (nothing checked), unresolved, passed."""
    p, f, u = (F.coalesce(_c(x), F.lit(0)) for x in (passed, failed, unresolved))
    return F.when(f > 0, "failed").when(p + u == 0, "unavailable").when(u > 0, "unresolved").otherwise("passed")


def relation(left_implies_right: Col, right_implies_left: Col, left: str = "generated") -> Column:
    """Of two implications: equivalent, left stronger or weaker (or equal), incomparable; unknown if one is."""
    a, b = _c(left_implies_right), _c(right_implies_left)
    return F.when(a.isNull() | b.isNull(), "unknown").when(a & b, "equivalent").when(a, f"{left}_stronger_or_equal").when(b, f"{left}_weaker_or_equal").otherwise("incomparable")


def refinement(forward: Col, backward: Col, status: Col) -> Column:
    """Like relation(), but a known implication counts even if the other one is unknown; only status ok is compared."""
    a, b = _c(forward), _c(backward)
    return (
        F.when(_c(status) == "missing_generated", "missing_generated")
        .when(F.coalesce(_c(status) != "ok", F.lit(True)), "unknown")
        .when(a & b, "equivalent")
        .when(a, "generated_refines_reference")
        .when(b, "reference_refines_generated")
        .when(a.isNull() | b.isNull(), "unknown")
        .otherwise("incomparable")
    )


def implication_state(status: Col, holds: Col) -> Column:
    """valid or invalid where status and verdict agree, unavailable where there is neither, else unknown."""
    s, h = _c(status), _c(holds)
    return F.when(s.isNull() & h.isNull(), "unavailable").when((s == "valid") & h, "valid").when((s == "invalid") & ~h, "invalid").otherwise("unknown")


def dual_proof(proved: Col, refuted: Col) -> Column:
    """true only if proved, false only if the negation is proved, else null."""
    return F.when(_c(proved), True).when(_c(refuted), False)


def suite_state(status: Col, failed: Col, unknown: Col, total: Col) -> Column:
    """detected if a case failed, clear if all of some passed, unresolved if the run was partial, else unavailable."""
    f, u, t = (F.coalesce(_c(x), F.lit(0)) for x in (failed, unknown, total))
    return F.when(f > 0, "detected").when((_c(status) == "ok") & (t > 0) & (u == 0), "clear").when((_c(status) == "partial") & (t > 0), "unresolved").otherwise("unavailable")


def pair_state(base: Col, changed: Col) -> Column:
    """A change is judged only against a base that is clear."""
    return F.when(_c(base) == "clear", _c(changed)).otherwise("base_not_clear")


def union_state(*states: Col) -> Column:
    """behavior_detected, then diagnostic_only, if any category has it; missed if all have; else unresolved."""
    cs = F.array(*[_c(s) for s in states])
    return (
        F.when(F.array_contains(cs, "behavior_detected"), "behavior_detected")
        .when(F.array_contains(cs, "diagnostic_only"), "diagnostic_only")
        .when(F.forall(cs, lambda x: x == "missed"), "missed")
        .otherwise("unresolved")
    )


def case_state(cases: Col, invalid: bool) -> Column:
    """State of an array of cases (success, requires_accepted, reason, reason_detail).

    A failed case shows behaviour, but for invalid inputs only if their admission was proved; otherwise it is a diagnostic,
    as is an expression without a meaning. missed: all of some cases passed."""
    a = _c(cases)
    failed = lambda x: F.coalesce(~x["success"], F.lit(False))
    proved = lambda x: F.coalesce(x["requires_accepted"], F.lit(False))
    semantic = F.exists(a, lambda x: failed(x) & proved(x)) if invalid else F.exists(a, failed)
    unproved = F.exists(a, lambda x: failed(x) & ~proved(x)) if invalid else F.lit(False)
    undefined = F.exists(a, lambda x: F.coalesce(x["reason"] == "contract_expression_undefined", F.lit(False)) | F.coalesce(F.lower(x["reason_detail"]).contains("recommendation not met"), F.lit(False)))
    passed = (F.size(a) > 0) & F.forall(a, lambda x: F.coalesce(x["success"], F.lit(False)))
    return F.when(semantic, "behavior_detected").when(unproved | undefined, "diagnostic_only").when(passed, "missed").otherwise("unresolved")


def witness(direction: Col, base_pre: Col, mutant_pre: Col, base_contract: Col, mutant_contract: Col) -> Column:
    """Whether a case shows a change of this direction; unknown values show nothing."""
    d = _c(direction)
    t = lambda x: _c(x).eqNullSafe(True)
    f = lambda x: _c(x).eqNullSafe(False)
    admitted = t(base_pre) & t(mutant_pre)
    return (
        F.when(d == "pre_strengthening", t(base_pre) & f(mutant_pre))
        .when(d.isin("pre_omission", "pre_weakening"), f(base_pre) & t(mutant_pre))
        .when(d == "post_strengthening", admitted & t(base_contract) & f(mutant_contract))
        .otherwise(admitted & f(base_contract) & t(mutant_contract))
    )


def wrong_output_decision(accepted: Col, admitted: Col, reason: Col | None = None) -> Column:
    """struct(success, reason): a wrong output counts as rejected only if its input is admitted."""
    x, a = _c(accepted), _c(admitted)
    out = lambda ok, why: F.struct(F.lit(ok).cast("boolean").alias("success"), (F.lit(why) if isinstance(why, str) else why).alias("reason"))
    open_reason = F.coalesce(_c(reason), F.lit("output_rejection_unresolved")) if reason is not None else F.lit("output_rejection_unresolved")
    return (
        F.when(x, out(False, "wrong_output_accepted"))
        .when(~a, out(False, "wrong_input_rejected"))
        .when(a & ~x, out(True, "admitted_input_output_rejected"))
        .when(a.isNull() & ~x, out(None, "input_admission_unresolved"))
        .otherwise(out(None, open_reason))
    )


# Phrases by which an external tool's output shows its kind of failure.
MEMORY_MARKS = ("out of memory", "oom", "memory exhausted", "resource exhausted")
PARSE_MARKS = (
    "syntax error",
    "expected one of",
    "unexpected token",
    "mismatched closing delimiter",
    "unclosed delimiter",
    "unexpected closing delimiter",
    "this file contains an unclosed delimiter",
    "expected identifier",
    "expected expression",
    "expected type",
    "expected item",
)


def looks_like_parse_error(output: Col) -> Column:
    o = F.lower(F.coalesce(_c(output), F.lit("")))
    return reduce(lambda a, b: a | b, [o.contains(m) for m in PARSE_MARKS]) | o.rlike(r"\bparse[dr]?\b|expected .{0,80}, found")


def run_outcome(status: Col, success: Col, output: Col, returncode: Col) -> Column:
    """The class of an external run; the first that applies."""
    s, o = _c(status), F.lower(F.coalesce(_c(output), F.lit("")))
    memory = reduce(lambda a, b: a | b, [o.contains(m) for m in MEMORY_MARKS])
    return (
        F.when(s == "timeout", "timeout")
        .when(s == "unavailable", "tool_error")
        .when(s == "parse_error", "parse_error")
        .when(_c(success), "verified")
        .when(_c(success).isNull(), "tool_error")
        .when(memory, "resource_exhausted")
        .when(_c(returncode) < 0, "tool_error")
        .when(looks_like_parse_error(output), "parse_error")
        .otherwise("verification_failed")
    )


_UNDECIDED = ("timeout", "tool_error", "resource_exhausted")


def mutant_outcome(outcome: Col, frontend: Col) -> Column:
    """survived if the mutant verified; killed if it failed although the front end takes it; unknown if a run is undecided
    or there is no front-end run; invalid_mutant if the front end rejects it."""
    r, f = _c(outcome), _c(frontend)
    return F.when(r == "verified", "survived").when(r.isin(*_UNDECIDED) | f.isNull(), "unknown").when(f == "verified", "killed").when(f.isin(*_UNDECIDED), "unknown").otherwise("invalid_mutant")


def removal_outcome(outcome: Col, frontend: Col) -> Column:
    """removable if it still verifies, necessary if it fails although the front end takes it, else unknown."""
    r, f = _c(outcome), _c(frontend)
    return F.when(r == "verified", "removable").when(~r.isin(*_UNDECIDED) & F.coalesce(f == "verified", F.lit(False)), "necessary").otherwise("unknown")


def acceptance_rule(compiles_before: Col, compiles_after: Col, verified: Col, error_type: Col, errors_after: Col, obligations: tuple[Col, Col], errors: tuple[Col, Col]) -> Column:
    """struct(accept, reason) for a repair candidate: the first rule that decides. Pairs are (before, after)."""
    rule = lambda ok, why: F.struct(F.lit(ok).alias("accept"), (F.lit(why) if isinstance(why, str) else why).alias("reason"))
    stable = (_c(obligations[1]) >= _c(obligations[0])) & (_c(errors[1]) <= _c(errors[0]))
    return (
        F.when(_c(compiles_before) & ~_c(compiles_after), rule(False, "compilation regression"))
        .when(_c(verified), rule(True, "verified"))
        .when(~F.array_contains(_c(errors_after), _c(error_type)), rule(True, F.concat(F.lit("resolved "), _c(error_type))))
        .when(stable, rule(True, "score stable or improved"))
        .otherwise(rule(False, "score regressed"))
    )


def repair_score(verified: Col, errors: Col, notes: Col, obligations: Col) -> Column:
    """Share of verified obligations less a tenth an error and a twenty-fifth a note, both per obligation."""
    v, e, n, o = (_c(x).cast("double") for x in (verified, errors, notes, obligations))
    return F.try_divide(v, v + e) - F.try_divide(0.1 * e + 0.04 * n, o)


def mask(*checks: Col) -> Column:
    """A bit for each check that failed."""
    return F.concat(*[F.when(F.coalesce(_c(c) == "fail", F.lit(False)), "1").otherwise("0") for c in checks])


# derived rules, in the two ways that unknowns are treated


def strict(x: Col) -> Column:
    """1 if the score is 1, 0 if it is less, null if it is unknown."""
    return F.when(_c(x).isNotNull(), F.when(_c(x) == 1.0, 1.0).otherwise(0.0))


def mean_or_null(*xs: Col) -> Column:
    """The mean; null if any is."""
    return reduce(lambda a, b: a + b, [_c(x) for x in xs]) / len(xs)


def mean_unknown_zero(*xs: Col) -> Column:
    """The mean with unknowns as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(_c(x), F.lit(0.0)) for x in xs]) / len(xs)


def worst_status(*xs: Col) -> Column:
    """exception, then partial, then not_available, then ok."""
    cs = F.array(*[_c(x) for x in xs])
    out = F.lit("ok")
    for s in ("not_available", "partial", "exception"):
        out = F.when(F.array_contains(cs, s), s).otherwise(out)
    return out


def imputed(score: Col, lower_is_better: Col, keep_missing: Col) -> Column:
    """A missing score becomes the worst one, but for measures without bounds and cases that were never checked."""
    return F.when(_c(score).isNotNull() | _c(keep_missing), _c(score)).otherwise(F.when(_c(lower_is_better), 1.0).otherwise(0.0))


def conservative(passed: Col, total: Col) -> Column:
    """passed / total with unknowns as not passed; 0 if there is nothing."""
    return F.coalesce(ratio(passed, total), F.lit(0.0))


def nested(record: Col, path: str, kind: str = "string", default=None) -> Column:
    """A field of a variant by its path ($.a.b[0]), or a default where it is missing, null or of another kind."""
    return F.coalesce(F.try_variant_get(_c(record), path, kind), F.lit(default).cast(kind))


def member(values: Col, x: Col) -> Column:
    """Whether x is among the values; false, not null, for missing ones."""
    return F.coalesce(F.array_contains(_c(values), _c(x)), F.lit(False))

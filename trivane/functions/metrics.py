"""The metrics of a specification against a reference, as columns over evidence.

A side's evidence is a struct: text (the specification), frontend (ok, parse_error, type_error, timeout, tool_error),
verified (true, false, null: open), seconds, pre_false and post_true (probes: true means trivial, null open), at_least and
at_most (verdicts by function), pre_reliability, pre_completeness, post_reliability and post_completeness (verdicts by
clause), io_correct, io_wrong and io_invalid (cases: passed, failed or else unresolved), mutants (killed, survived, unknown,
invalid_mutant), removals (removed, necessary, unknown), judged and judged_code (stored scores of a judge). What an outside
program decides comes in as such columns; fields that are missing count as null.

A metric gives a struct (status, score); a null score always has a status that says why."""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from trivane.functions import contracts, specs
from trivane.functions.lexer import tokens
from trivane.functions.parsing import applied
from trivane.functions.states import ratio

Score = Callable[[Column, Column], Column]


def _out(status: Column, score: Column) -> Column:
    return F.struct(status.alias("status"), score.cast("double").alias("score"))


def _none() -> Column:
    return F.lit(None).cast("double")


def front_end(outcome: Column, passes: Column) -> Column:
    """1 or 0 if the front end came to an end; a timeout or an error of the tool is a status without a score."""
    lost = outcome.isin("timeout", "tool_error")
    status = F.when(outcome.isNull(), "not_available").when(lost, outcome).otherwise("ok")
    return _out(status, F.when(status == "ok", passes.cast("double")))


def known(value: Column) -> Column:
    return _out(F.when(value.isNull(), "not_available").otherwise("ok"), value)


def among_decided(verdicts: Column) -> Column:
    """Share of true among the verdicts that are known; partial if some are open."""
    v = F.coalesce(verdicts, F.array().cast("array<boolean>"))
    total, yes, no = F.size(v), F.size(F.filter(v, lambda x: x)), F.size(F.filter(v, lambda x: ~x))
    status = F.when(total == 0, "not_available").when(yes + no == total, "ok").otherwise("partial")
    return _out(status, ratio(yes, yes + no))


def among_all(cases: Column) -> Column:
    """Share of passed cases among all; unresolved ones count as not passed and make the status partial."""
    c = F.coalesce(cases, F.array().cast("array<string>"))
    total, passed = F.size(c), F.size(F.filter(c, lambda x: x == "passed"))
    decided = F.size(F.filter(c, lambda x: x.isin("passed", "failed")))
    return _out(F.when(total == 0, "not_available").when(decided < total, "partial").otherwise("ok"), ratio(passed, total))


def _count(xs: Column, name: str) -> Column:
    return F.size(F.filter(F.coalesce(xs, F.array().cast("array<string>")), lambda x: x == name))


def kills(verified: Column, mutants: Column) -> Column:
    """killed / (killed + survived + unknown), of a text that verifies; invalid mutants are left out."""
    killed, unknown, invalid = (_count(mutants, x) for x in ("killed", "unknown", "invalid_mutant"))
    scored = killed + unknown + _count(mutants, "survived")
    every = F.size(mutants)
    status = (
        F.when(verified.isNull() | mutants.isNull(), "not_available")
        .when(~verified, "skipped")
        .when(every == 0, "no_mutants")
        .when(scored == 0, "no_valid_mutants")
        .when(unknown + invalid > 0, "partial")
        .otherwise("ok")
    )
    return _out(status, F.when(status.isin("ok", "partial"), ratio(killed, scored)))


def removals(verified: Column, outcomes: Column) -> Column:
    """Clauses removed together, of all that may be removed, in a text that verifies."""
    every = F.size(outcomes)
    status = F.when(verified.isNull() | outcomes.isNull(), "not_available").when(~verified, "skipped").when(every == 0, "no_testable_clauses").when(_count(outcomes, "unknown") > 0, "partial").otherwise("ok")
    return _out(status, F.when(status == "no_testable_clauses", 0.0).when(status.isin("ok", "partial"), ratio(_count(outcomes, "removed"), every)))


def judge(generated: Column, ground: Column, score: Column) -> Column:
    """0 if the generated side fails the front end, nothing if the reference does, 1 for equal texts, else the judge's score."""
    passes = lambda side: F.coalesce(side["frontend"] == "ok", F.lit(False))
    same = F.coalesce(F.sha2(generated["text"], 256) == F.sha2(ground["text"], 256), F.lit(False))
    status = F.when(generated["frontend"].isNull(), "not_available").when(~passes(generated), "ok").when(~passes(ground), "not_available").when(same | score.isNotNull(), "ok").otherwise("pending")
    return _out(status, F.when(status == "ok", F.when(~passes(generated), 0.0).when(same, 1.0).otherwise(score)))


def probes(pre_false: Column, post_true: Column) -> Column:
    """Mean of the probes that came to an end, each 1 if it found triviality."""
    usable = F.array_compact(F.array(pre_false.cast("double"), post_true.cast("double")))
    n = F.size(usable)
    status = F.when(n == 0, "not_available").when(n == 1, "partial").otherwise("ok")
    return _out(status, F.when(n > 0, F.aggregate(usable, F.lit(0.0), lambda a, x: a + x) / n))


# similarity and size of texts


def gram_counts(words: Sequence[str], orders: int) -> list[dict]:
    """How often each run of n tokens occurs, for n from 1."""
    return [Counter(zip(*(words[k:] for k in range(n)))) for n in range(1, orders + 1)]  # noqa: B905


def bleu(candidate: Sequence[str], reference: Sequence[str], orders: int = 4) -> float:
    """BLEU with the smoothing of operators.texts.bleu, for one pair of token lists."""
    return bleu_of_counts(len(candidate), gram_counts(candidate, orders), len(reference), gram_counts(reference, orders))


def bleu_of_counts(candidate: int, own: Sequence[dict], reference: int, theirs: Sequence[dict]) -> float:
    """BLEU from the lengths of both sides and their counts of runs of 1, 2 and more tokens."""
    if not candidate or not reference:
        return float(not candidate and not reference)
    logs, missed = 0.0, 0
    used = min(len(own), candidate)
    for n in range(used):
        of = theirs[n]
        match, total = sum(min(c, of[g]) for g, c in own[n].items() if g in of), candidate - n
        if not n and not match:
            return 0.0
        missed += not match
        logs += math.log(match / total if match else 1 / (2**missed * total))
    return min(1.0, math.exp(min(0.0, 1 - reference / candidate) + logs / used))


@functools.lru_cache(maxsize=1024)
def _item_tokens(text: str) -> tuple[str, ...]:
    """The tokens of an item; texts of a pair share many."""
    return tuple(t.text for t in tokens(text))


@functools.lru_cache(maxsize=4)
def scope_tokens(text: str, scope: str) -> tuple[str, ...]:
    """The tokens of what a scope compares, each item behind its kind; the last few texts are kept, as pairs share theirs."""
    return tuple(t for x in contracts.scoped_items(text, scope) for t in (x["kind"], *_item_tokens(x["normalized"])))


@functools.lru_cache(maxsize=4)
def _scope_counts(text: str, scope: str) -> tuple[int, list[dict]]:
    words = scope_tokens(text, scope)
    return len(words), gram_counts(words, 4)


def similarity(generated: str, ground: str, scope: str) -> float:
    """BLEU of the scope's tokens; a text against itself has 1, whatever it holds."""
    if generated == ground:
        return 1.0
    return bleu_of_counts(*_scope_counts(generated, scope), *_scope_counts(ground, scope))


# The clause kinds of the scopes whose size is measured; full has all of them.
SIZE_KINDS = {
    "spec_only": frozenset(("requires", "ensures", "default_ensures", "returns", "recommends", "opens_invariants", "spec_fn_body")),
    "proof": frozenset(("assert", "decreases", "invariant", "invariant_except_break")),
}


def size(text: str, scope: str) -> dict:
    """Nodes, depth, quantifiers and vocabulary over the clauses of a scope and the bodies of specification functions."""
    units = [(c.kind, c.text) for c in specs.clauses(text) if c.kind != "no_unwind"]
    units += [("spec_fn_body", f.body) for f in specs.functions(text) if f.mode == "spec" and f.body]
    found = [specs.structure(t) for k, t in units if scope == "full" or k in SIZE_KINDS[scope]]
    words = {w for s in found for w in s.operators}, {w for s in found for w in s.variables}
    return {"nodes": sum(s.nodes for s in found), "depth": max((s.depth for s in found), default=0), "quantifiers": sum(s.quantifiers for s in found), "vocabulary": len(words[0]) + len(words[1]), "failed": sum(not s.ok for s in found)}


def _similar(scope: str) -> Score:
    def score(generated: Column, ground: Column) -> Column:
        f = lambda g, r: None if g is None or r is None else similarity(g, r, scope)
        return known(applied(f, "double", generated["text"], ground["text"]))

    return score


def _sized(scope: str) -> Score:
    """The number of nodes as the score; sizes() has the other counts."""

    def score(generated: Column, ground: Column) -> Column:
        s = sizes(generated["text"], scope)
        return _out(F.when(s["nodes"].isNull(), "not_available").when(s["failed"] > 0, "partial").otherwise("ok"), s["nodes"])

    return score


def sizes(text: Column, scope: str) -> Column:
    kinds = "struct<nodes:int,depth:int,quantifiers:int,vocabulary:int,failed:int>"
    return applied(lambda t: None if t is None else size(t, scope), kinds, text)


@dataclass(frozen=True)
class Measure:
    name: str
    title: str
    category: str
    direction: str  # higher, lower or descriptive
    needs: tuple[str, ...]  # fields of the evidence
    score: Score


def _one(field: str, f: Callable[[Column], Column]) -> Score:
    return lambda g, r: f(g[field])


#: Names, categories and directions.
MEASURES: dict[str, Measure] = {
    m.name: m
    for m in (
        Measure("textual_similarity", "Textual similarity, everything", "text_quality", "higher", ("text",), _similar("full")),
        Measure("textual_similarity_spec_only", "Textual similarity, specification", "text_quality", "higher", ("text",), _similar("spec_only")),
        Measure("textual_similarity_proof", "Textual similarity, proof", "text_quality", "higher", ("text",), _similar("proof")),
        Measure("trivial_spec_ratio", "Triviality", "spec_triviality", "lower", ("pre_false", "post_true"), lambda g, r: probes(g["pre_false"], g["post_true"])),
        Measure("llm_as_judge_intent_consistency", "Intent, judged by a model", "intent_consistency", "higher", ("frontend", "text", "judged"), lambda g, r: judge(g, r, g["judged"])),
        Measure("parse_rate", "Parses", "formal_validity", "higher", ("frontend",), _one("frontend", lambda o: front_end(o, o != "parse_error"))),
        Measure("type_check_rate", "Passes the front end", "formal_validity", "higher", ("frontend",), _one("frontend", lambda o: front_end(o, o == "ok"))),
        Measure("verification_pass_rate", "Verifies", "formal_validity", "higher", ("verified",), _one("verified", lambda v: known(v.cast("double")))),
        Measure("llm_as_judge_spec_code_intent_consistency", "Intent of the code, judged by a model", "intent_consistency", "higher", ("frontend", "text", "judged_code"), lambda g, r: judge(g, r, g["judged_code"])),
        Measure("proportion_at_least_gt", "Functions not weaker than the reference", "spec_reliability", "higher", ("at_least",), _one("at_least", among_decided)),
        Measure("postcondition_clause_reliability_rate", "Reliable postconditions", "spec_reliability", "higher", ("post_reliability",), _one("post_reliability", among_decided)),
        Measure("precondition_clause_reliability_rate", "Reliable preconditions", "spec_reliability", "higher", ("pre_reliability",), _one("pre_reliability", among_decided)),
        Measure("wrong_io_reject_rate", "Wrong outputs rejected", "io_testing", "higher", ("io_wrong",), _one("io_wrong", among_all)),
        Measure("proportion_at_most_gt", "Functions not stronger than the reference", "spec_completeness", "higher", ("at_most",), _one("at_most", among_decided)),
        Measure("postcondition_clause_completeness_rate", "Complete postconditions", "spec_completeness", "higher", ("post_completeness",), _one("post_completeness", among_decided)),
        Measure("precondition_clause_completeness_rate", "Complete preconditions", "spec_completeness", "higher", ("pre_completeness",), _one("pre_completeness", among_decided)),
        Measure("correct_io_pass_rate", "Right outputs accepted", "io_testing", "higher", ("io_correct",), _one("io_correct", among_all)),
        Measure("invalid_test_filtering_rate", "Invalid inputs rejected", "io_testing", "higher", ("io_invalid",), _one("io_invalid", among_all)),
        Measure("mutation_kill_rate", "Mutants killed", "robustness", "higher", ("verified", "mutants"), lambda g, r: kills(g["verified"], g["mutants"])),
        Measure("spec_redundancy_rate", "Removable clauses", "simplicity", "lower", ("verified", "removals"), lambda g, r: removals(g["verified"], g["removals"])),
        Measure("spec_size_complexity", "Size, everything", "spec_size", "descriptive", ("text",), _sized("full")),
        Measure("spec_size_complexity_spec_only", "Size, specification", "spec_size", "descriptive", ("text",), _sized("spec_only")),
        Measure("spec_size_complexity_proof", "Size, proof", "spec_size", "descriptive", ("text",), _sized("proof")),
        Measure("verification_time", "Seconds to verify", "time_efficiency", "lower", ("seconds",), _one("seconds", known)),
    )
}

#: The types of the fields of evidence.
EVIDENCE = {
    "text": "string", "frontend": "string", "verified": "boolean", "seconds": "double", "pre_false": "boolean", "post_true": "boolean",
    "at_least": "array<boolean>", "at_most": "array<boolean>", "pre_reliability": "array<boolean>", "pre_completeness": "array<boolean>",
    "post_reliability": "array<boolean>", "post_completeness": "array<boolean>", "io_correct": "array<string>", "io_wrong": "array<string>",
    "io_invalid": "array<string>", "mutants": "array<string>", "removals": "array<string>", "judged": "double", "judged_code": "double",
}


def removal_plan(text: str) -> list[dict]:
    """Deletions that a prover is asked about, in order: each clause of a proof alone, then all that proved removable together,
    then one at a time until nothing changes. Contracts are never candidates, as a weaker one always verifies. A row has the
    clause's id, kind, place and text; attempts() bounds how many deletions are tried."""
    out, seen = [], Counter()
    for c in specs.clauses(text):
        if c.kind in SIZE_KINDS["proof"]:
            key = (c.kind, c.normalized)
            out.append({"id": f"{c.kind}:{len(out)}", "kind": c.kind, "text": c.text, "occurrence": seen[key]})
            seen[key] += 1
    return out


def attempts(candidates: int, most: int = 60) -> int:
    """Deletions tried at most: single ones, joint ones and the fix-point."""
    return max(most, 3 * candidates + 4)


def satisfiability_items(text: str) -> list[dict]:
    """What is asked about preconditions: for each function with a precondition its name, parameters and conjunction, and
    whether it is settled without a solver: false on its face, or true whatever the values."""
    out = []
    for f in specs.functions(text):
        pre = specs.contract(f)["requires"]
        if f.mode == "exec" and pre != ["true"]:
            whole = " && ".join(f"({p})" for p in pre)
            settled = False if specs.contradictions(" && ".join(pre)) else True if all(specs.tautology(p) for p in pre) else None
            out.append({"name": f.name, "parameters": [f"{n}: {re.sub(chr(92) + 's+', ' ', t)}" for n, t in f.parameters], "condition": whole, "satisfiable": settled})
    return out

"""Contracts as values and as edits: deciding one on given inputs, writing clauses in and out of a function, variants of a
specification, candidate cases, canonical keys. Texts are parsed, never evaluated as code."""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re

from trivane.functions.lexer import Token, normalized, partner, remember, strip_comments, stripped, text_of, tokens, top_level
from trivane.functions.specs import KINDS, _Expression, Function, clauses, functions, splice, value_variants, weaker_stronger

LOWEST, HIGHEST, SPAN = -64, 256, (-1, 10)
# Ranges of types that a quantifier may bind.
UNSIGNED = frozenset(("nat", "u8", "u16", "u32", "u64", "u128", "usize"))


class _Open(Exception):
    """The value isn't known."""


def domain(env: dict) -> list[int]:
    """The integers that quantifiers range over: -1 to 10, and those next to the inputs and their parts and lengths."""
    near = set(range(SPAN[0], SPAN[1] + 1))
    todo = list(env.values())
    while todo:
        v = todo.pop()
        if isinstance(v, bool) or v is None:
            continue
        if isinstance(v, int):
            near |= {v - 1, v, v + 1}
        elif isinstance(v, (list, tuple, str)):
            near |= {len(v) - 1, len(v), len(v) + 1}
            todo += list(v) if not isinstance(v, str) else []
    return sorted(x for x in near if LOWEST <= x <= HIGHEST)


def decide(text: str, env: dict) -> bool | None:
    """Whether a condition holds for the values in env; None where a name or a construct isn't known. A false premise makes
    an implication true whatever follows, and one false conjunct decides a conjunction."""
    toks = tokens(text.strip().rstrip(",;"))
    if not toks:
        return True
    return _decide(toks, env)


def _decide(toks: list, env: dict) -> bool | None:
    while len(toks) > 1 and toks[0].text == "(" and toks[-1].text == ")" and len(top_level(toks[1:-1], "\0")) == 1 and _closes(toks):
        toks = toks[1:-1]
    if not toks:
        return True
    if toks[0].text in ("forall", "exists") and len(toks) > 1 and toks[1].text == "|":
        end = next((k for k in range(2, len(toks)) if toks[k].text == "|"), None)
        if end is None:
            return None
        binders = [(p[0].text, p[2].text if len(p) > 2 else "int") for p in top_level(toks[2:end], ",", True)]
        values = domain(env)
        every = toks[0].text == "forall"
        unknown = False
        ranges = [[v for v in values if t not in UNSIGNED or v >= 0] for _, t in binders]
        for combo in itertools.product(*ranges):
            got = _decide(toks[end + 1 :], env | {n: v for (n, _), v in zip(binders, combo, strict=True)})
            if got is (not every):
                return got
            unknown |= got is None
        return None if unknown else every
    for op in ("<==>", "==>", "|||", "&&&", "||", "&&"):
        parts = _cut(toks, op)
        if len(parts) == 1:
            continue
        if op == "<==>":
            a, b = _decide(parts[0], env), _decide([t for p in parts[1:] for t in p], env)
            return None if a is None or b is None else a == b
        if op == "==>":
            left = _decide(parts[0], env)
            if left is False:
                return True
            rest = toks[len(parts[0]) + 1 :]
            right = _decide(rest, env)
            return right if left else (True if right else None)
        got = [_decide(p, env) for p in parts]
        stop = op in ("||", "|||")
        return stop if stop in got else None if None in got else not stop
    if toks[0].text == "!":
        got = _decide(toks[1:], env)
        return None if got is None else not got
    try:
        return bool(_value(toks, env))
    except (_Open, ArithmeticError, LookupError, TypeError, ValueError):
        return None


def _closes(toks: list) -> bool:
    depth = 0
    for k, t in enumerate(toks):
        depth += (t.text == "(") - (t.text == ")")
        if not depth:
            return k == len(toks) - 1
    return False


def _cut(toks: list, op: str) -> list[list]:
    out, depth, k = [[]], 0, 0
    while k < len(toks):
        x = toks[k].text
        depth += (x in "([{") - (x in ")]}") if len(x) == 1 else 0
        if x in ("forall", "exists") and not depth:  # its body reaches to the end
            out[-1] += toks[k:]
            break
        if x == op and not depth:
            out.append([])
        else:
            out[-1].append(toks[k])
        k += 1
    return out


def _value(toks: list, env: dict):
    """The value of an arithmetic expression or a chain of comparisons."""
    chain, ops, depth = [[]], [], 0
    for t in toks:
        x = t.text
        depth += (x in "([{") - (x in ")]}") if len(x) == 1 else 0
        if x in ("==", "!=", "<", "<=", ">", ">=", "=~=") and not depth:
            chain.append([])
            ops.append(x)
        else:
            chain[-1].append(t)
    if ops:
        vals = [_value(c, env) for c in chain]
        test = {"==": lambda a, b: a == b, "=~=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
        return all(test[o](a, b) for o, a, b in zip(ops, vals, vals[1:], strict=False))
    e = _Expression(toks)
    node = e.parse()
    if not e.ok or e.k < len(toks):
        raise _Open
    return _node(node, env)


def _node(node: tuple, env: dict):
    kind, name, kids = node
    if kind == "atom":
        if name in env:
            return env[name]
        if name in ("true", "false"):
            return name == "true"
        if name == "None":
            return None
        raise _Open
    if kind == "number":
        return float(name) if "." in name else int(name)
    if kind == "op" and name in ("+", "-", "*", "/", "%"):
        v = [_node(k, env) for k in kids]
        if len(v) == 1:
            return -v[0]
        return {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a // b, "%": lambda a, b: a % b}[name](*v)
    if kind == "op" and name in ("as", "ref"):
        return _node(kids[0], env)
    if kind == "op" and name == "!":
        return not _node(kids[0], env)
    if kind == "field" and name in ("@", "view"):
        return _node(kids[0], env)
    if kind == "index":
        return _node(kids[0], env)[_node(kids[1], env)]
    if kind == "call" and kids[0][0] == "field":
        _, method, (target,) = kids[0]
        v = _node(target, env)
        args = [_node(a, env) for a in (kids[1][2] if kids[1][0] == "group" else [kids[1]])]
        if method == "len" and not args:
            return len(v)
        if method == "contains" and len(args) == 1:
            return args[0] in v
        if method in ("is_some", "is_Some"):
            return v is not None
        if method in ("is_none", "is_None"):
            return v is None
    if kind == "group" and len(kids) == 1:
        return _node(kids[0], env)
    raise _Open


# edits


def _groups(f: Function) -> list[tuple[str, int, int, list[tuple[int, int]]]]:
    """Clause groups of a header: kind, start and end of the word, and the spans of their parts (offsets in the header)."""
    toks = tokens(f.header)
    out, k = [], 0
    depth = 0
    while k < len(toks):
        x = toks[k].text
        depth += (x in "([{") - (x in ")]}") if len(x) == 1 else 0
        if not depth and x in KINDS and (not k or toks[k - 1].text not in (".", "::")):
            end, inner = k + 1, 0
            while end < len(toks):
                y = toks[end].text
                if not inner and y in KINDS and toks[end - 1].text not in (".", "::"):
                    break
                inner += (y in "([{") - (y in ")]}") if len(y) == 1 else 0
                end += 1
            parts = [(p[0].start, p[-1].end) for p in top_level(toks[k + 1 : end])]
            out.append((x, toks[k].start, toks[k].end, parts))
            k = end
        else:
            k += 1
    return out


def insert_clause(text: str, name: str, kind: str, clause: str) -> str:
    """A clause added to a function: after the word of its kind, or with a new word; requires come first, ensures last."""
    f = next(f for f in functions(text) if f.name == name)
    clause = clause.strip().rstrip(",;")
    groups = _groups(f)
    same = next((g for g in groups if g[0] == kind), None)
    if same:
        at, new = same[2], f" {clause},"
    elif kind == "requires" and groups:
        at, new = groups[0][1], f"{kind} {clause}, "
    else:
        at, new = len(f.header), f" {kind} {clause},"
        last = f.header.rstrip()
        if groups and not last.endswith((",",)):
            new = "," + new
    return splice(text, [(f.start + at, f.start + at, new)])


def remove_clause(text: str, name: str, kind: str, index: int) -> str:
    """A function without one of its clauses, and without the word if it was the only one."""
    f = next(f for f in functions(text) if f.name == name)
    parts = [(g, k) for g in _groups(f) if g[0] == kind for k in range(len(g[3]))]
    (_, start, _, spans), k = parts[index]
    if len(spans) == 1:
        end = spans[0][1]
        tail = re.match(r"\s*,", f.header[end:])
        span = (start, end + (tail.end() if tail else 0))
    elif k < len(spans) - 1:
        span = (spans[k][0], spans[k + 1][0])
    else:
        span = (spans[k - 1][1], spans[k][1])
    return splice(text, [(f.start + span[0], f.start + span[1], "")])


OPERATORS = ("PRE_ADD", "PRE_REMOVE", "PRE_REFINE", "PRE_RELAX", "POST_ADD", "POST_REMOVE", "POST_REFINE", "POST_RELAX")


def variants(text: str, name: str, seed: str = "", proposals: tuple[str, ...] = (), budget: int = 3) -> list[dict]:
    """Controlled changes of a contract: up to budget per operator, each text once, in the order of a seeded hash (a stated
    order takes the place of a random shuffle, so that every engine draws the same)."""
    out = []
    f = next((f for f in functions(text) if f.name == name), None)
    if f is None:
        return out
    for operator in OPERATORS:
        kind, action = ("requires" if operator.startswith("PRE") else "ensures"), operator.split("_")[1]
        own = [(g, k) for g in _groups(f) if g[0] == kind for k in range(len(g[3]))]
        clause = lambda g, k: f.header[slice(*g[3][k])]  # noqa: B023, E731
        edits: list[tuple[str, str, str]] = []
        if action == "ADD":
            there = {normalized(clause(g, k)) for g, k in own}
            edits = [(insert_clause(text, name, kind, p), "", p) for p in proposals if normalized(p) not in there]
        elif action == "REMOVE" and len(own) >= 2:
            edits = [(remove_clause(text, name, kind, i), clause(g, k), "") for i, (g, k) in enumerate(own)]
        elif action in ("REFINE", "RELAX"):
            way = "strengthening" if action == "REFINE" else "weakening"
            for g, k in own:
                old = clause(g, k)
                s, e = g[3][k]
                edits += [(splice(text, [(f.start + s, f.start + e, new)]), old, new) for w, new in weaker_stronger(old) if w == way]
        if action != "ADD":
            edits.sort(key=lambda x: hashlib.sha256(f"{seed}|{operator}|{x[1]}|{x[2]}".encode()).hexdigest())
        seen = set()
        for new_text, old, new in edits:
            key = hashlib.sha256(new_text.encode()).hexdigest()
            if key not in seen and len(seen) < budget:
                seen.add(key)
                out.append({"operator": operator, "kind": kind, "old": old, "new": new, "text": new_text, "rank": len(seen)})
    return out


def text_items(text: str) -> list[dict]:
    """What is compared of a text, in order of place: specification and proof functions whole, the clauses outside them,
    and proof blocks of assertions."""
    return [dict(x) for x in _text_items(text)]


def _outside(rest: str, toks: list[Token], spans: list[tuple[int, int]]) -> list[Token]:
    """The tokens of a text whose spans have become blanks: those outside, if every one is wholly in or out and no lone quote
    may find another one; else the text is scanned again. Spans begin in order."""
    out, k, inside = [], 0, 0
    for t in toks:
        while k < len(spans) and spans[k][0] <= t.start:
            inside = max(inside, spans[k][1])
            k += 1
        if t.start >= inside:
            if t.text == "'" or k < len(spans) and t.end > spans[k][0]:
                return tokens(rest)
            out.append(t)
        elif t.end > inside:
            return tokens(rest)
    return out


@functools.lru_cache(maxsize=4)
def _text_items(text: str) -> tuple[dict, ...]:
    """The items of a text; those that ask for its scopes do so one after another, so the last few texts are kept."""
    clean, toks = stripped(text)
    remember(clean, toks)
    one_line = lambda x: " ".join(x.split())
    out, kept, spans, at = [], [], [], 0
    for f in functions(clean):
        if f.mode in ("spec", "proof"):
            out.append({"kind": f"{f.mode}_fn", "normalized": one_line(clean[f.start : f.end]), "start": f.start})
            # Nested functions are in the blank that the outer one leaves.
            kept += [clean[at : f.start], re.sub(r"[^\n]", " ", clean[max(at, f.start) : f.end])]
            at = max(at, f.end)
            spans.append((f.start, f.end))
    rest = "".join([*kept, clean[at:]])
    toks = _outside(rest, toks, spans)
    remember(rest, toks)
    at = 0
    for c in clauses(rest):
        pos = rest.find(c.text, at)
        if pos >= 0:
            at = pos + len(c.text)
        out.append({"kind": c.kind, "normalized": one_line(c.text), "start": max(pos, 0)})
    for k, t in enumerate(toks[:-1]):
        if t.text == "by" and toks[k + 1].text == "{":
            end = partner(toks, k + 1)
            if end is not None:
                out.append({"kind": "assert_by", "normalized": one_line(text_of(rest, toks[k + 1 : end + 1])), "start": toks[k + 1].start})
    return tuple(sorted(out, key=lambda x: x["start"]))


# What each scope of text comparison looks at; full looks at everything.
SCOPE_KINDS = {
    "spec_only": frozenset(("requires", "ensures", "default_ensures", "returns", "recommends", "spec_fn")),
    "proof": frozenset(("invariant", "invariant_except_break", "assert", "assert_by", "decreases", "proof_fn")),
}


def scoped_items(text: str, scope: str) -> list[dict]:
    found = text_items(text)
    return found if scope == "full" else [x for x in found if x["kind"] in SCOPE_KINDS[scope]]


def callees(body: str) -> list[str]:
    """Names called in a body, sorted, each once; words of the language and macros aside."""
    toks = tokens(body)
    words = {"if", "while", "match", "for", "return", "assert", "assume", "requires", "ensures", "invariant", "forall", "exists", "Some", "Ok", "Err", "fn", "by", "let", "old"}
    out = set()
    for k, t in enumerate(toks[:-1]):
        if t.kind == "word" and toks[k + 1].text == "(" and t.text not in words:
            name, j = t.text, k
            while j >= 2 and toks[j - 1].text == "::" and toks[j - 2].kind == "word":
                name, j = f"{toks[j - 2].text}::{name}", j - 2
            if j == 0 or toks[j - 1].text not in ("fn", "."):
                out.add(name)
    return sorted(out)


def binding_issues(ref: Function | None, gen: Function | None) -> list[str]:
    """Why a generated function can't be bound to its reference: missing, numbers or types of parameters or returns."""
    if ref is None or gen is None:
        return ["missing_reference" if ref is None else "missing_generated"]
    from trivane.functions.specs import signature_issues

    return sorted({i.split(":")[0] for i in signature_issues(ref, gen)})


def canonical_json(value, compact: bool = True) -> str:
    """JSON with sorted keys; with or without a blank after separators, as each kind of key needs it."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":") if compact else None, default=str)


def case_key(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()[:16]


def candidate_cases(seeds: list[dict], constants: tuple[int, ...] = (), most: int = 256) -> list[dict]:
    """Inputs to try: the seeds, then each with one value moved to an edge, each once by key, at most so many."""
    out, seen = [], set()

    def add(case: dict) -> None:
        key = case_key(case)
        if key not in seen and len(out) < most:
            seen.add(key)
            out.append(case)

    for s in seeds:
        add(s)
    for s in seeds:
        for name, value in s.items():
            for v in value_variants(value, constants):
                add({**s, name: v})
    return out

"""Binding a generated function to its reference by position, and clauses written as predicates over the common values.

Every parameter and returned value of the two functions gets one name that both sides share; a mutable one gets two, for its
value before and after. A clause of either side then becomes a predicate whose parameters bear that side's own names and are
called with the shared ones, so that identifiers in its text need no renaming; only old(name) does."""

from __future__ import annotations

import re

from trivane.functions.lexer import tokens
from trivane.functions.parsing import _udf
from trivane.functions.specs import Function, functions

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
_MUTABLE = re.compile(r"\s*&\s*(?:'[A-Za-z_]\w*\s*)?mut\b\s*")
_LIFETIME = re.compile(r"'[A-Za-z_]\w*\s*")


def _bare(kind: str) -> str:
    return re.sub(r"\s+", "", _LIFETIME.sub("", kind)).replace(",)", ")")


def _generics(f: Function) -> tuple[str, str]:
    """What stands between angle brackets after a function's name, and its where clause, as words."""
    toks = tokens(f.header)
    k = next((i for i, t in enumerate(toks) if t.text == "fn"), 0) + 2
    inside: list[str] = []
    if k < len(toks) and toks[k].text == "<":
        depth = 0
        for t in toks[k:]:
            depth += (t.text == "<") - (t.text == ">")
            if not depth:
                break
            inside.append(t.text)
    where: list[str] = []
    at = next((i for i, t in enumerate(toks) if t.text == "where"), None)
    if at is not None:
        for t in toks[at + 1 :]:
            if t.text in ("requires", "ensures", "recommends", "decreases"):
                break
            where.append(t.text)
    return " ".join(inside[1:]), " ".join(where)


def plan(ref: Function | None, gen: Function | None) -> dict:
    """{issue} with its first reason, or {values, generics, where, mode}.

    A value has category (parameter or return), position, reference and generated name, kind (its type, without a mutable reference),
    shared name, and old: the shared name of its value before, for mutable ones."""
    if ref is None or gen is None:
        return {"issue": "missing_reference" if ref is None else "missing_generated"}
    if ref.mode != gen.mode:
        return {"issue": "mode"}
    if _generics(ref) != _generics(gen):
        return {"issue": "generic_context"}
    values = []
    for category, own, theirs in (("parameter", ref.parameters, gen.parameters), ("return", ref.returns, gen.returns)):
        if len(own) != len(theirs):
            return {"issue": f"{category}_count"}
        short = "arg" if category == "parameter" else "ret"
        for i, ((a, kind), (b, other)) in enumerate(zip(own, theirs, strict=True)):
            if not _NAME.match(a) or not _NAME.match(b):
                return {"issue": f"{category}_name:{i}"}
            if not kind or not other or _bare(kind) != _bare(other):
                return {"issue": f"{category}_type:{i}"}
            mutable = category == "parameter" and _MUTABLE.match(kind)
            values.append({"category": category, "position": i, "reference": a, "generated": b, "kind": kind[mutable.end() :].strip() if mutable else kind, "shared": f"__{short}{i}", "old": f"__old_{short}{i}" if mutable else None})
    generics, where = _generics(ref)
    return {"values": values, "generics": generics, "where": where, "mode": ref.mode}


def wrapper(bound: dict, clause: str, kind: str, side: str, name: str) -> dict | None:
    """{text, body, call}: a clause of a side (reference or generated) as a predicate, and how it is called with the shared names.

    In a precondition a mutable value is that before; elsewhere old(x) and old(*x) become a parameter of their own."""
    if "issue" in bound or not _NAME.match(name):
        return None
    values = bound["values"]
    used = {v[side] for v in values}
    old: dict[str, str] = {}
    for v in values:
        if v["old"]:
            new, n = f"__old_{v[side]}", 2
            while new in used:
                new, n = f"__old_{v[side]}_{n}", n + 1
            used.add(new)
            old[v[side]] = new
    known = {v[side]: old.get(v[side], v[side]) for v in values if v["category"] == "parameter"}
    toks, edits, asked, k = tokens(clause), [], set(), 0
    while k < len(toks):
        star = k + 2 < len(toks) and toks[k + 2].text == "*"
        at = k + 2 + star
        if toks[k].text == "old" and at + 1 < len(toks) and toks[k + 1].text == "(" and toks[at + 1].text == ")" and toks[at].text in known and not (k and toks[k - 1].text in (".", "::")):
            new = known[toks[at].text]
            edits.append((toks[k].start, toks[at + 1].end, f"(*{new})" if star else new))
            asked.add(toks[at].text)
            k = at + 2
        else:
            k += 1
    body = clause
    for start, end, new in reversed(edits):
        body = body[:start] + new + body[end:]
    early = kind in ("requires", "recommends")
    parameters = [(v[side], v["kind"], v["old"] if early and v["old"] else v["shared"]) for v in values]
    parameters += [(old[v[side]], v["kind"], v["old"]) for v in values if v["old"] and v[side] in asked]
    generics = f"<{bound['generics']}>" if bound["generics"] else ""
    where = f" where {bound['where']}" if bound["where"] else ""
    text = f"spec fn {name}{generics}({', '.join(f'{n}: {t}' for n, t, _ in parameters)}) -> bool{where} {{ {body} }}"
    return {"text": text, "body": body, "call": f"{name}({', '.join(a for _, _, a in parameters)})"}


@_udf("struct<issue:string,values:array<struct<category:string,position:int,reference:string,generated:string,kind:string,shared:string,old:string>>,generics:string,where:string,mode:string>")
def binding(reference, generated, name):
    """The plan for the function of this name in two texts."""
    pick = lambda t: next((f for f in functions(t or "") if f.name == name), None)
    got = plan(pick(reference), pick(generated))
    return {k: got.get(k) for k in ("issue", "values", "generics", "where", "mode")}


@_udf("struct<text:string,body:string,call:string>")
def clause_predicate(reference, generated, name, clause, kind, side):
    """A clause of a side as a predicate over the values that both functions share; null if they can't be bound."""
    pick = lambda t: next((f for f in functions(t or "") if f.name == name), None)
    return None if clause is None else wrapper(plan(pick(reference), pick(generated)), clause, kind, side, f"{name}_{side[:3]}")

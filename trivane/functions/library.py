"""Records of a library of specifications: a row for each public function of a source text.

library() is a table function for lateral joins. A function's text runs from its documentation to the end of its body, or to the
semicolon of a declaration without one (a body further on belongs to another function)."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from trivane.operators.search import CONCEPTS, OPERATIONS, STRUCTURES

# What a public function looks like, a call, and names that are never callees.
FUNCTION = re.compile(r"(?:^|\n)[ \t\r\f\v]*((?:[ \t]*///[^\n]*\n\s*)*)(?:#\[[^\]]+\]\s*)*pub\s+(?:(broadcast)\s+)?(proof|axiom|spec|exec|open\s+spec|closed\s+spec|uninterp\s+spec)\s+fn\s+(\w+)")
CALL = re.compile(r"(?:[A-Z][a-zA-Z0-9_]*::)*([a-z_][a-z0-9_]*)\s*\(")
NO_CALLEES = frozenset(
    "if else match while for loop break continue return let mut ref assert assume requires ensures decreases invariant old forall exists choose by via reveal hide is_some is_none is_ok is_err unwrap expect clone copy drop add sub mul div rem shl shr and or xor not".split()
)
#: Bodies beyond this are not kept.
BODY = 2000

SCHEMA = "name string, kind string, signature string, requires array<string>, ensures array<string>, triggers array<string>, callees array<string>, keywords array<string>, doc string, line int, body string"


def _end(text: str, at: int) -> tuple[int, int]:
    """(where the body begins, where the function's text ends) of what begins at a place; equal if there is no body."""
    stop = re.compile(r"[{;]").search(text, at)
    if stop is None or stop[0] == ";":
        end = len(text) if stop is None else stop.end()
        return end, end
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, stop.start()):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return stop.start(), m.end()
    return stop.start(), len(text)


def clauses(text: str, kind: str) -> list[str]:
    """The clauses after a keyword, up to the next keyword, the body or the end; a comma at a line's end parts them."""
    found = re.findall(rf"{kind}\s+(.*?)(?=\s*(?:requires|ensures|decreases|recommends|\{{|;))", text, re.S)
    return [p.strip().rstrip(",") for block in found for p in re.split(r",\s*\n", block.strip()) if p.strip()]


def keywords(text: str) -> list[str]:
    """Structures and concepts that a text contains, and operations that it has as a word; sorted."""
    return sorted({w for w in (*STRUCTURES, *CONCEPTS) if w in text} | {w for w in OPERATIONS if re.search(rf"\b{w}\b", text)})


def records(text: str) -> Iterator[dict]:
    """The public functions of a text in order; an open spec has no clauses or callees of its own."""
    for m in FUNCTION.finditer(text):
        docs, broadcast, kind, name = m.groups()
        kind = "_".join(kind.split()) if kind not in ("proof", "axiom", "spec", "exec") else kind
        if broadcast and kind in ("proof", "axiom"):
            kind = f"broadcast_{kind}"
        body_at, end = _end(text, m.end())
        head = text[m.end(1) : body_at]
        start = re.search(r"\bpub\s", head)
        signature = re.split(r"[{;]", head[start.start() :], maxsplit=1)[0].strip()
        body = text[body_at:end] if body_at < end else None
        if body is not None and (len(body) > BODY or not body.endswith("}")):
            body = None
        plain = kind == "open_spec"
        scope = text[m.start() : end]
        pre, post = ([], []) if plain else (clauses(scope, "requires"), clauses(scope, "ensures"))
        called = {c for c in CALL.findall(body) if c not in NO_CALLEES} if body and not plain else set()
        doc = "\n".join(x.strip()[3:].strip() for x in (docs or "").split("\n") if x.strip().startswith("///")).strip()
        yield {
            "name": name, "kind": kind, "signature": signature, "requires": pre, "ensures": post,
            "triggers": [t.strip() for c in post for t in re.findall(r"#\[trigger\]\s*([^,\n\)]+)", c)],
            "callees": sorted(called), "keywords": keywords(" ".join([signature, *pre, *post])), "doc": doc or None,
            "line": text.count("\n", 0, m.start()) + 1, "body": body,
        }


class _Records:
    def eval(self, text: str):
        if text is not None:
            for row in records(text):
                yield tuple(row.values())


def library(text: Column):
    """The public functions of a source text, as a table function; a null text has none."""
    from pyspark.sql.functions import udtf

    return udtf(_Records, returnType=SCHEMA)(F.coalesce(text, F.lit("")))

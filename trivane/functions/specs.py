"""What specification texts hold: clauses, functions with contracts, expression structure, vacuous and contradictory
conditions, and the small edits that tests are made of. Plain Python on one text; trivane.functions.parsing puts it into
columns."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

from trivane.functions.lexer import CLOSE, OPEN, Token, normalized, partner, split_commas, strip_comments, text_of, tokens, top_level

# The kinds of clauses, in their order of report.
CLAUSE_KINDS = ("requires", "ensures", "default_ensures", "returns", "recommends", "opens_invariants", "invariant", "invariant_except_break", "assert", "decreases", "no_unwind")
KINDS = frozenset(CLAUSE_KINDS)
LIST_KINDS = KINDS - {"assert", "no_unwind"}
_ENDS = KINDS | {";", "{"}


@dataclass(frozen=True)
class Clause:
    kind: str
    text: str
    normalized: str


# clauses


def _ends_clause(toks: list[Token], k: int, first: int) -> bool:
    """Whether the token at k, outside brackets, ends a clause list that began at first."""
    x = toks[k].text
    if x == ";" or x in KINDS and toks[k - 1].text not in (".", "::"):
        return True
    if x != "{":
        return False
    # A brace opens the body, unless an expression still needs it.
    if k == first:
        return False
    before = toks[k - 1].text
    if before == ",":
        return True
    if before == "else" or before in ("==>", "<==>", "==", "!=", "<=", ">=", "<", "=", "=>", "&&", "||", "&&&", "|||", "+", "-", "*", "/", "%", "!", "("):
        return False
    # The part that the brace follows; no comma stands before it.
    words = [t.text for t in top_level(toks[first:k])[-1]]
    return not any(w in ("if", "match", "else") for w in words) or "{" in words


def clauses(text: str) -> list[Clause]:
    """Clauses in order of appearance: comma-separated expressions after a clause word, asserted expressions, flags."""
    toks = tokens(text)
    out: list[Clause] = []
    k = 0
    while k < len(toks):
        word = toks[k].text if toks[k].kind == "word" else ""
        if word == "assert":
            k = _assertion(text, toks, k, out)
        elif word in LIST_KINDS or word == "no_unwind":
            end, depth = k + 1, 0
            while end < len(toks):
                x = toks[end].text
                if not depth and x in _ENDS and _ends_clause(toks, end, k + 1):
                    break
                depth += (x in OPEN) - (x in CLOSE)
                depth = max(0, depth)
                end += 1
            body = toks[k + 1 : end]
            if word == "no_unwind":
                whole = text_of(text, body) if body else "true"
                out.append(Clause(word, whole, normalized(whole)))
            else:
                out += [Clause(word, text_of(text, p), " ".join(t.text for t in p)) for p in top_level(body)]
            k = end
        else:
            k += 1
    return out


def _assertion(text: str, toks: list[Token], k: int, out: list[Clause]) -> int:
    nxt = toks[k + 1].text if k + 1 < len(toks) else ""
    if nxt == "!":
        return k + 1
    if nxt == "(" and (close := partner(toks, k + 1)) is not None:
        body, after = toks[k + 2 : close], close + 1
    else:
        after = k + 1
        while after < len(toks) and toks[after].text not in ("by", ";", "{"):
            after += 1
        body = toks[k + 1 : after]
    if body:
        out.append(Clause("assert", text_of(text, body), " ".join(t.text for t in body)))
    if after < len(toks) and toks[after].text == "by" and after + 1 < len(toks) and toks[after + 1].text in ("{", "("):
        close = partner(toks, after + 1)
        after = after + 1 if close is None else close + 1
    return after


def clause_counts(found: list[Clause]) -> dict[str, int]:
    counts = dict.fromkeys(CLAUSE_KINDS, 0)
    for c in found:
        counts[c.kind] += 1
    return counts


# functions


@dataclass(frozen=True)
class Function:
    name: str
    mode: str  # exec, spec or proof
    header: str
    body: str
    parameters: tuple[tuple[str, str], ...]
    returns: tuple[tuple[str, str], ...]
    start: int
    end: int


def _pairs(part: list[Token], source: str) -> tuple[tuple[str, str], ...]:
    out = []
    for p in top_level(part, ",", True):
        colon = next((k for k, t in enumerate(p) if t.text == ":"), None)
        if colon is None:
            name = " ".join(t.text for t in p if t.text not in ("&", "mut"))
            out.append((name, "Self" if name == "self" else ""))
        else:
            names = [t.text for t in p[:colon] if t.kind == "word" and t.text not in ("mut", "tracked", "ghost", "Tracked", "Ghost")]
            out.append((names[-1] if names else "", text_of(source, p[colon + 1 :]) if p[colon + 1 :] else ""))
    return tuple(out)


def functions(text: str) -> list[Function]:
    """Functions with their mode, header, body, parameters and returned names and types."""
    toks = tokens(text)
    out = []
    for k, t in enumerate(toks):
        if t.text != "fn" or k + 1 >= len(toks) or toks[k + 1].kind != "word":
            continue
        first = k
        while first and (toks[first - 1].text in ("pub", "open", "closed", "spec", "proof", "exec", "const", "unsafe", "broadcast", "tracked", "uninterp", "axiom", "async", "extern") or toks[first - 1].text == ")" and any(x.text == "pub" for x in toks[max(0, first - 5) : first])):
            first -= 1
        mods = {x.text for x in toks[first:k]}
        mode = "spec" if mods & {"spec", "uninterp"} else "proof" if mods & {"proof", "axiom"} else "exec"
        at = k + 2
        if at < len(toks) and toks[at].text == "<":
            angle = 0
            while at < len(toks):
                angle += (toks[at].text == "<") - (toks[at].text == ">")
                at += 1
                if not angle:
                    break
        close = partner(toks, at) if at < len(toks) and toks[at].text == "(" else None
        if close is None:
            continue
        params = _pairs(toks[at + 1 : close], text)
        returns: tuple[tuple[str, str], ...] = ()
        at = close + 1
        if at < len(toks) and toks[at].text == "->":
            if at + 1 < len(toks) and toks[at + 1].text == "(" and (end := partner(toks, at + 1)) is not None:
                inner = toks[at + 2 : end]
                returns = _pairs(inner, text) if any(x.text == ":" for x in inner) else (("result", text_of(text, toks[at + 1 : end + 1])),)
                at = end + 1
            else:
                end = at + 1
                while end < len(toks) and toks[end].text not in ("{", ";", "where", ",") and toks[end].text not in KINDS:
                    end += 1
                returns = (("result", text_of(text, toks[at + 1 : end])),) if end > at + 1 else ()
                at = end
        # The header runs to the body's brace or to a semicolon.
        depth, clause_from = 0, None
        while at < len(toks):
            x = toks[at].text
            if not depth and x in KINDS:
                clause_from = at + 1
            if not depth and (x == ";" or x == "{" and (clause_from is None or _ends_clause(toks, at, clause_from))):
                break
            depth = max(0, depth + (x in OPEN) - (x in CLOSE))
            at += 1
        header_end = toks[at].start if at < len(toks) else len(text)
        body, stop = "", header_end
        if at < len(toks) and toks[at].text == "{":
            end = partner(toks, at)
            stop = len(text) if end is None else toks[end].end
            body = text[toks[at].start : stop]
        out.append(Function(toks[k + 1].text, mode, text[toks[first].start : header_end].strip(), body, params, returns, toks[first].start, stop))
    return out


def contract(f: Function) -> dict[str, list[str]]:
    """requires and ensures of a function; default_ensures counts as ensures, and an empty side is one clause true."""
    found = clauses(f.header)
    pre = [c.normalized for c in found if c.kind == "requires"]
    post = [c.normalized for c in found if c.kind in ("ensures", "default_ensures")]
    return {"requires": pre or ["true"], "ensures": post or ["true"]}


def target(text: str, catalog: str | None = None, marker: str | None = None) -> str | None:
    """The function that a text is about: the catalogued one, the marked one, the last executable one with a contract, or
    the last executable one; main never is."""
    own = [f for f in functions(text) if f.mode == "exec" and f.name != "main"]
    names = {f.name for f in own}
    for wanted in (catalog, marker):
        if wanted and wanted in names:
            return wanted
    with_contract = [f for f in own if any(c.kind in ("requires", "ensures", "default_ensures") for c in clauses(f.header))]
    pool = with_contract or own
    return pool[-1].name if pool else None


def signature(f: Function) -> str:
    bare = lambda pairs: ",".join(f"{n}:{re.sub(chr(92) + 's+', '', t)}" for n, t in pairs)
    return f"{f.name}({bare(f.parameters)})->({bare(f.returns)})"


def signature_issues(ref: Function, gen: Function) -> list[str]:
    """Where two signatures differ in number or type, by position."""
    out = []
    for what, a, b in (("parameter", ref.parameters, gen.parameters), ("return", ref.returns, gen.returns)):
        if len(a) != len(b):
            out.append(f"{what}_count")
        out += [f"{what}_type:{k}" for k, (x, y) in enumerate(zip(a, b, strict=False)) if re.sub(r"\s+", "", x[1]) != re.sub(r"\s+", "", y[1])]
    return out


def masked(text: str, name: str) -> tuple[str, dict[str, list[str]]]:
    """The text without the contract of a function, and that contract."""
    f = next((f for f in functions(text) if f.name == name), None)
    if f is None:
        return text, {}
    toks = tokens(f.header)
    first = next((t for t in toks if t.text in ("requires", "ensures", "default_ensures")), None)
    if first is None:
        return text, {"requires": [], "ensures": []}
    cut = text[: f.start] + f.header[: first.start].rstrip() + " " + text[f.start + len(f.header) :].lstrip()
    found = clauses(f.header)
    return cut, {k: [c.normalized for c in found if c.kind == k] for k in ("requires", "ensures")}


def splice(text: str, edits: list[tuple[int, int, str]]) -> str:
    """All edits (start, end, replacement) at once; overlapping ones are an error."""
    out, at = [], 0
    for s, e, new in sorted(edits):
        if s < at or e < s:
            raise ValueError("overlapping edits")
        out += [text[at:s], new]
        at = e
    return "".join([*out, text[at:]])


def types(text: str) -> dict[str, str]:
    """Names of structs, enums and aliases with their definition, tokens joined by one blank."""
    toks = tokens(text)
    out = {}
    for k, t in enumerate(toks[:-1]):
        if t.text in ("struct", "enum", "type") and toks[k + 1].kind == "word":
            end = k + 2
            while end < len(toks) and toks[end].text not in ("{", ";", "("):
                end += 1
            if end < len(toks) and toks[end].text != ";":
                close = partner(toks, end)
                end = close if close is not None else len(toks) - 1
            out[toks[k + 1].text] = f"{t.text} " + " ".join(x.text for x in toks[k + 2 : end + 1] if x.text != ";")
    return out


# expressions

_BINDING = {"<==>": 1, "==>": 2, "|||": 3, "&&&": 4, "||": 5, "&&": 6, "==": 7, "!=": 7, "=~=": 7, "<": 8, "<=": 8, ">": 8, ">=": 8, "..": 9, "|": 10, "^": 11, "&": 12, "+": 13, "-": 13, "*": 14, "/": 14, "%": 14, "as": 15}
_LOGIC = {"<==>", "==>", "|||", "&&&", "||", "&&"}
_SAME = {"&&&": "&&", "|||": "||"}


@dataclass
class Structure:
    nodes: int = 0
    depth: int = 0
    quantifiers: int = 0
    alternation: int = 0
    operators: tuple[str, ...] = ()
    variables: tuple[str, ...] = ()
    ok: bool = True


class _Expression:
    """Precedence climbing over tokens. It never fails: what it can't read counts as an atom and clears ok."""

    def __init__(self, toks: list[Token]):
        self.t, self.k, self.ok = toks, 0, True

    def peek(self, ahead: int = 0) -> str:
        return self.t[self.k + ahead].text if self.k + ahead < len(self.t) else ""

    def parse(self, least: int = 0, level: int = 0) -> tuple:
        left = self.unary(level)
        while (op := self.peek()) in _BINDING and _BINDING[op] >= least:
            self.k += 1
            right_first = op in ("==>",)
            right = self.parse(_BINDING[op] + (not right_first), level + 1) if self.k < len(self.t) else self.bad()
            left = ("op", _SAME.get(op, op), [left, right])
        return left

    def bad(self) -> tuple:
        self.ok = False
        return ("atom", "", [])

    def unary(self, level: int) -> tuple:
        x = self.peek()
        if level > 200:
            self.ok = False
            self.k = len(self.t)
            return ("atom", "", [])
        if x in ("!", "-", "*", "&"):
            self.k += 1
            return ("op", x if x in ("!", "-") else "ref", [self.unary(level + 1)])
        if x in ("forall", "exists", "choose"):
            self.k += 1
            if self.peek() == "|":
                self.k += 1
                while self.k < len(self.t) and self.peek() != "|":
                    self.k += 1
                self.k += 1
            return ("quant", x, [self.parse(0, level + 1)])
        if x == "if":
            self.k += 1
            parts = [self.parse(0, level + 1)]
            while self.peek() in ("{", "else", "if"):
                if self.peek() == "{":
                    parts.append(self.group(level))
                else:
                    self.k += 1
                    if parts and self.peek() not in ("{", "if"):
                        break
                    if self.t[self.k - 1].text == "if":
                        parts.append(self.parse(0, level + 1))
            return ("op", "if", parts)
        return self.postfix(self.primary(level), level)

    def group(self, level: int) -> tuple:
        end = partner(self.t, self.k)
        stop = len(self.t) if end is None else end
        inner = _Expression(self.t[self.k + 1 : stop])
        parts = []
        while inner.k < len(inner.t):
            if inner.peek() in (",", ";"):
                inner.k += 1
                continue
            before = inner.k
            parts.append(inner.parse(0, level + 1))
            if inner.k == before:
                inner.k += 1
                inner.ok = False
        self.ok &= inner.ok and end is not None
        self.k = stop + 1
        return parts[0] if len(parts) == 1 else ("group", "", parts)

    def primary(self, level: int) -> tuple:
        if self.k >= len(self.t):
            return self.bad()
        t = self.t[self.k]
        if t.text in OPEN:
            return self.group(level)
        self.k += 1
        if t.kind in ("word", "number", "literal", "lifetime"):
            name = t.text
            while self.peek() == "::" and self.k + 1 < len(self.t):
                name += "::" + self.peek(1)
                self.k += 2
            return ("number" if t.kind == "number" else "atom", name if t.kind in ("word", "number") else "", [])
        return self.bad()

    def postfix(self, node: tuple, level: int) -> tuple:
        while True:
            x = self.peek()
            if x in ("(", "["):
                node = ("call" if x == "(" else "index", node[1] if node[0] == "atom" else "", [node, self.group(level)])
            elif x in (".", "@", "?"):
                self.k += 1
                field = self.t[self.k] if x == "." and self.k < len(self.t) else None
                if field is not None:
                    self.k += 1
                node = ("field", field.text if field else x, [node])
            else:
                return node


def structure(text: str) -> Structure:
    """Size and shape of an expression: nodes, depth of nested connectives (a chain of one connective is one level),
    quantifiers and their alternations, operators and free names."""
    e = _Expression(tokens(text))
    roots = []
    while e.k < len(e.t):
        before = e.k
        roots.append(e.parse())
        if e.k == before:
            e.k += 1
            e.ok = False
    out = Structure(ok=e.ok and len(roots) == 1)
    ops: set[str] = set()
    names: set[str] = set()
    todo = [(r, 0, "", "", 0) for r in roots]
    while todo:
        (kind, name, kids), depth, above, quant, turns = todo.pop()
        if kind != "group":
            out.nodes += 1
        if kind == "op":
            ops.add(name)
            if name in _LOGIC and name != above:
                depth += 1
        elif kind == "quant":
            ops.add(name)
            out.quantifiers += 1
            turns += bool(quant) and quant != name
            quant = name
        elif kind == "atom" and name and name not in ("true", "false"):
            names.add(name)
        out.depth, out.alternation = max(out.depth, depth), max(out.alternation, turns)
        todo += [(c, depth, name if kind == "op" else "", quant, turns) for c in kids]
    out.operators, out.variables = tuple(sorted(ops)), tuple(sorted(names))
    return out


def _bare(toks: list[str]) -> list[str]:
    """Without the parentheses around the whole."""
    while len(toks) >= 2 and toks[0] == "(" and toks[-1] == ")":
        depth = 0
        for k, t in enumerate(toks):
            depth += (t == "(") - (t == ")")
            if not depth and k < len(toks) - 1:
                return toks
        toks = toks[1:-1]
    return toks


def _parts(toks: list[str], op: str) -> list[list[str]]:
    out: list[list[str]] = [[]]
    depth = 0
    for t in toks:
        depth = max(0, depth + (t in OPEN) - (t in CLOSE))
        if t == op and not depth:
            out.append([])
        else:
            out[-1].append(t)
    return out


def _term(toks: list[str]) -> list[str]:
    """A term without neutral arithmetic: x + 0, x - 0, x * 1 and x / 1 are x, x - x and x * 0 are 0."""
    toks = _bare(toks)
    while len(toks) == 3:
        a, op, b = toks
        if op == "*" and "0" in (a, b) or op == "-" and a == b:
            new = ["0"]
        elif b == {"+": "0", "-": "0", "*": "1", "/": "1"}.get(op):
            new = [a]
        elif a == {"+": "0", "*": "1"}.get(op):
            new = [b]
        else:
            break
        toks = _bare(new)
    return toks


def _low(toks: list[str]) -> bool:
    toks = _bare(toks)
    return toks == ["true"] or len(toks) == 3 and toks[0] == toks[2] and toks[1] in ("==", "<=", ">=")


def _length(toks: list[str]) -> bool:
    """A term that ends in a call of len, and no comparison."""
    toks = _bare(toks)
    return toks[-4:] == [".", "len", "(", ")"] and not set(toks) & {"<", ">", "<=", ">=", "==", "!="}


def tautology(text: str, nonnegative: frozenset[str] = frozenset()) -> str | None:
    """Why an expression is true whatever its names mean, or None; nonnegative names are known to be at least 0."""
    return _tautology([t.text for t in tokens(text)], nonnegative)


def _tautology(toks: list[str], nonneg: frozenset[str]) -> str | None:
    toks = _bare(toks)
    again = lambda x: _tautology(x, nonneg)
    if not toks:
        return None
    if toks == ["true"]:
        return "literal_true"
    pairs = {op: x for op in ("==", "<=", ">=", "==>", "<==>") if len(x := _parts(toks, op)) == 2 and all(x)}
    for op in ("==", "<=", ">="):
        if op in pairs and _term(pairs[op][0]) == _term(pairs[op][1]):
            return "self_comparison" if all(_bare(x) == _term(x) for x in pairs[op]) else "arithmetic_identity"
    for op, reason in (("==>", "implication_self"), ("<==>", "equivalence_self")):
        if op in pairs and _bare(pairs[op][0]) == _bare(pairs[op][1]):
            return reason
    either = [_bare(p) for p in _parts(toks, "||")]
    if any(p[:1] == ["!"] and len(p) > 1 and _bare(p[1:]) == q for i, p in enumerate(either) for j, q in enumerate(either) if i != j):
        return "excluded_middle"
    if not set(toks) & {"==>", "<==>", "||", "&&", "|"}:
        at_least = [(pairs[op][k], pairs[op][1 - k]) for op, k in ((">=", 0), ("<=", 1)) if op in pairs]
        if any(_term(zero) == ["0"] and (_length(x) or len(x) == 1 and x[0] in nonneg) for x, zero in at_least):
            return "nonneg_tautology"
    if "==>" in pairs:
        first, last = pairs["==>"]
        if _bare(first) == ["false"] or _low(last) or again(last):
            return "low_information_implication"
    if toks[0] in ("forall", "exists") and toks[1:2] == ["|"]:
        bars = [k for k, t in enumerate(toks) if t == "|"]
        if len(bars) > 1 and again(toks[bars[1] + 1 :]):
            return "quantifier_trivial_body"
    both = _parts(toks, "&&")
    if len(either) > 1 and ["true"] in either or len(both) > 1 and all(again(p) for p in both):
        return "compound_tautology"
    # Conjuncts that are true fold away.
    left = [p for p in both if _bare(p) != ["true"]]
    if len(both) > len(left) > 0 and again([t for k, p in enumerate(left) for t in (["&&"] if k else []) + p]):
        return "compound_tautology"
    if toks[0] == "if":
        then, other = _branches(toks)
        if then and then == other and again(then):
            return "compound_tautology"
    return None


def _branches(toks: list[str]) -> tuple[list[str], list[str]]:
    """What stands after the first then, and after the first else behind it, outside brackets; empty where they are missing."""
    depth, at = 0, {}
    for k, t in enumerate(toks):
        depth = max(0, depth + (t in OPEN) - (t in CLOSE))
        if not depth and (t == "then" and not at or t == "else" and "then" in at and "else" not in at):
            at[t] = k
    if len(at) < 2:
        return [], []
    return _bare(toks[at["then"] + 1 : at["else"]]), _bare(toks[at["else"] + 1 :])


def contradictions(text: str) -> list[str]:
    """Findings that make a conjunction unsatisfiable on its face: false, x != x, bounds on a name that exclude each other."""
    toks = _bare([t.text for t in tokens(text)])
    out = set()
    if toks == ["false"]:
        out.add("literal_false")
    for a, op, b in zip(toks, toks[1:], toks[2:], strict=False):
        if a == b and op in ("!=", "<", ">"):
            out.add(f"self_contradiction:{a} {op} {b}")
    bounds: dict[str, dict[str, list[float]]] = {}
    for name, op, value in re.findall(r"\b([A-Za-z_]\w*) (<=|<|>=|>|==|!=) (-? ?\d+(?:\.\d+)?)(?![\w.])", " ".join(toks)):
        bounds.setdefault(name, {}).setdefault(op, []).append(float(value.replace(" ", "")))
    for name, by in bounds.items():
        above, below = [(v, 1) for v in by.get(">", [])] + [(v, 0) for v in by.get(">=", [])], [(v, 1) for v in by.get("<", [])] + [(v, 0) for v in by.get("<=", [])]
        for v in by.get("==", []):
            if v in by.get("!=", []):
                out.add(f"conflicting_equality:{name}")
            if any(v < b or s and v == b for b, s in above):
                out.add(f"equality_below_lower_bound:{name}")
            if any(v > b or s and v == b for b, s in below):
                out.add(f"equality_above_upper_bound:{name}")
        if above and below:
            lo, hi = max(above), min(below, key=lambda x: (x[0], -x[1]))
            if lo[0] > hi[0]:
                out.add(f"inconsistent_bounds:{name}")
            elif lo[0] == hi[0] and (lo[1] or hi[1]):
                out.add(f"strict_empty_interval:{name}")
    return sorted(out)


# Patterns of unsound or unfinished specifications, by kind.
BLACKLIST = (
    ("assume_false", r"\bassume\s*\(\s*false\s*\)"),
    ("assume_any", r"\bassume\s*\((?!\s*false\s*\))[^)]*\)"),
    ("admit", r"\badmit\s*\(\s*\)"),
    ("assume_specification", r"\bassume_specification\b"),
    ("external_body", r"#\s*\[\s*verifier\s*::\s*external_body\s*\]|\bexternal_body\b|\bverifier\s*::\s*external\b"),
    ("no_verify", r"\bno_verify\b|--no-verify\b"),
    ("trusted", r"\btrusted\b|trusted\s+spec"),
    ("unimplemented", r"\b(?:unimplemented|todo)\s*!\s*\(\s*\)"),
    ("axiom", r"#\s*\[\s*verifier\s*::\s*axiom\s*\]|\baxiom\b"),
)


def blacklisted(text: str) -> list[tuple[str, str]]:
    """(kind, snippet of at most 180 characters) of every match outside comments."""
    clean = strip_comments(text)
    return [(k, " ".join(m[0].split())[:180]) for k, p in BLACKLIST for m in re.finditer(p, clean, re.S | re.I)]


# edits and values


def value_variants(value, constants: tuple[int, ...] = ()) -> list:
    """Values near a value, at the edges of its kind: neighbours, 0, 1, -1 and constants for numbers; shorter, longer,
    reversed and repeated lists; the opposite of a truth value. Each once, the value itself left out."""
    out: list = []
    if isinstance(value, bool):
        out = [not value]
    elif isinstance(value, int):
        out = [value - 1, value + 1, 0, 1, -1, *constants]
    elif isinstance(value, str):
        out = ["", value[:-1], value[::-1], value + value[:1]]
    elif isinstance(value, list):
        out = [[], value[:1], value[:-1], value[::-1], value + value[-1:]]
        for k, x in enumerate(value[:8]):
            out += [[*value[:k], y, *value[k + 1 :]] for y in value_variants(x, constants)[:2]]
    elif value is None:
        out = [0]
    seen, unique = {repr(value)}, []
    for x in out:
        if repr(x) not in seen:
            seen.add(repr(x))
            unique.append(x)
    return unique


# Replacements of operators and literals, by family.
MUTATIONS = {
    "ROR": {"==": ("!=", "<", "<=", ">", ">="), "!=": ("==", "<", "<=", ">", ">="), "<=": ("<", ">", ">="), ">=": (">", "<", "<="), "<": ("<=", ">", ">="), ">": (">=", "<", "<=")},
    "AOR": {"+": ("-", "*"), "-": ("+",), "*": ("+", "-", "/"), "/": ("*", "%"), "%": ("/", "*")},
    "COR_LOR": {"&&": ("||",), "||": ("&&",)},
    "BOUNDARY": {"0": ("1", "-1"), "1": ("0", "2", "-1"), "-1": ("0", "1"), "true": ("false",), "false": ("true",)},
}
# Characters that, right before or after an operator, make it part of another one.
NEIGHBOURS = {"<": ("<>=!", "=<"), ">": ("<>=!-", "="), "+": ("+-*/%", "+="), "-": ("-=", ">=-"), "*": ("*/", "="), "/": ("/", "/=*"), "%": ("%", "="), "==": ("=!<>", ">")}


def _angles(toks: list[Token]) -> set[int]:
    """Positions of angle brackets around types: opened after :: or a capitalised name."""
    out, open_ = set(), []
    for k, t in enumerate(toks):
        if t.text == "<" and (open_ or k and (toks[k - 1].text == "::" or toks[k - 1].text[0].isupper())):
            open_.append(k)
        elif t.text == ">" and open_:
            out |= {open_.pop(), k}
        elif t.text in (";", "{", "}"):
            open_.clear()
    return out


def _executed(body: str) -> list[Token]:
    """The tokens of a body that run: without assertions, loop clauses and proof blocks."""
    toks, skip, out = tokens(body), 0, []
    for k, t in enumerate(toks):
        if k < skip:
            continue
        if t.text in KINDS or t.text in ("proof", "assert", "assume"):
            # Up to the brace, parenthesis or semicolon; a parenthesis or a proof's brace is skipped whole.
            end = k + 1
            while end < len(toks) and toks[end].text not in ("{", ";", "("):
                end += 1
            whole = end < len(toks) and (toks[end].text == "(" or t.text == "proof" and toks[end].text == "{")
            close = partner(toks, end) if whole else None
            skip = close + 1 if close is not None else end
            continue
        out.append(t)
    return out


def _edits(f: Function, toks: list[Token]) -> Iterator[tuple[str, str, int, int, str]]:
    """(family, operator, start, end, replacement) within the body."""
    angles = _angles(toks)
    near = lambda k: toks[k].text if 0 <= k < len(toks) else ""
    for k, t in enumerate(toks):
        before, after = f.body[t.start - 1 : t.start], f.body[t.end : t.end + 1]
        bad = NEIGHBOURS.get(t.text, ("", ""))
        alone = not (before and before in bad[0]) and not (after and after in bad[1]) and k not in angles
        for family, table in MUTATIONS.items():
            if t.text in table and (alone or t.kind != "op"):
                yield from ((family, family, t.start, t.end, new) for new in table[t.text])
        if t.text == "-" and near(k + 1) == "1" and toks[k + 1].start == t.end and not (before.isalnum() or before == "_"):
            yield from (("BOUNDARY", "BOUNDARY", t.start, t.end + 1, new) for new in MUTATIONS["BOUNDARY"]["-1"])
        if t.text in ("if", "while") and k + 1 < len(toks):
            if near(k + 1) == "!" and k + 2 < len(toks) and toks[k + 2].kind == "word":
                yield "UOI_UOD", "UOD", toks[k + 1].start, toks[k + 1].end, ""
            elif toks[k + 1].kind == "word":
                yield "UOI_UOD", "UOI", toks[k + 1].start, toks[k + 1].start, "!"
    # A parameter in the place of another one of its type.
    by_type: dict[str, list[str]] = {}
    for name, kind in f.parameters:
        by_type.setdefault("".join(kind.split()), []).append(name)
    for names in by_type.values():
        for t in toks:
            if t.kind == "word" and t.text in names:
                yield from (("SVR", "SVR", t.start, t.end, new) for new in names if new != t.text)


def mutants(text: str) -> list[dict]:
    """Mutants of executable bodies by one edit each: relations, arithmetic, connectives, boundary literals, a negation put in
    or taken away after if and while, and a parameter exchanged for one of its type.

    An id is a hash of operator, place and replacement, so equal mutants have equal ids and count once."""
    out = {}
    for f in functions(text):
        if f.mode != "exec" or not f.body:
            continue
        shift = f.end - len(f.body)
        for family, operator, start, end, new in _edits(f, _executed(f.body)):
            key = hashlib.sha256(f"{family}|{operator}|{shift + start}|{f.body[start:end]}|{new}".encode()).hexdigest()[:16]
            out.setdefault(key, {"id": key, "function": f.name, "family": family, "start": shift + start, "end": shift + end, "old": f.body[start:end], "new": new})
    return list(out.values())


def weaker_stronger(clause: str) -> list[tuple[str, str]]:
    """(direction, clause) of edits of one relation in a clause: <= for < is weaker, and so on; whole conjuncts left out."""
    toks = tokens(clause)
    weaken, strengthen = {"<": "<=", ">": ">=", "==": "<="}, {"<=": "<", ">=": ">", "!=": "<"}
    out = []
    for table, way in ((weaken, "weakening"), (strengthen, "strengthening")):
        out += [(way, clause[: t.start] + table[t.text] + clause[t.end :]) for t in toks if t.text in table]
    parts = top_level(toks, "&&")
    if len(parts) > 1:
        out += [("weakening", " && ".join(text_of(clause, q) for j, q in enumerate(parts) if j != k)) for k in range(len(parts))]
    return out


def fenced(text: str) -> str:
    """The longest fenced block, the first of equals; the whole text if there is none."""
    blocks = re.findall(r"```[A-Za-z0-9_+-]*\n(.*?)```", text, re.S)
    return max(blocks, key=len) if blocks else text


def json_slice(text: str) -> str | None:
    """The first balanced object or array in a text."""
    for m in re.finditer(r"[{\[]", text):
        depth, quoted, k = 0, False, m.start()
        while k < len(text):
            c = text[k]
            if quoted:
                k += c == "\\"
                quoted = c != '"'
            elif c == '"':
                quoted = True
            elif c in "{[":
                depth += 1
            elif c in "}]":
                depth -= 1
                if not depth:
                    return text[m.start() : k + 1]
            k += 1
    return None


def executable_view(text: str, most: int = 8000) -> str:
    """The lines that run: without comments, clauses, assertions and proof blocks; at most so many characters."""
    clean, out, depth, waiting = strip_comments(text), [], 0, False
    for line in clean.splitlines():
        words = line.split()
        if not words:
            continue
        if depth:
            depth += line.count("{") - line.count("}")
            continue
        if re.match(r"\s*proof\s*\{", line):
            depth = line.count("{") - line.count("}")
            continue
        if waiting and re.match(r"\s*\{", line):
            waiting = False
        if re.match(rf"\s*(?:{'|'.join(CLAUSE_KINDS)})\b", line):
            if words[0].startswith("assert"):
                # An assertion's own block ends it, on this line or on a later one.
                depth = max(0, line.count("{") - line.count("}"))
                waiting = not depth and not line.rstrip().endswith((";", "}"))
                continue
            waiting = not line.rstrip().endswith((";", "{"))
            if line.rstrip().endswith("{"):
                out.append("{")
            continue
        if not waiting:
            out.append(line.strip())
    return "\n".join(out)[:most]


def merged_lines(a: str, b: str) -> str:
    """The lines of two versions in one order, common ones once.

    Lines of the first that the second lacks stay, but for function headers, which the second replaces, and lines that
    differ from the next one, of the second, in white space alone. Comment lines that the second has are left out."""
    import difflib

    diff = list(difflib.ndiff(a.replace("\t", "    ").splitlines(), b.replace("\t", "    ").splitlines()))
    respaced = lambda x, y: y.startswith("+") and x[2:].strip() == y[2:].strip()
    stays = {
        "-": lambda x, y: " fn " not in x[2:] and not respaced(x, y),
        "+": lambda x, y: not x[2:].strip().startswith("//"),
        " ": lambda x, y: not x[2:].strip().startswith("//"),
        "?": lambda x, y: False,
    }
    return "\n".join(x[2:] for x, y in zip(diff, [*diff[1:], ""], strict=True) if stays[x[0]](x, y))


def alpha_normalized(text: str) -> str:
    """A definition with its bound names numbered in order of appearance: equal texts mean equal up to renaming."""
    toks = tokens(text)
    names: dict[str, str] = {}
    for f in functions(text):
        for n, _ in f.parameters:
            names.setdefault(n, f"v{len(names)}")
    k = 0
    while k < len(toks):
        if toks[k].text in ("forall", "exists", "choose") and k + 1 < len(toks) and toks[k + 1].text == "|":
            end = next((j for j in range(k + 2, len(toks)) if toks[j].text == "|"), len(toks))
            for p in top_level(toks[k + 2 : end], ",", True):
                names.setdefault(p[0].text, f"v{len(names)}")
            k = end
        elif toks[k].text == "let" and k + 1 < len(toks) and toks[k + 1].kind == "word":
            names.setdefault(toks[k + 1].text, f"v{len(names)}")
        k += 1
    return " ".join(names.get(t.text, t.text) if j == 0 or toks[j - 1].text not in (".", "::") else t.text for j, t in enumerate(toks))


def typed_value(text: str, kind: str):
    """(ok, value) of a printed value read as a type: numbers in range, char, String, Option, Vec and tuples."""
    text, kind = text.strip(), re.sub(r"\s+", "", kind).lstrip("&")
    bits = {"u8": 8, "u16": 16, "u32": 32, "u64": 64, "u128": 128, "usize": 64, "i8": 8, "i16": 16, "i32": 32, "i64": 64, "i128": 128, "isize": 64}
    try:
        if kind in bits or kind in ("int", "nat"):
            v = int(text)
            if kind == "nat" or kind[0] == "u":
                return (0 <= v and (kind == "nat" or v < 1 << bits[kind]), v)
            return (kind == "int" or -(1 << bits[kind] - 1) <= v < 1 << bits[kind] - 1, v)
        if kind == "bool":
            return (text in ("true", "false"), text == "true")
        if kind in ("f32", "f64"):
            return (True, float(text))
        if kind == "char":
            v = chr(int(text)) if text.isdigit() and len(text) > 1 else text.strip("'")
            return (len(v) == 1, v)
        if kind in ("String", "str"):
            return (True, text.strip('"'))
        if m := re.fullmatch(r"Option<(.+)>", kind):
            if text == "None":
                return (True, None)
            inner = re.fullmatch(r"Some\((.*)\)", text, re.S)
            return typed_value(inner[1] if inner else text, m[1])
        m = re.fullmatch(r"Vec<(.+)>|\[([^;\]]+)(?:;(\d+))?\]", kind)
        if m and text.startswith("[") and text.endswith("]"):
            got = [typed_value(x, m[1] or m[2]) for x in split_commas(text[1:-1])]
            return (all(ok for ok, _ in got) and (not m[3] or len(got) == int(m[3])), [v for _, v in got])
        if kind.startswith("(") and text.startswith("("):
            ts, vs = split_commas(kind[1:-1], True), split_commas(text[1:-1])
            got = [typed_value(v, t) for v, t in zip(vs, ts, strict=False)]
            return (len(ts) == len(vs) and all(ok for ok, _ in got), [v for _, v in got])
    except (ValueError, OverflowError):
        pass
    return (False, None)


def value_tags(values: list) -> list[str]:
    """What a list of inputs exercises."""
    out = set()
    for v in values:
        if isinstance(v, bool):
            out.add("bool")
        elif isinstance(v, int):
            if v in (0, 1, -1) or abs(v) + 1 in (1 << 7, 1 << 8, 1 << 15, 1 << 16, 1 << 31, 1 << 32, 1 << 63):
                out.add("boundary")
        elif isinstance(v, list):
            out.add("empty" if not v else "single" if len(v) == 1 else "multi")
            if len({repr(x) for x in v}) < len(v):
                out.add("duplicate")
    return sorted(out)

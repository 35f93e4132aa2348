"""Tokens of specification texts (a Rust-like language), and what follows from them without a grammar.

One scan yields every token with its span; comments nest, raw strings and lifetimes are told from quotes. All the
functions below walk that list, so that brackets in literals and comments never count."""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

# Operators, the longest first.
OPERATORS = ("<==>", "=~=", "&&&", "|||", "==>", "!=", "==", "<=", ">=", "&&", "||", "::", "->", "=>", "..")

# One pattern for all tokens but block comments, which nest: of those it finds the beginning.
_TOKEN = re.compile(
    r"""(?P<word>(?!(?:br|cr|r)\#*")[A-Za-z_][A-Za-z0-9_]*)
    |(?P<number>\d+\.\d+|\d+)
    |(?P<comment>//[^\n]*)
    |(?P<block>/\*)
    |(?P<literal>(?:br|cr|r)(?P<hashes>\#*)"(?s:.*?)(?:"(?P=hashes)|\Z)
        |"(?s:[^"\\]|\\.)*+"?
        |'(?:[^'\\\n]|\\(?:u\{[^}]*\}|x..|.))')
    |(?P<lifetime>'[A-Za-z_][A-Za-z0-9_]*)
    |(?P<op>%s|\S)"""
    % "|".join(re.escape(op) for op in OPERATORS),
    re.X,
)
_COMMENT_EDGE = re.compile(r"/\*|\*/")
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}


@dataclass(slots=True, eq=False)
class Token:
    kind: str  # word, number, literal, lifetime, op, comment
    text: str
    start: int
    end: int


def scan(text: str) -> list[Token]:
    """All tokens, comments included; white space is left out."""
    return list(_scanned(text)[0])


def _scan(text: str) -> tuple[list[Token], list[Token]]:
    """All tokens, and those that are no comments."""
    out: list[Token] = []
    add, at, n, comments = out.append, 0, len(text), False
    while at < n:
        for m in _TOKEN.finditer(text, at):
            kind = m.lastgroup
            if kind == "block":
                break
            comments = comments or kind == "comment"
            start, end = m.span()
            add(Token(kind, m[0], start, end))
        else:
            break
        depth, start, at = 1, m.start(), m.end()
        while depth and (edge := _COMMENT_EDGE.search(text, at)):
            depth += 1 if edge[0] == "/*" else -1
            at = edge.end()
        at, comments = n if depth else at, True
        add(Token("comment", text[start:at], start, at))
    return out, [t for t in out if t.kind != "comment"] if comments else out


#: The functions of a module read the same text one after another, so the last few texts are kept.
_scanned = functools.lru_cache(maxsize=8)(_scan)


#: Tokens that were found without a scan, of the last few texts.
_KNOWN: dict[str, list[Token]] = {}


def remember(text: str, toks: list[Token]) -> None:
    """From now on tokens() finds these for the text, until some more texts have been remembered."""
    while len(_KNOWN) >= 8:
        del _KNOWN[next(iter(_KNOWN))]
    _KNOWN[text] = toks


def tokens(text: str) -> list[Token]:
    known = _KNOWN.get(text)
    return list(_scanned(text)[1] if known is None else known)


def strip_comments(text: str) -> str:
    """The text without comments; line breaks inside them stay."""
    out, at = [], 0
    for t in _scanned(text)[0]:
        if t.kind == "comment":
            out += [text[at : t.start], "\n" * t.text.count("\n")]
            at = t.end
    return "".join([*out, text[at:]])


def normalized(text: str) -> str:
    """Tokens joined by one blank."""
    return " ".join(t.text for t in tokens(text))


def stripped(text: str) -> tuple[str, list[Token]]:
    """The text without comments, and its tokens: those of the text moved to their new places.

    Where what stands on both sides of a comment may grow together, or a lone quote may find another one, the result is scanned again."""
    every, own = _scan(text)
    if len(every) == len(own):
        return text, own
    parts, at, gone, again = [], 0, 0, False
    for t in every:
        if t.kind == "comment":
            breaks = t.text.count("\n")
            again = again or not breaks and bool(text[t.start - 1 : t.start].strip() and text[t.end : t.end + 1].strip())
            parts += [text[at : t.start], "\n" * breaks]
            at = t.end
            gone += t.end - t.start - breaks
        else:
            again = again or t.text == "'"
            t.start -= gone
            t.end -= gone
    clean = "".join([*parts, text[at:]])
    return clean, tokens(clean) if again else own


def compact(text: str) -> str:
    return re.sub(r"\s+", " ", strip_comments(text)).strip()


def partner(toks: list[Token], at: int) -> int | None:
    """Index of the bracket that closes the one at index at; only brackets of its kind count."""
    left = toks[at].text
    right, depth = OPEN.get(left), 0
    for k in range(at, len(toks)):
        if toks[k].text == left:
            depth += 1
        elif toks[k].text == right:
            depth -= 1
            if not depth:
                return k
    return None


def matching(text: str, offset: int) -> int | None:
    """Offset of the bracket that closes the one at offset, literals and comments aside."""
    toks = tokens(text)
    at = next((k for k, t in enumerate(toks) if t.start == offset), None)
    got = partner(toks, at) if at is not None and toks[at].text in OPEN else None
    return None if got is None else toks[got].start


def top_level(toks: list[Token], separator: str = ",", angles: bool = False) -> list[list[Token]]:
    """Parts between separators outside brackets, and outside the bars of a quantifier's or closure's binders.

    With angles, < and > are brackets too (types); without, only those of a turbofish ::< > are."""
    parts: list[list[Token]] = [[]]
    depth, angle, bar = 0, 0, False
    for k, t in enumerate(toks):
        x = t.text
        if x in OPEN:
            depth += 1
        elif x in CLOSE:
            depth = max(0, depth - 1)
        elif x == "<" and (angles or angle or k and toks[k - 1].text == "::"):
            angle += 1
        elif x == ">" and angle:
            angle -= 1
        elif x == "|" and not angles:
            before = toks[k - 1].text if k else ""
            if bar:
                bar = False
            elif not k or before in ("forall", "exists", "choose", "(", ",", "=", "=>", "move", "&&", "||", "==>", "{", "return"):
                bar = True
        if x == separator and not depth and not angle and not bar:
            parts.append([])
        else:
            parts[-1].append(t)
    return [p for p in parts if p]


def text_of(source: str, part: list[Token]) -> str:
    return source[part[0].start : part[-1].end]


def split_commas(text: str, angles: bool = False) -> list[str]:
    return [text_of(text, p) for p in top_level(tokens(text), ",", angles)]

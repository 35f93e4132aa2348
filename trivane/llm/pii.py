"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust their scores.

Base kinds are email, ip, card (Luhn) and phone: every leftmost non-overlapping match that passes its check is kept, and
failing matches are dropped without a second try. Further kinds are kept if their score, raised by context words within
CONTEXT characters and lowered by others, reaches KEEP: iban (mod-97 confirms it, and the length of its country; without a known
country it needs a context word), tel (a number without +), idnum (NNN-NN-NNNN) and secret (keys and access tokens: a long
word of mixed letters and digits of high entropy beside a word such as token or password). A further span that overlaps a base span,
or a span of an earlier further kind, is not added. Positions are code points, ends exclusive.

Null texts count as empty and have no spans; a text is searched whole, and every pattern takes time linear in it. Rows are
independent: ties and repeats need nothing, an empty table gives an empty result, extra columns are not read."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivane.llm.common import arrow_map

BASE = ("email", "ip", "card", "phone")
FURTHER = ("iban", "tel", "idnum", "secret")
ORDER = {k: i for i, k in enumerate(BASE + FURTHER)}
CONTEXT, KEEP = 40, 0.6

# A run of local characters before an @ holds the leftmost match, so the search goes from @ to @ and stays linear.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin where a run of digits begins.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_TEL = re.compile(r"(?<![0-9+A-Za-z])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9A-Za-z])")
_IDNUM = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9_+/-]{18,}[A-Za-z0-9](?![A-Za-z0-9])")
_ANY = re.compile(r"[0-9@]")
_WORDS = {
    "iban": re.compile(r"\b(?:iban|account|bank|konto|compte|cuenta|swift|bic)\b", re.I),
    "tel": re.compile(r"\b(?:tel|phone|telephone|call|fax|mobile|cell|telefon|t[eé]l[eé]phone|tel[eé]fono)\b", re.I),
    "idnum": re.compile(r"\b(?:ssn|social security|tax|passport|id number|ausweis|identit[eé])\b", re.I),
    "secret": re.compile(r"(?:\b|_)(?:token|secret|passw(?:or)?d|pwd|passwort|api[_ -]?key|access[_ -]?key|private[_ -]?key|bearer|credentials?)(?:\b|_)", re.I),
}
#: Words that speak against a kind.
_AGAINST = {
    "iban": re.compile(r"\b(?:example|sample|invalid|format)\b", re.I),
    "tel": re.compile(r"\b(?:isbn|issn|version|invoice|serial|lot)\b", re.I),
    "idnum": re.compile(r"\b(?:isbn|issn|version|part number|serial|lot)\b", re.I),
    "secret": re.compile(r"\b(?:sha-?(?:1|256|512)|md5|checksum|commit|digest)\b", re.I),
}
_SCORE = {"iban": 0.4, "tel": 0.4, "idnum": 0.4, "secret": 0.4}
WITH, AGAINST, COUNTRY = 0.3, 0.3, 0.3
_SPACES = str.maketrans("", "", " -")
#: Characters of an IBAN by country.
IBAN_LENGTHS = dict(
    (c, int(n))
    for n, names in (
        line.split(":")
        for line in "15:NO 16:BE 18:DK,FI,FO,GL,NL 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS 23:AE,GI,IL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:PT 26:IS,TR 27:FR,GR,IT,MC,MR,SM 28:AL,AZ,CY,DO,GT,HU,LB,PL 29:BR,PS,QA,UA 30:KW,MU 31:MT".split()
    )
    for c in names.split(",")
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def mod97(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """A run of capitals and digits may hold more than the number: it ends where its country's length ends a word, else
    with the run, else, for countries without a length here, with the last word at which mod-97 passes. A run without a
    number is searched again from its next word."""
    m = _IBAN.search(text)
    while m:
        s, run = m.start(), m[0]
        ends = [k for k, c in enumerate(run) if c == " "] + [len(run)]
        most = IBAN_LENGTHS.get(run[:2])
        tried = [k for k in ends if k - run.count(" ", 0, k) == most] + [len(run)] if most else reversed(ends)
        end = next((k for k in tried if mod97(run[:k])), None)
        if end is not None:
            yield s, s + end
        m = _IBAN.search(text, s + (ends[0] if end is None else end))


def emails(text: str) -> list[tuple[int, int]]:
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            found.append((start, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, by start and then by kind."""
    if not _ANY.search(text):
        return []
    out = [(s, e, "email") for s, e in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := m[0].translate(_SPACES)) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda x: (x[0], ORDER[x[2]]))


def secrets(text: str) -> Iterator[tuple[int, int]]:
    """Long words of letters and digits whose characters carry 3 bits each or more."""
    for m in _SECRET.finditer(text):
        n = Counter(m[0])
        total = m.end() - m.start()
        if any(c.isdigit() for c in n) and any(c.isalpha() for c in n) and sum(c * math.log2(total / c) for c in n.values()) >= 3 * total:
            yield m.span()


def _merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that the spans cover, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for s, e in sorted(spans):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def further_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) of the further kinds that reach KEEP and touch no earlier span."""
    out: list[tuple[int, int, str, float]] = []
    if not _ANY.search(text):
        return out
    taken = [(s, e) for s, e, _ in base]
    for kind, found in (("iban", ibans(text)), ("tel", (m.span() for m in _TEL.finditer(text))), ("idnum", (m.span() for m in _IDNUM.finditer(text))), ("secret", secrets(text))):
        # Spans of one kind don't overlap each other, so only those of earlier kinds matter.
        starts, ends = _merged(taken)
        for s, e in found:
            k = bisect_left(starts, e) - 1
            if k >= 0 and ends[k] > s:
                continue
            near = text[max(0, s - CONTEXT) : s] + " " + text[e : e + CONTEXT]
            score = _SCORE[kind] + (WITH if _WORDS[kind].search(near) else 0.0) - (AGAINST if _AGAINST[kind].search(near) else 0.0)
            if kind == "iban" and IBAN_LENGTHS.get(text[s : s + 2]) == e - s - text.count(" ", s, e):
                score += COUNTRY
            if score >= KEEP:
                out.append((s, e, kind, min(1.0, score)))
                taken.append((s, e))
    return out


def all_spans(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    text = text or ""
    base = base_spans(text)
    more = [(s, e, k) for s, e, k, _ in further_spans(text, base)]
    return base, sorted(base + more, key=lambda x: (x[0], ORDER[x[2]]))


def redact(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with each span, or group of overlapping spans, replaced by [KIND] of its first."""
    if not text or not spans:
        return text
    out, at, end = [], 0, -1
    for s, e, kind in spans:
        if s >= end:
            out += [text[at:s], f"[{kind.upper()}]"]
        end = at = max(end, e)
    return "".join([*out, text[at:]])


def _join(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def find(documents: DataFrame, redacted: bool = False) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_spans, spans of every row, and with redacted the text without them."""
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string" + ", redacted string" * redacted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: list[list[int]] = [[], [], [], []]
            base_col, all_col, texts = [], [], []
            for text in b.column(1).to_pylist():
                base, every = all_spans(text)
                for kind, col in zip(BASE, counts, strict=True):
                    col.append(sum(x[2] == kind for x in base))
                base_col.append(_join(base))
                all_col.append(_join(every))
                if redacted:
                    texts.append(redact(text, every))
            cols = [b.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(base_col, pa.string()), pa.array(all_col, pa.string())]
            names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_spans", "spans"]
            if redacted:
                cols.append(pa.array(texts, pa.string()))
                names.append("redacted")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return arrow_map(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


def redact_column(documents: DataFrame) -> DataFrame:
    """documents with every span in text replaced, all columns kept; n_chars, if there is one, follows the new text."""
    schema = documents.schema
    at = schema.fieldNames().index("text")
    counted = schema.fieldNames().index("n_chars") if "n_chars" in schema.fieldNames() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(b.columns)
            texts = [redact(t, all_spans(t)[1]) for t in cols[at].to_pylist()]
            old = cols[at]
            cols[at] = pa.array(texts, old.type)
            if counted is not None:
                lengths = [None if t is None else len(t) for t in texts]
                cols[counted] = pa.array(lengths, pa.int64()).cast(cols[counted].type)
            yield pa.RecordBatch.from_arrays(cols, names=schema.fieldNames())

    return arrow_map(documents, run, schema)


def digest(found: DataFrame) -> DataFrame:
    n_spans = F.when(F.col("spans") == "", 0).otherwise(F.size(F.split("spans", ","))).cast("long")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", n_spans.alias("n_spans"))


def base_digest(text: str) -> str:
    return hashlib.sha256(_join(base_spans(text)).encode()).hexdigest()

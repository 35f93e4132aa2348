"""Toxicity by a learned lexicon: Levenshtein automata run over a trie of terms, and windows of context weigh each hit.

The lexicon holds whole words and word beginnings (stems) that occur in far more toxic than other rows. A word of a text
hits the lexicon if it equals a term, begins with a stem, or is a misspelling: of a term (one edit for terms of
FUZZY_LENGTH letters, two from twice that), or, at its beginning, of a stem of FUZZY_STEM letters (one edit). Words may be of any length. Misspellings are found by simulating the Levenshtein automaton of the word
while walking the trie: each node keeps the automaton's states as bit masks, and a branch is left when they are all dead.

A hit counts less where its window of CONTEXT characters shows quotation (it stands between quotation marks, or a
reporting word is near), and more where it addresses someone. The score of a text is a logistic function of the numbers
of distinct and of all hits of each kind, weighed by context, and of their density.

Lexicon and weights are learned from labelled rows: a bounded sample of about FIT_ROWS rows, TOXIC_SHARE of them toxic if
there are enough, chosen by a threshold on a hash of doc_id. Near copies in the sample count once (rows that agree in a
MinHash value of their word runs), lest the words of one copied text look telling. The rows are dealt into FOLDS folds; the features of a
fold use the lexicon of the others, so that the weights see terms as a new text would. Terms are counted in the
executors, and only those that pass the test for lexicon terms come to the driver; there are at most as many as the
sample holds. Whole texts are scored.

Null texts count as empty and get the score of a text without hits; repeated rows get equal scores; an empty table gives
an empty result; extra columns are not read. Without labels of both kinds every score is the share of toxic labels, and
keep_clean, which then knows nothing about any text, keeps every row."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trivane.llm.common import arrow_map, held_out, stored
from trivane.llm.ngram_join import minhashes, shingles

FIT_ROWS, FOLDS = 12000, 3
STEM_LENGTHS = (4, 5, 6, 7)
#: A term occurs in at least LEAST toxic rows, its rate there is RATIO times that elsewhere, and a term without meaning
#: would be as telling with a chance below CHANCE.
LEAST, RATIO, CHANCE = 3, 6.0, 1e-5
TOXIC_SHARE = 0.25
FUZZY_LENGTH, FUZZY_STEM, CONTEXT = 5, 6, 48
#: Bytes of words whose results a Python worker remembers, about; what exceeds it is looked up anew.
MEMO, WORD_BYTES = 48 << 20, 120
QUOTED, ADDRESSED = 0.35, 1.25

_WORD = re.compile(r"\w+")
_REPORT = re.compile(r"\b(?:said|says|wrote|writes|called|quoted?|quoting|reported|according|alleged|cited|the (?:word|term)|a dit|dijo|sagte|schrieb|selon|según|laut)\b", re.I)
_ADDRESS = re.compile(r"\b(?:you|your|you're|u|du|dich|ihr|tu|toi|vous|usted|ustedes)\b", re.I)
_OPEN, _CLOSE, _EITHER = "“«„‹‘", "”»“›’", "\"'`"


@dataclass
class Node:
    next: dict[str, Node] = field(default_factory=dict)
    term: int = -1
    stem: int = -1


#: By lexicon, the words that hit it and some that don't; a Python worker keeps them from task to task.
_SEEN: dict[tuple, tuple[dict[str, tuple[int, int]], set[str], list[int]]] = {}


def _edits(letters: int) -> int:
    """How many edits a term of so many letters allows."""
    return 0 if letters < FUZZY_LENGTH else 1 if letters < 2 * FUZZY_LENGTH else 2


class Lexicon:
    """Terms with their log-odds in a trie; a stem is a term that matches any word it begins."""

    def __init__(self, terms: list[tuple[str, bool, float]]):
        self.terms = tuple(terms)
        self.odds = [x[2] for x in terms]
        self.root = Node()
        for k, (text, stem, _) in enumerate(terms):
            node = self.root
            for c in text:
                node = node.next.setdefault(c, Node())
            if stem:
                node.stem = k
            else:
                node.term = k
        # A word within e edits of a term holds one of e + 1 parts of it unchanged, the first at its start or the last at
        # its end; words that hold none, or are longer than any term and its edits, need no automaton.
        whole = [t for t, stem, _ in terms if not stem]
        self.near = [self._parts([t for t in whole if _edits(len(t)) >= e], e) for e in (1, 2)]
        self.longest = [max((len(t) + e for t in whole if _edits(len(t)) >= e), default=0) for e in (1, 2)]
        # A word that begins with a misspelt stem holds one half of the stem: the first at its start, or the second near by.
        halves = [(t[: len(t) // 2], t[len(t) // 2 :]) for t, stem, _ in terms if stem and len(t) >= FUZZY_STEM]
        alt = [f"{re.escape(a)}|.{{{max(0, len(a) - 1)},{len(a) + 1}}}{re.escape(b)}" for a, b in sorted(halves)]
        self.near_stem = re.compile(rf"(?:{'|'.join(alt)})", re.S) if alt else None

    @staticmethod
    def _parts(words: list[str], edits: int) -> re.Pattern | None:
        starts, inner, ends = set(), set(), set()
        for w in words:
            cut = [len(w) * k // (edits + 1) for k in range(edits + 2)]
            parts = [w[x:y] for x, y in zip(cut, cut[1:], strict=False)]
            starts.add(parts[0])
            inner |= set(parts[1:-1])
            ends.add(parts[-1])
        if not words:
            return None
        alt = lambda x: "|".join(map(re.escape, sorted(x)))
        return re.compile(rf"\A(?:{alt(starts)})" + (f"|{alt(inner)}" if inner else "") + rf"|(?:{alt(ends)})\Z")

    def exact(self, word: str) -> tuple[int, int] | None:
        """(term, 0) if the word is a term, (term, 1) if it begins with a stem; the longest stem counts."""
        node, best = self.root, -1
        for c in word:
            node = node.next.get(c)
            if node is None:
                break
            if node.stem >= 0:
                best = node.stem
        else:
            if node.term >= 0:
                return node.term, 0
        return (best, 1) if best >= 0 else None

    def fuzzy(self, word: str, edits: int) -> int:
        """The nearest term within so many edits of the word, or stem within one edit of its beginning; -1 if none.

        A term allows edits by its own length. Bit i of state e: i characters of the word are matched with e edits."""
        n = len(word)
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        full = (1 << n + 1) - 1
        stems = self.near_stem is not None
        start, s = [], 1
        for _ in range(edits + 1):
            start.append(s)
            s = (s << 1 | s) & full
        best, limit = -1, edits
        stack = [(self.root, start, 0)]
        while stack:
            node, states, depth = stack.pop()
            if node.term >= 0:
                for e in range(min(limit, _edits(depth)) + 1):
                    if states[e] >> n & 1:
                        if best < 0 or e < limit or self.odds[node.term] > self.odds[best]:
                            best, limit = node.term, e
                        break
            if stems and node.stem >= 0 and depth >= FUZZY_STEM and limit and states[1] and (best < 0 or self.odds[node.stem] > self.odds[best]):
                best, limit = node.stem, 1
            for c, child in node.next.items():
                mask = masks.get(c, 0)
                new = [(states[0] & mask) << 1]
                for e in range(1, edits + 1):
                    old = states[e - 1]
                    x = (states[e] & mask) << 1 | old | old << 1 | new[e - 1] << 1
                    new.append(x & full)
                if any(new[: limit + 1]):
                    stack.append((child, new, depth + 1))
        return best

    def hit(self, word: str) -> tuple[int, int] | None:
        """(term, kind) for a word: kind 0 a term, 1 a stem, 2 a misspelling."""
        got = self.exact(word)
        if got is None and len(word) >= FUZZY_LENGTH - 1:
            one, two = (p is not None and len(word) <= n and p.search(word) for p, n in zip(self.near, self.longest, strict=True))
            if two or one or (self.near_stem is not None and self.near_stem.match(word)):
                k = self.fuzzy(word, 2 if two else 1)
                got = (k, 2) if k >= 0 else None
        return got

    def hits(self, words: set[str]) -> dict[str, tuple[int, int]]:
        """The words that hit, each with its term and kind."""
        if self.terms not in _SEEN and len(_SEEN) >= FOLDS:
            _SEEN.clear()
        known, clean, held = _SEEN.setdefault(self.terms, ({}, set(), [0]))
        out = {}
        for w in words - clean:
            h = known.get(w)
            if h is None:
                h = self.hit(w)
                if held[0] >= MEMO:
                    clean.clear()
                    known.clear()
                    held[0] = 0
                held[0] += WORD_BYTES + len(w)
                if h is None:
                    clean.add(w)
                    continue
                known[w] = h
            out[w] = h
        return out


def context_weight(text: str, start: int, end: int) -> float:
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    opened = max(before.rfind(c) for c in _OPEN)
    quoted = opened > max(before.rfind(c) for c in _CLOSE) and any(c in after for c in _CLOSE)
    if not quoted:
        for q in _EITHER:
            # An odd number of marks that begin a word before the hit, and one that ends a word after it.
            if len(re.findall(rf"(?<!\w){q}", before)) > len(re.findall(rf"(?<=\w|[.,!?]){q}", before)) and re.search(rf"(?<=\S){q}(?!\w)", text[end - 1 : end + CONTEXT]):
                quoted = True
                break
    if quoted or _REPORT.search(before) or _REPORT.search(after):
        return QUOTED
    return ADDRESSED if _ADDRESS.search(before[-24:]) or _ADDRESS.search(after[:16]) else 1.0


FEATURES = 8


def features(text: str, lexicon: Lexicon) -> list[float]:
    """Weighed distinct and total hits of terms, stems and misspellings, the sum of log-odds, and the density."""
    low = text.lower()
    words = _WORD.findall(low)
    n = len(words)
    distinct, total, telling = [0.0] * 3, [0.0] * 3, {}
    hits = lexicon.hits(set(words))
    if hits:
        weight, times = dict.fromkeys(hits, 0.0), dict.fromkeys(hits, 0)
        for m in _WORD.finditer(low):
            if m[0] in weight:
                weight[m[0]] += context_weight(low, m.start(), m.end())
                times[m[0]] += 1
        for w, (k, kind) in hits.items():
            distinct[kind] += weight[w] / times[w]
            total[kind] += weight[w]
            # Of the words that share a term, the one whose contexts weigh most counts.
            own = lexicon.odds[k] * weight[w] / times[w] * (0.5 if kind == 2 else 1.0)
            telling[k, kind == 2] = max(own, telling.get((k, kind == 2), 0.0))
    share = sum(total) / n if n else 0.0
    return [*np.log1p(distinct), *np.log1p(total), sum(telling.values()) / 4, float(np.sqrt(100 * share))]


def _terms_of(text: str) -> set[str]:
    """Words, and beginnings marked by a final star."""
    out = set()
    for w in set(_WORD.findall(text.lower())):
        if len(w) >= 3:
            out.add(w)
            for k in STEM_LENGTHS:
                if len(w) > k:
                    out.add(w[:k] + "*")
    return out


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float


def _chance(p: int, q: int, share: float) -> float:
    """A bound (Chernoff) on the logarithm of the chance that p or more of p + q rows are toxic if the term means nothing."""
    n = p + q
    x = p / n
    if x <= share:
        return 0.0
    return -n * (x * np.log(x / share) + ((1 - x) * np.log((1 - x) / (1 - share)) if q else 0.0))


def choose(terms: list[tuple[str, int, int]], n_pos: int, n_neg: int) -> list[tuple[str, bool, float]]:
    """The lexicon terms among (term, toxic rows, other rows), without those that a term with them explains."""
    picked: dict[str, tuple[int, float]] = {}
    for t, p, q in terms:
        if p < LEAST:
            continue
        odds = np.log((p + 0.5) / (n_pos + 1)) - np.log((q + 0.5) / (n_neg + 1))
        if odds >= np.log(RATIO) and _chance(p, q, n_pos / (n_pos + n_neg)) <= np.log(CHANCE):
            picked[t] = (p, float(odds))

    def stems(body: str) -> list[str]:
        return [s for k in STEM_LENGTHS if k < len(body) and (s := body[:k] + "*") in picked]

    # A stem gives way to a word or longer stem that makes up most of it, and that is the word itself or tells more.
    gone = set()
    for t, (p, odds) in picked.items():
        whole = not t.endswith("*")
        gone |= {s for s in stems(t.rstrip("*")) if p >= (0.9 if whole else 0.8) * picked[s][0] and (whole or odds > picked[s][1] + 0.7)}
    # What begins with a remaining stem that tells as much is covered by it.
    out = []
    for t, (p, odds) in picked.items():
        if t in gone or any(s not in gone and picked[s][1] >= odds - 0.7 and picked[s][0] >= p for s in stems(t.rstrip("*"))):
            continue
        out.append((t.rstrip("*"), t.endswith("*"), odds))
    return sorted(out)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.5, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Logistic regression with a ridge and weights of at least 0 (the bias is free), by projected Newton steps."""
    z = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    pen = np.full(z.shape[1], ridge)
    pen[-1] = 1e-6
    b = np.zeros(z.shape[1])

    def loss(b: np.ndarray) -> float:
        return float((weight * (np.logaddexp(0, z @ b) - y * (z @ b))).sum() + 0.5 * (pen * b * b).sum())

    now = loss(b)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        g = z.T @ (weight * (p - y)) + pen * b
        free = np.append((b[:-1] > 0) | (g[:-1] < 0), True)
        zf = z[:, free]
        h = (zf * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ zf + np.diag(pen[free])
        step = np.zeros_like(b)
        step[free] = np.linalg.solve(h, g[free])
        size = 1.0
        while size > 1e-6:
            new = b - size * step
            new[:-1] = np.maximum(new[:-1], 0)
            if (then := loss(new)) < now:
                break
            size /= 2
        else:
            break
        done = now - then < 1e-9 * max(1.0, now)
        b, now = new, then
        if done:
            break
    return b[:-1], float(b[-1])


def fit(documents: DataFrame, labels: DataFrame, train: Column, rows: int = FIT_ROWS) -> Model | float:
    """Fit on labelled rows for which train, a condition on doc_id, holds; the share of toxic labels if there is one kind only.

    Labels of other rows are not even counted: shares and weights come from those of training rows alone."""
    marks = labels.where(train & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(F.col("doc_id").isNotNull())
    own = documents.where(train & F.col("text").isNotNull()).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_h"))
    n = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return float(n.get(1, 0) > 0)
    share = {k: min(1.0, rows * (TOXIC_SHARE if k else 1 - TOXIC_SHARE) / v) for k, v in n.items()}
    key = F.xxhash64("doc_id", F.lit("fit")) / float(1 << 63)
    marks = marks.where(key < F.when(F.col("toxic") == 1, 2 * share[1] - 1).otherwise(2 * share[0] - 1))
    # The sample is bounded, so its marks are broadcast and no text is shuffled; a session in which the draw came out far
    # larger than asked for leaves the choice to Spark.
    marks = stored(marks, "marks")
    few = marks.count() <= 4 * rows
    sample = own.join(F.broadcast(marks) if few else marks, "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"), "_h")

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low = [minhashes(s)[:2].astype(np.int64) if len(s := shingles(t)) else [h, h] for t, h in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array([int(x[k]) for x in low], pa.int64()) for k in (0, 1)]], names=["text", "toxic", "_h", "k0", "k1"])

    sample = arrow_map(sample, grouped, "text string, toxic int, _h long, k0 long, k1 long")
    for k in ("k0", "k1"):
        sample = sample.groupBy("toxic", k).agg(F.min(F.struct("_h", "text", "k1")).alias("x")).select("toxic", "x.*")
    sample = stored(sample.select("text", "toxic", F.pmod("_h", F.lit(FOLDS)).cast("int").alias("fold")), "sample")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            names = list(counts)
            for s in range(0, len(names), 20000):
                part = names[s : s + 20000]
                c = np.stack([counts[t] for t in part])
                at = np.argwhere(c)
                yield pa.RecordBatch.from_arrays([pa.array([part[i] for i in at[:, 0]], pa.string()), pa.array((at[:, 1] // 2).astype(np.int32)), pa.array((at[:, 1] % 2).astype(np.int32)), pa.array(c[at[:, 0], at[:, 1]].astype(np.int64))], names=["term", "fold", "toxic", "n"])
            counts.clear()

        for b in batches:
            for text, toxic, fold in zip(*[c.to_pylist() for c in b.columns], strict=True):
                for t in _terms_of(text):
                    c = counts.get(t)
                    if c is None:
                        c = counts[t] = np.zeros(2 * FOLDS, dtype=np.int32)
                    c[2 * fold + toxic] += 1
                if len(counts) > 500_000:
                    yield from flush()
        yield from flush()

    sizes = {(r["fold"], r["toxic"]): r["count"] for r in sample.groupBy("fold", "toxic").count().collect()}
    n_pos, n_neg = (sum(v for (_, t), v in sizes.items() if t == k) for k in (1, 0))
    if not n_pos or not n_neg:
        return n_pos / max(1, n_pos + n_neg)
    sums = [F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == t), F.col("n")).otherwise(0)).alias(f"n{f}_{t}") for f in range(FOLDS) for t in (0, 1)]
    table = arrow_map(sample, explode, "term string, fold int, toxic int, n long").groupBy("term").agg(*sums)
    pos = sum((F.col(f"n{f}_1") for f in range(FOLDS)), F.lit(0))
    neg = sum((F.col(f"n{f}_0") for f in range(FOLDS)), F.lit(0))
    # Looser than choose(), so that the lexicon of each part of the folds is among them.
    got = table.where((pos >= LEAST) & (pos / n_pos >= RATIO / 2 * neg / n_neg)).collect()

    def lexicon(without: int | None) -> Lexicon:
        fs = [f for f in range(FOLDS) if f != without]
        terms = [(r["term"], sum(r[f"n{f}_1"] for f in fs), sum(r[f"n{f}_0"] for f in fs)) for r in got]
        return Lexicon(choose(terms, *(sum(sizes.get((f, t), 0) for f in fs) for t in (1, 0))))

    parts = [lexicon(f) for f in range(FOLDS)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(t, *features(x, parts[f])) for x, t, f in zip(*[c.to_pylist() for c in b.columns], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([float(r[k]) for r in rows]) for k in range(FEATURES + 1)], names=[f"c{k}" for k in range(FEATURES + 1)])

    m = sorted(tuple(r) for r in arrow_map(sample, measure, ", ".join(f"c{k} double" for k in range(FEATURES + 1))).collect())
    m = np.array(m)
    y = m[:, 0]
    # The sample holds more toxic rows than the labels; the weights put that right.
    weight = np.where(y == 1, 1 / share[1], 1 / share[0])
    w, bias = _logistic(m[:, 1:], y, weight / weight.mean())
    return Model(lexicon(None), w, bias)


def score(documents: DataFrame, model: Model | float) -> DataFrame:
    """doc_id, score and hits (distinct lexicon terms, weighed) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_scores(b.column(1).to_pylist(), model))], names=["doc_id", "score"])

    return arrow_map(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double")


def _scores(texts: list[str | None], model: Model | float) -> np.ndarray:
    if isinstance(model, float):
        return np.full(len(texts), model)
    x = np.array([features(t or "", model.lexicon) for t in texts]).reshape(-1, FEATURES)
    return 1 / (1 + np.exp(-np.clip(x @ model.weights + model.bias, -30, 30)))


def keep_clean(documents: DataFrame, model: Model | float, threshold: float = 0.5) -> DataFrame:
    """The rows whose score lies below the threshold, with all their columns; all rows if the labels were of one kind."""
    if isinstance(model, float):
        return documents
    at, schema = documents.columns.index("text"), documents.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = b.filter(pa.array(_scores(b.column(at).to_pylist(), model) < threshold))
            yield pa.RecordBatch.from_arrays(kept.columns, names=schema.fieldNames())

    return arrow_map(documents, run, schema)


def not_held_out() -> Column:
    return ~held_out("doc_id", 5, 0)

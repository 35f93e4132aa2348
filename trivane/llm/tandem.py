"""Periodic runs of words by the method of Gusfield and Stoye, and texts with their repetitions collapsed.

A run is a stretch of words with smallest period q, at least LEAST words and EXPONENT periods long, that no neighbour
extends. The method, over the words of a text as symbols:

1. Blocks of the Lempel-Ziv factorisation: each is the longest word sequence that also begins further left, or one word.
2. The leftmost occurrence of every square (a sequence twice in a row) is reached from a block's border: for each period,
   extensions to both sides from the border give a first square, from which all others of that stretch follow.
   These squares cover the leftmost occurrences of all squares of the text.
3. The suffix tree is held as the suffix array, the lengths of common prefixes and their range minima: a node is an
   interval of suffixes. From a first square, suffix links lead to the next rotation, one word to the right, as long
   as it is a square too. The nodes so reached, each once, are the vocabulary of squares.
4. The interval of a node holds all places of its square. Places in a row of one period are one run.

Only squares whose root is primitive are carried on (the others belong to runs of a smaller period), so there are at most
about n log n places in a text of n words. Extensions compare words by the names of prefixes of 1, 2, 4, ... words from
prefix doubling, so none is longer than log n steps, and everything is done for many texts at once in numpy.

A stretch of words that holds a run has, wherever the run lies, word windows of WINDOW words that occur twice in the text: a run of
length l and period q equals itself q words on over l - q >= max(LEAST - q, (EXPONENT - 1) q) >= WINDOW words, and the
windows of the two copies cover it. So steps 1 to 4 work on the stretches covered by repeated windows (found by hashes;
equal hashes of different windows only add words), and nothing is lost.

Nothing is shuffled: a text is looked at in the task that reads it, whole, in memory of about 100 bytes times log n for each word in such
stretches. A null text has no words; null ids count as the empty text; repeated rows give equal rows; an empty table
gives an empty result; extra columns are not read."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivane.llm.common import arrow_map

LEAST, EXPONENT = 24, 3
#: Bytes of text that are looked at together, about; a longer text is looked at alone.
BATCH = 1_500_000


def window(least: int, exponent: int) -> int:
    """The shortest overlap of a run with itself one period on."""
    return min(max(least - q, (exponent - 1) * q) for q in range(1, least + 1))


def repeated(hashes: np.ndarray, text: np.ndarray, size: int) -> np.ndarray:
    """Which words lie in a window of size words that occurs twice in its text; text numbers the text of each word."""
    n = len(hashes)
    covered = np.zeros(n, dtype=bool)
    if n < size:
        return covered
    # Hashes of windows of 1, 2, 4, ... words put together to the size asked for.
    with np.errstate(over="ignore"):
        part, length, factor = hashes.copy(), 1, np.uint64(0x9E3779B97F4A7C15)
        total, done = np.zeros(n, dtype=np.uint64), 0
        while True:
            if size & length:
                m = n - done
                total[:m] = total[:m] * factor + part[done:]
                done += length
            if done == size:
                break
            m = n - length
            part[:m] = (part[:m] ^ (part[:m] >> np.uint64(29))) * factor + part[length:]
            factor = factor * factor + np.uint64(2)
            length *= 2
        total += text.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    starts = np.flatnonzero(text[: n - size + 1] == text[size - 1 :])
    keys = total[starts]
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(starts), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(n + 1, dtype=np.int32)
    change[starts[twice]] += 1
    change[starts[twice] + size] -= 1
    return np.cumsum(change[:-1]) > 0


def _table(x: np.ndarray) -> list[np.ndarray]:
    """Minima over the 1, 2, 4, ... entries that end at each place; what would begin before the first is cut off there."""
    out = [x]
    step = 1
    while step < len(x):
        y = out[-1].copy()
        np.minimum(y[step:], out[-1][:-step], out=y[step:])
        out.append(y)
        step *= 2
    return out


class Index:
    """Names of prefixes, suffix array, common prefixes and range minima over stretches that have no symbol in common."""

    def __init__(self, symbols: np.ndarray):
        n = self.n = len(symbols)
        rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
        self.names, step = [rank.astype(np.int32)], 1
        while int(rank.max()) < n - 1:
            key = rank * (n + 1)
            key[: n - step] += rank[step:] + 1
            order = np.argsort(key, kind="stable")
            s = key[order]
            new = np.empty(n, dtype=np.int64)
            new[order] = np.cumsum(np.append(0, s[1:] != s[:-1]))
            rank = new
            self.names.append(rank.astype(np.int32))
            step *= 2
        self.rank = rank
        self.suffixes = np.empty(n, dtype=np.int64)
        self.suffixes[rank] = np.arange(n)
        common = np.zeros(n, dtype=np.int64)
        if n > 1:
            common[1:] = self.forward(self.suffixes[:-1], self.suffixes[1:])
        self.common = _table(common)

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols agree from i and j on."""
        i, j, out = i.copy(), j.copy(), np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            inside = (i < self.n) & (j < self.n)
            same = inside & (self.names[k][np.where(inside, i, 0)] == self.names[k][np.where(inside, j, 0)])
            add = same.astype(np.int64) << k
            i += add
            j += add
            out += add
        return out

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols agree up to and with i and j."""
        i, j, out = i.copy(), j.copy(), np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            a, b = i - (1 << k) + 1, j - (1 << k) + 1
            inside = (a >= 0) & (b >= 0)
            same = inside & (self.names[k][np.where(inside, a, 0)] == self.names[k][np.where(inside, b, 0)])
            add = same.astype(np.int64) << k
            i -= add
            j -= add
            out += add
        return out

    def interval(self, i: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last rank of the suffixes that share the first length symbols of suffix i: a node of the suffix tree."""
        low, high = self.rank[i].copy(), self.rank[i].copy()
        for k in range(len(self.common) - 1, -1, -1):
            go = (low >= 1 << k) & (self.common[k][low] >= length)
            low -= go.astype(np.int64) << k
            to = high + (1 << k)
            inside = to < self.n
            go = inside & (self.common[k][np.where(inside, to, 0)] >= length)
            high += go.astype(np.int64) << k
        return low, high

    def previous(self) -> np.ndarray:
        """For each place, the length of the longest sequence from it that also begins further left."""
        n = self.n
        least = _table(self.suffixes)
        own = self.suffixes
        left, right = np.arange(n) - 1, np.arange(n) + 1
        short, far = np.iinfo(np.int64).max, len(least) - 1
        a, b = np.full(n, short), np.full(n, short)
        for k in range(far, -1, -1):
            # Left: the 2^k ranks that end at left all begin further right in the text, so the next smaller one lies beyond them.
            inside = left >= (1 << k) - 1
            at = np.where(inside, left, 0)
            go = inside & (least[k][at] > own)
            a[go] = np.minimum(a[go], self.common[k][(left + 1)[go]])
            left -= go.astype(np.int64) << k
            to = right + (1 << k) - 1
            inside = to < n
            at = np.where(inside, to, 0)
            go = inside & (least[k][at] > own)
            b[go] = np.minimum(b[go], self.common[k][at[go]])
            right += go.astype(np.int64) << k
        # The step to the smaller one itself.
        found = left >= 0
        a = np.where(found, np.minimum(a, self.common[0][np.minimum(left + 1, n - 1)]), 0)
        found = right < n
        b = np.where(found, np.minimum(b, self.common[0][np.minimum(right, n - 1)]), 0)
        out = np.empty(n, dtype=np.int64)
        out[own] = np.maximum(a, b)
        return out


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, value): for each entry the numbers first, first + 1, ..., count of them."""
    which = np.repeat(np.arange(len(first)), count)
    return which, first[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)


def blocks(longest: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, start of the next, start of the one after that, end of the stretch) of the Lempel-Ziv blocks of each stretch."""
    out: list[tuple[int, int, int, int]] = []
    jumps = longest.tolist()
    for b, e in zip(begin.tolist(), end.tolist(), strict=True):
        cuts = [b]
        while cuts[-1] < e:
            cuts.append(min(e, cuts[-1] + max(1, jumps[cuts[-1]])))
        cuts.append(e)
        out += [(x, y, z, e) for x, y, z in zip(cuts, cuts[1:], cuts[2:], strict=False)]
    return tuple(np.array(out, dtype=np.int64).reshape(-1, 4).T)


def leftmost(index: Index, cuts: tuple[np.ndarray, ...], longest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period): squares from which the leftmost occurrences of all squares are reached; longest bounds the period by block."""
    start, nxt, after, end = cuts
    word = index.names[0]
    found = []
    # The square begins in the block and ends beyond its right border.
    which, k = _spread(np.ones(len(start), dtype=np.int64), np.where(nxt < end, np.minimum(nxt - start, longest), 0))
    border = nxt[which]
    keep = word[border - k] == word[border]
    which, k, border = which[keep], k[keep], border[keep]
    q = border - k
    ahead, behind = index.forward(border, q), index.backward(border - 1, q - 1)
    keep = (ahead + behind >= k) & (ahead > 0)
    found.append((np.maximum(q - behind, q - k + 1)[keep], k[keep]))
    # The square begins before the block, and its first half ends in the block.
    which, k = _spread(np.ones(len(start), dtype=np.int64), np.maximum(0, np.minimum(after - start, longest)))
    border = start[which]
    q = border + k
    keep = (border > 0) & (q < end[which])
    keep[keep] = word[border[keep] - 1] == word[q[keep] - 1]
    which, k, border, q = which[keep], k[keep], border[keep], q[keep]
    ahead, behind = index.forward(border, q), index.backward(border - 1, q - 1)
    first = np.maximum(border - behind, border - k + 1)
    keep = (ahead + behind >= k) & (first + k <= nxt[which]) & (behind > 0)
    found.append((first[keep], k[keep]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def primitive(index: Index, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether the root of each square is no repetition of a shorter sequence: none of its period over a prime is a period."""
    out = np.ones(len(start), dtype=bool)
    if not len(start):
        return out
    smallest = np.arange(int(period.max()) + 1)
    for p in range(2, int(len(smallest) ** 0.5) + 1):
        if smallest[p] == p:
            multiples = smallest[p * p :: p]
            multiples[multiples == np.arange(p * p, len(smallest), p)] = p
    rest = period.copy()
    while (rest > 1).any():
        at = np.flatnonzero(rest > 1)
        p = smallest[rest[at]]
        shift = period[at] // p
        out[at] &= index.forward(start[at], start[at] + shift) < 2 * period[at] - shift
        rest[at] //= p
        while (more := rest[at] % p == 0).any():
            rest[at] = np.where(more, rest[at] // p, rest[at])
    return out


def _joined(period: np.ndarray, place: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals [place, last] of one period that touch or overlap, as one."""
    if not len(period):
        return period, place, last
    order = np.lexsort((place, period))
    period, place, last = period[order], place[order], last[order]
    # The furthest end so far within the period: offset by the period's number, so that one running maximum does.
    number = np.cumsum(np.append(0, period[1:] != period[:-1]))
    big = int(last.max()) + 2
    far = np.maximum.accumulate(last + number * big) - number * big
    new = np.append(True, (number[1:] != number[:-1]) | (place[1:] > far[:-1] + 1))
    at = np.flatnonzero(new)
    return period[at], place[at], far[np.append(at[1:], len(far)) - 1]


def runs(symbols: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of stretches [begin, end) of symbols; stretches have no symbol in common."""
    none = np.zeros(0, dtype=np.int64)
    if not len(symbols):
        return none, none, none
    index = Index(symbols)
    cuts = blocks(index.previous(), begin, end)
    size = end - begin
    # A period is at most its stretch's length over the exponent; a block knows its stretch by the end.
    longest = size[np.searchsorted(end, cuts[3])] // exponent
    start, period = leftmost(index, cuts, longest)
    keep = primitive(index, start, period)
    start, period = start[keep], period[keep]
    # Suffix links from suffix to suffix, as long as the square goes on.
    period, start, last = _joined(period, start, start + index.forward(start, start + period) - period)
    which, place = _spread(start, last - start + 1)
    period = period[which]
    if not len(place):
        return none, none, none
    level = np.minimum(np.floor(np.log2(2 * period)).astype(np.int64), len(index.names) - 1)
    head, tail = np.empty(len(place), dtype=np.int64), np.empty(len(place), dtype=np.int64)
    for k in np.unique(level):
        at = level == k
        head[at] = index.names[k][place[at]]
        tail[at] = index.names[k][place[at] + 2 * period[at] - (1 << int(k))]
    order = np.lexsort((tail, head, period))
    same = (period[order[1:]] == period[order[:-1]]) & (head[order[1:]] == head[order[:-1]]) & (tail[order[1:]] == tail[order[:-1]])
    one = order[np.append(True, ~same)]
    place, period = place[one], period[one]
    low, high = index.interval(place, 2 * period)
    which, at = _spread(low, high - low + 1)
    period = period[which]
    place = index.suffixes[at]
    period, start, last = _joined(period, place, place)
    length = last - start + 2 * period
    keep = (length >= least) & (length >= exponent * period)
    return start[keep], length[keep], period[keep]


def runs_of_texts(texts: list[list[bytes]], least: int = LEAST, exponent: int = EXPONENT) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each text, given as words, by start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    n = int(sizes.sum())
    if not n:
        return out
    text = np.repeat(np.arange(len(texts)), sizes)
    first = np.cumsum(sizes) - sizes
    words = [w for t in texts for w in t]
    hashes = np.fromiter(map(hash, words), dtype=np.int64, count=n).view(np.uint64)
    covered = repeated(hashes, text, window(least, exponent))
    if not covered.any():
        return out
    at = np.flatnonzero(covered)
    new = np.append(True, (at[1:] != at[:-1] + 1) | (text[at[1:]] != text[at[:-1]]))
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at))
    known: dict[bytes, int] = {}
    name = np.fromiter((known.setdefault(words[i], len(known)) for i in at.tolist()), dtype=np.int64, count=len(at))
    stretch = np.cumsum(new) - 1
    for s, length, q in zip(*(x.tolist() for x in runs(stretch * (len(known) + 1) + name, begin, end, least, exponent)), strict=True):
        i = int(at[s])
        out[text[i]].append((i - int(first[text[i]]), length, q))
    for r in out:
        r.sort(key=lambda x: (x[0], x[2]))
    return out


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run contains after its first period."""
    if not found:
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def in_batches(sizes: Iterable[int], most: int = BATCH) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about most bytes."""
    begin = total = k = 0
    for k, size in enumerate(sizes, 1):
        total += size
        if total >= most:
            yield begin, k
            begin, total = k, 0
    if begin < k:
        yield begin, k


def split_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space (blank, tab to carriage return), as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def find(documents: DataFrame, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """doc_id, runs (array of start, length, period, by start and period), words and text (collapsed) of every row.

    edit may change a text's words first, given the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for b in batches:
            ids, sizes = b.column(0).to_pylist(), pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist()
            for s, e in in_batches(sizes):
                words = [split_words(t) for t in b.column(1).slice(s, e - s).to_pylist()]
                if edit:
                    words = [edit(i, w) for i, w in zip(ids[s:e], words, strict=True)]
                found = runs_of_texts(words, least, exponent)
                rows = [[{"start": x, "length": y, "period": z} for x, y, z in r] for r in found]
                texts = [b" ".join(collapsed(w, r)) for w, r in zip(words, found, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s), pa.array(rows, kind), pa.array(list(map(len, words)), pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "words", "text"])

    cols = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return arrow_map(cols, run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, words long, text string")


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a text, made periodic from a place on for about every tenth id."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of greatest exponent, and sha256 of the runs and of the collapsed text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, sums = [], []
            for rows in b.column(1).to_pylist():
                x = [(r["start"], r["length"], r["period"]) for r in rows]
                best.append(min(x, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if x else (None, None, None))
                sums.append(hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in x).encode()).hexdigest())
            milli = [None if n is None else 1000 * n // q for _, n, q in best]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(r) for r in b.column(1)], pa.int64()), *[pa.array([r[k] for r in best], pa.int64()) for k in range(3)], pa.array(milli, pa.int64()), pa.array(sums), b.column(2)], names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    cols = found.select("doc_id", "runs", F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"))
    return arrow_map(cols, run, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")

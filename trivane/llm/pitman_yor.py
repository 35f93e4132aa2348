"""Log probabilities of texts under a hierarchical Pitman-Yor model, seated by Gibbs sampling.

Tokens are the words of a text and one end. The word after another one is drawn from the restaurant of its context, the word
before it (at the start of a text the end; with a number of contexts, a class of that word by hash); all context restaurants
share one parent, the restaurant of all words, whose parent draws evenly from the words of the training texts and one more,
which stands for any other word. A restaurant with strength s and discount d that has seated c customers at t tables, c_w and t_w of them with
word w, draws w with probability (c_w - d t_w + (s + d t) p_w) / (s + c), p_w being its parent's; each table is a customer of
the parent. Customers of context restaurants are the training tokens, all of them.

Gibbs sampling seats the customers of each word in a restaurant anew, given the tables of all other words: the number of
their tables t has probability in proportion to a^t times the number of seatings (a generalised Stirling number), where a is
(s + d times all tables) p_w. Beyond EXACT customers of a word in one restaurant the rest are seated in groups of a sixteenth
of those seated before. The sums of tables by restaurant are taken over the corpus between
rounds and held fixed while sampling within one; parents' probabilities change with every sweep. The last round averages the predictive
probabilities of SAMPLES sweeps after BURN others; these use the sums of their own sample, so they add up to 1. Discounts are n1 / (n1 + 2 n2) from the numbers of words with one and with two
customers in a restaurant; strengths are those, of a grid, under which tokens are likeliest when left out one at a time.

Counts are gathered by hash of the word (blocks.py). Each part of the hash range numbers its words; these numbers name words
and contexts from there on. Blocks then tell every part which contexts its words follow. A customer who is alone with a word in a context has a table
to himself whatever else is drawn, so between rounds a part keeps only the pairs of context and word that occur more than once, and numbers of the
rest. Contexts belong to owners: parts send them their sums of tables, owners add these up and send the sums of the corpus to the parts
that asked. In the end blocks get back numbers of customers and tables for their words, contexts and pairs, and compose the texts. What moves is a row for each block and
part, or part and owner; the driver sees sums of bounded length.

Null texts count as empty and hold the end alone; a null id counts as the empty text; repeated rows count as often as they occur;
without training texts every token has probability 1 (there is nothing but any other word); an empty table gives an
empty result; extra columns are not read. A rerun gives the same scores with as many parts."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trivane.llm import blocks
from trivane.llm.common import arrow_map, discard, held_out, partitions, stored

BURN, SAMPLES, EXACT = 2, 3, 96
BLOCK = 12 << 20
STRENGTHS = [10.0**k for k in range(8)]
END = b" "


def tokens(text: str) -> list[bytes]:
    """Words between ASCII white space, A to Z in lower case, and the end, which no word equals."""
    return [*text.encode("utf-8", "surrogatepass").lower().split(), END]


def classes(known: list[bytes], contexts: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(t) % contexts for t in known), dtype=np.int64, count=len(known))


def before(codes: list[np.ndarray], end: int) -> np.ndarray:
    """The code before each token; before the first one of a text stands an end."""
    if not codes:
        return np.zeros(0, dtype=np.int64)
    return np.concatenate([np.concatenate([[end], c[:-1]]) for c in codes]).astype(np.int64)


def pairs_of_block(contexts: int) -> blocks.More:
    """For parts that one process holds whole (Part), with classes as contexts: in which of them words occur, and how often in training texts.

    score() has words as contexts and goes another way, by block_pairs."""

    def more(known: list[bytes], codes: list[np.ndarray], marks: list[bool]) -> Callable[[np.ndarray], bytes]:
        every = np.concatenate(codes).astype(np.int64)
        own = classes(known, contexts)
        key, back = np.unique(every * contexts + own[before(codes, known.index(END))], return_inverse=True)
        times = np.bincount(back, weights=np.repeat(np.array(marks, dtype=float), [len(c) for c in codes]))
        word = key // contexts
        begin = np.searchsorted(word, np.arange(len(known) + 1))

        def told(part: np.ndarray) -> bytes:
            count = begin[part + 1] - begin[part]
            at = blocks.spread(begin[part], count)
            return np.concatenate([count, key[at] % contexts, times[at].astype(np.int64)]).astype("<i8").tobytes()

        return told

    return more


class Part:
    """The words of a part with the training tokens of each context, and which of these pairs every block asks for.

    tally() and predictive() work on it as rounds do on a Core; score() itself keeps Cores only."""

    def __init__(self, asks: list[dict], contexts: int):
        self.asks = asks
        known, where = blocks.numbered(blocks.unpack_tokens(a["data"]) for a in asks)
        self.size, keys, times = len(known), [], []
        self.known = known
        for a, own in zip(asks, where, strict=True):
            x = blocks.unpack(a["more"], "<i8")
            m = len(own)
            n = (len(x) - m) // 2
            keys.append(np.repeat(own, x[:m]) * contexts + x[m : m + n])
            times.append(x[m + n :])
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        self.where = where
        self.asked = np.split(back, np.cumsum([len(k) for k in keys])[:-1])
        self.word, self.context = key // contexts, key % contexts
        self.times = np.bincount(back, weights=np.concatenate(times), minlength=len(key)).astype(np.int64)
        self.single = np.zeros(self.size, dtype=np.int64)


class Core:
    """What the rounds need of a part: the pairs that occur more than once, and how many others each word has.

    ids are its contexts by the numbers of the corpus; context holds places in them."""

    def __init__(self, raw: bytes):
        x = blocks.unpack_numbers(raw)
        self.size, n, m = x[:3].tolist()
        self.single, self.ids, self.word, self.context, self.times = np.split(x[3:], np.cumsum([self.size, n, m, m]))

    @staticmethod
    def packed(single: np.ndarray, ids: np.ndarray, word: np.ndarray, context: np.ndarray, times: np.ndarray) -> bytes:
        return blocks.pack_numbers(np.concatenate([[len(single), len(ids), len(word)], single, ids, word, context, times]))


def stirling(discount: float, most: int) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: row n, column t - 1 for n customers at t tables."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 0] = 0.0
    for n in range(1, most):
        t = np.arange(1, n + 1)
        stay = out[n, :n] + np.log(np.maximum(n - t * discount, 1e-300))
        out[n + 1, :n] = stay
        out[n + 1, 1 : n + 1] = np.logaddexp(out[n + 1, 1 : n + 1], out[n, :n])
    return out


def seat(customers: np.ndarray, weight: np.ndarray, discount: float, table: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of each word with so many customers; weight is a of the docstring."""
    out = np.minimum(customers, 1)
    exact = len(table) - 1
    some = np.flatnonzero(customers > 1)
    if not len(some):
        return out
    some = some[np.argsort(customers[some], kind="stable")]
    n = np.minimum(customers[some], exact)
    cut = np.append(np.flatnonzero(np.append(True, n[1:] != n[:-1])), len(n))
    log_a = np.log(weight[some])
    for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        k = int(n[s])
        step = max(1, (1 << 20) // k)
        for i in range(s, e, step):
            j = min(e, i + step)
            p = table[k, :k] + np.arange(1, k + 1) * log_a[i:j, None]
            p = np.cumsum(np.exp(p - p.max(axis=1, keepdims=True)), axis=1)
            out[some[i:j]] = 1 + (p < (rng.random(j - i) * p[:, -1])[:, None]).sum(axis=1)
    far = some[customers[some] > exact]
    seated = np.full(len(far), exact, dtype=np.int64)
    while len(far):
        group = np.minimum(customers[far] - seated, np.maximum(1, seated // 16))
        a = weight[far]
        new = a / (a + seated + group / 2 - discount * out[far])
        out[far] += rng.binomial(group, np.minimum(new, 1.0))
        seated += group
        left = seated < customers[far]
        far, seated = far[left], seated[left]
    return out


def sweeps(part: Part, state: dict, seed: list[int], number: int) -> Iterator[dict]:
    """Gibbs sweeps over a part: tables of its pairs and words, and the words' probabilities by which they were drawn."""
    rng = np.random.default_rng(seed)
    s0, s1, d0, d1 = (state[k] for k in ("strength", "strength1", "discount", "discount1"))
    held = np.flatnonzero(part.times > 0)
    word, context, times = part.word[held], part.context[held], part.times[held]
    even = 1.0 / (state["words"] + 1)
    again, again1 = stirling(d0, EXACT), stirling(d1, EXACT)
    open0, open1 = (s0 + d0 * state["tables"]) * even, s1 + d1 * state["tables1"]
    customers = np.bincount(word, minlength=part.size) + part.single
    tables = seat(customers, np.full(part.size, open0), d0, again, rng)
    for _ in range(number):
        p = (customers - d0 * tables + open0) / (s0 + state["customers"])
        tables1 = seat(times, open1[context] * p[word], d1, again1, rng)
        customers = np.bincount(word, weights=tables1, minlength=part.size).astype(np.int64) + part.single
        tables = seat(customers, np.full(part.size, open0), d0, again, rng)
        yield {"held": held, "tables1": tables1, "customers": customers, "tables": tables}


def _discount(ones: float, twos: float) -> float:
    return float(np.clip(ones / (ones + 2 * twos) if ones else 0.5, 0.05, 0.95))


def split_text(contexts: int | None) -> Callable[[str], list[bytes]]:
    """Tokens of a text; with classes as contexts, the class before each of them follows, which holds white space and so is no word."""

    def split(text: str) -> list[bytes]:
        own = tokens(text)
        return own if contexts is None else own + [b"\n%d" % (zlib.crc32(t) % contexts) for t in [END, *own[:-1]]]

    return split


def divided(codes: list[np.ndarray], end: int, contexts: int | None) -> tuple[list[np.ndarray], np.ndarray]:
    """Words of each text, and the contexts of all of them."""
    if contexts is None:
        return codes, before(codes, end)
    return [c[: len(c) // 2] for c in codes], np.concatenate([c[len(c) // 2 :] for c in codes]).astype(np.int64)


def counts_of_block(contexts: int | None) -> blocks.More:
    """How often training texts of a block hold each token as a word and as a context."""

    def more(known: list[bytes], codes: list[np.ndarray], marks: list[bool]) -> Callable[[np.ndarray], np.ndarray]:
        words, context = divided(codes, known.index(END), contexts)
        weights = np.repeat(np.array(marks, dtype=float), [len(c) for c in words])
        both = np.stack([np.bincount(x, weights=weights, minlength=len(known)) for x in (np.concatenate(words), context)]).astype("<i8")
        return lambda own: np.ascontiguousarray(both[:, own])

    return more


def block_pairs(codes: list[np.ndarray], contexts: int | None, known: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts of a block; word and context of its distinct pairs, by word; each token's pair; where each word's pairs begin."""
    # Without classes, the last token of every text is the end.
    words, context = divided(codes, int(codes[0][-1]), contexts)
    key, back = np.unique(np.concatenate(words).astype(np.int64) * known + context, return_inverse=True)
    word = key // known
    return words, word, key % known, back, np.searchsorted(word, np.arange(known + 1))


def _rows(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
    columns = [c.split() for c in schema.split(", ")]
    return pa.table([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(columns)], names=[n for n, _ in columns])


def _sums(df: DataFrame, n: int) -> list[float] | None:
    """Sums of the n entries of stats over all rows that have some; none without such rows."""
    row = df.where("stats is not null").agg(*[F.sum(F.col("stats")[k]) for k in range(n)]).first()
    return None if row[0] is None else [float(x) for x in row]


NAMES = "block long, part int, owner int, codes binary, data binary"
PAIRS = "block long, part int, codes binary, words binary, data binary"
MERGED = "kind int, part int, owner int, block long, codes binary, words binary, data binary, stats array<double>"
SENT = "kind int, part int, owner int, words binary, data binary, stats array<double>"
ASKS, CORE, SEND, REPLY, KEPT, SEATS = range(6)


def measured(core: Core, state: dict, got: dict) -> list[float]:
    """Tables, customers, and how likely tokens are, left out one at a time, for each strength of the grid.

    Tokens of pairs that occur once are left to the owners of their contexts: their parents don't depend on the strength of contexts."""
    word, context, times = core.word, core.context, core.times
    d0, d1, even = state["discount"], state["discount1"], 1.0 / (state["words"] + 1)
    m, s, t = got["customers"], got["tables"], got["tables1"]
    likely, likely1 = [], []
    alone = m == 1
    less, head = np.maximum(m - 1, 0), np.where(alone, 0, s)
    for strength in STRENGTHS:
        p = drawn(less, np.minimum(head, less), d0, strength + d0 * (state["tables"] - alone), even, strength + state["customers"] - 1)
        likely.append(float((m[m > 0] * np.log(p[m > 0])).sum()))
    p = drawn(m, s, d0, state["strength"] + d0 * state["tables"], even, state["strength"] + state["customers"])[word]
    for strength in STRENGTHS:
        q = drawn(times - 1, np.minimum(t, times - 1), d1, strength + d1 * state["tables1"][context], p, strength + state["times"][context] - 1 + 1e-9)
        likely1.append(float((times * np.log(np.maximum(q, 1e-300))).sum()))
    return [float(s.sum()), float(m.sum()), *likely, *likely1]


class Owner:
    """Contexts of some parts: customers, and how many words occur once in each."""

    def __init__(self, own: pa.Table, parts: int, rows: int):
        own = own.sort_by("part")
        self.parts, self.part = parts, own.column("part").to_pylist()
        held = [blocks.unpack_numbers(x.as_py()).reshape(rows, -1) for x in own.column("data")]
        self.values = np.concatenate(held, axis=1) if held else np.zeros((rows, 0), dtype=np.int64)
        self.cut = np.cumsum([0] + [x.shape[1] for x in held])
        self.begin = np.zeros(parts, dtype=np.int64)
        self.begin[self.part] = self.cut[:-1]

    def at(self, ids: np.ndarray) -> np.ndarray:
        return self.begin[ids % self.parts] + ids // self.parts


def score(documents: DataFrame, train: Column, contexts: int | None = None, burn: int = BURN, samples: int = SAMPLES, block: int = BLOCK) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score and perplexity of every row.

    n_known are tokens of which the training texts hold some; base_score adds 0.5 to the counts of single tokens. Contexts are
    words, or with contexts so many classes of words."""
    parts = partitions(documents.sparkSession)
    owners = -(-parts // 4)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), train.alias("mark"))
    coded = stored(blocks.encoded(docs, split_text(contexts), counts_of_block(contexts), block), "words")

    def name(asked: pa.Table) -> pa.Table:
        """Numbers of the tokens of a part, frequent ones first: for each block, and customers of each as a context for the owner."""
        asked = asked.sort_by("block")
        part = asked.column("part")[0].as_py()
        known, where = blocks.numbered(blocks.unpack_tokens(x.as_py()) for x in asked.column("data"))
        counts = np.zeros((2, len(known)), dtype=np.int64)
        for own, x in zip(where, asked.column("more"), strict=True):
            counts[:, own] += blocks.unpack(x.as_py(), "<i8").reshape(2, -1)
        order = np.argsort(-counts.max(axis=0), kind="stable")
        rank = np.argsort(order)
        rows = [(b, part, None, c, blocks.pack_numbers(rank[own])) for b, c, own in zip(*(asked.column(k).to_pylist() for k in ("block", "codes")), where, strict=True)]
        return _rows([*rows, (None, part, part % owners, None, blocks.pack_numbers(counts[1][order]))], NAMES)

    named = stored(coded.where("part is not null").select("block", "part", "data", "codes", "more").groupBy("part").applyInArrow(name, NAMES), "names")

    def pairs(own: pa.Table, got: pa.Table) -> pa.Table:
        """For each part: its tokens in the block, the contexts that each of them follows, and how often in training texts."""
        codes = [blocks.unpack(c.as_py(), "<u4").astype(np.int64) for c in got.column("codes")]
        known = sum(map(len, codes))
        ids = np.zeros(known, dtype=np.int64)
        for c, p, x in zip(codes, got.column("part").to_pylist(), got.column("data"), strict=True):
            ids[c] = blocks.unpack_numbers(x.as_py()) * parts + p
        words, _, context, back, begin = block_pairs([blocks.unpack(x.as_py(), "<u4") for x in own.column("data")], contexts, known)
        times = np.bincount(back, weights=np.repeat(np.array(own.column("mark").to_pylist(), dtype=float), [len(c) for c in words])).astype(np.int64)
        rows = []
        for c, p, raw in zip(codes, got.column("part").to_pylist(), got.column("codes"), strict=True):
            count = begin[c + 1] - begin[c]
            at = blocks.spread(begin[c], count)
            rows.append((own.column("block")[0].as_py(), p, raw.as_py(), blocks.pack_numbers(np.concatenate([ids[c] // parts, count])), blocks.pack_numbers(np.concatenate([ids[context[at]], times[at]]))))
        return _rows(rows, PAIRS)

    texts = coded.where("part is null").select("block", "doc_id", "mark", "data")
    told = texts.groupBy("block").cogroup(named.where("block is not null").groupBy("block")).applyInArrow(pairs, PAIRS)

    def merge(asked: pa.Table) -> pa.Table:
        """The pairs of a part: what each block asked for, as places among those that occur more than once; these; contexts for their owners."""
        asked = asked.sort_by("block")
        part = asked.column("part")[0].as_py()
        words = [blocks.unpack_numbers(x.as_py()).reshape(2, -1) for x in asked.column("words")]
        held = [blocks.unpack_numbers(x.as_py()).reshape(2, -1) for x in asked.column("data")]
        size = max(int(w[0].max()) for w in words) + 1
        ids, key = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
        key += np.concatenate([np.repeat(*w) for w in words]) * len(ids)
        times = np.concatenate([x[1] for x in held])
        cut = np.cumsum([x.shape[1] for x in held])[:-1]
        del held
        key, back = np.unique(key, return_inverse=True)
        times = np.bincount(back, weights=times, minlength=len(key)).astype(np.int64)
        word, context = (key // len(ids), key % len(ids)) if len(ids) else (key, key)
        one, many = times == 1, times > 1
        link = one.astype(np.int64)
        link[many] = 2 + np.arange(int(many.sum()))
        rows = [(ASKS, part, None, b, c, w, blocks.pack_numbers(link[k]), None) for b, c, w, k in zip(*(asked.column(k).to_pylist() for k in ("block", "codes", "words")), np.split(back, cut), strict=True)]
        kinds = np.bincount(word[one | many], minlength=size)
        used, place = np.unique(context[many], return_inverse=True)
        core = Core.packed(np.bincount(word[one], minlength=size), ids[used], word[many], place, times[many])
        rows.append((CORE, part, None, None, None, None, core, [float(x.sum()) for x in (kinds > 0, one, times == 2, kinds == 1, kinds == 2, times)]))
        both = np.stack([ids, *(np.bincount(context[x], minlength=len(ids)) for x in (one, many))])
        both = both[:, both[1:].any(axis=0)]
        rows += [(SEND, part, q, None, None, None, blocks.pack_numbers(x), None) for q, x in _by_owner(both)]
        return _rows(rows, MERGED)

    def _by_owner(sent: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        of = sent[0] % parts % owners
        for q in np.unique(of).tolist():
            yield q, sent[:, of == q]

    merged = stored(told.groupBy("part").applyInArrow(merge, MERGED), "pairs")
    v = _sums(merged, 6)
    if v is None:
        return docs.select("doc_id", F.col("mark").alias("train"), *[F.lit(0).cast(t).alias(n) for n, t in OUT[2:]]).where("false")
    state = {"words": v[0], "discount1": _discount(v[1], v[2]), "discount": _discount(v[3], v[4]), "tables": v[0], "strength": STRENGTHS[2], "strength1": STRENGTHS[2]}
    total = v[5]

    def begin(own: pa.Table, got: pa.Table) -> pa.Table:
        """At first every word has one table in each of its contexts."""
        owner = Owner(own, parts, 1)
        number = own.column("owner")[0].as_py()
        single, tables = np.zeros((2, owner.values.shape[1]), dtype=np.int64)
        sent = [blocks.unpack_numbers(x.as_py()).reshape(3, -1) for x in got.column("data")]
        for ids, one, many in sent:
            single[owner.at(ids)] += one
            tables[owner.at(ids)] += one + many
        rows = []
        for p, (ids, _, many) in zip(got.column("part").to_pylist(), sent, strict=True):
            ids = ids[many > 0]
            rows.append((REPLY, p, number, None, blocks.pack_numbers(np.concatenate([ids, tables[owner.at(ids)], owner.values[0, owner.at(ids)]])), None))
        for p, s, e in zip(owner.part, owner.cut[:-1], owner.cut[1:], strict=True):
            rows.append((KEPT, p, number, None, blocks.pack_numbers(np.stack([owner.values[0, s:e], single[s:e]])), [float(tables[s:e].sum())]))
        return _rows(rows, SENT)

    owned = stored(named.where("owner is not null").groupBy("owner").cogroup(merged.where(f"kind = {SEND}").groupBy("owner")).applyInArrow(begin, SENT), "contexts")
    state["customers"] = _sums(owned, 1)[0]
    core = merged.where(f"kind = {CORE}").select("part", "data")
    keepers = owned.where(f"kind = {KEPT}").select("part", "owner", "data")

    def seated(replies: DataFrame, state: dict, last: bool) -> DataFrame:
        """A round of the parts: sums of tables for the owners of contexts; in the last one for each sample, and the seats too."""

        def run(own: pa.Table, got: pa.Table) -> pa.Table:
            if not own.num_rows:
                return _rows([], SENT)
            part, held = own.column("part")[0].as_py(), Core(own.column("data")[0].as_py())
            here = state | {"tables1": np.zeros(len(held.ids)), "times": np.zeros(len(held.ids))}
            for x in got.column("data"):
                ids, tables, times = blocks.unpack_numbers(x.as_py()).reshape(3, -1)
                at = np.searchsorted(held.ids, ids)
                here["tables1"][at], here["times"][at] = tables, times
            drawn_ = list(sweeps(held, here, [1 + last, part], burn + (samples if last else 1)))[burn:]
            rows = []
            if last:
                times = np.bincount(held.word, weights=held.times, minlength=held.size).astype(np.int64) + held.single
                words = [times, *(g[k] for k in ("customers", "tables") for g in drawn_)]
                stats = [float(g[k].sum()) for k in ("customers", "tables") for g in drawn_]
                rows.append((SEATS, part, None, blocks.pack_numbers(np.concatenate(words)), blocks.pack_numbers(np.concatenate([held.times, *(g["tables1"] for g in drawn_)])), stats))
            else:
                rows.append((SEATS, part, None, None, None, measured(held, here, drawn_[0])))
            sums = [np.bincount(held.context, weights=g["tables1"], minlength=len(held.ids)).astype(np.int64) for g in drawn_]
            rows += [(SEND, part, q, None, blocks.pack_numbers(x), None) for q, x in _by_owner(np.stack([held.ids, *sums]))]
            return _rows(rows, SENT)

        return stored(core.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(run, SENT), "seats")

    def summed(seats: DataFrame, state: dict, last: bool) -> DataFrame:
        """Sums of the corpus: for the parts that asked; in the last round all of them, for the part that numbered them."""

        def run(own: pa.Table, got: pa.Table) -> pa.Table:
            owner = Owner(own, parts, 2)
            times, single = owner.values
            number = own.column("owner")[0].as_py()
            sums = np.repeat(single[None], samples if last else 1, axis=0)
            sent = [blocks.unpack_numbers(x.as_py()).reshape(1 + len(sums), -1) for x in got.column("data")]
            for x in sent:
                sums[:, owner.at(x[0])] += x[1:]
            if last:
                return _rows([(KEPT, p, number, None, blocks.pack_numbers(np.concatenate([times[None, s:e], sums[:, s:e]])), None) for p, s, e in zip(owner.part, owner.cut[:-1], owner.cut[1:], strict=True)], SENT)
            at = np.flatnonzero(single)
            # The only token of a word in a context leaves its table.
            likely = [float((single[at] * np.log((s + state["discount1"] * (sums[0, at] - 1)) / (s + times[at] - 1 + 1e-9))).sum()) for s in STRENGTHS]
            rows = [(REPLY, p, number, None, blocks.pack_numbers(np.concatenate([x[0], sums[0, owner.at(x[0])], times[owner.at(x[0])]])), None) for p, x in zip(got.column("part").to_pylist(), sent, strict=True)]
            return _rows([*rows, (KEPT, None, number, None, None, likely)], SENT)

        return stored(keepers.groupBy("owner").cogroup(seats.where(f"kind = {SEND}").select("part", "owner", "data").groupBy("owner")).applyInArrow(run, SENT), "sums")

    replies, grid, old = owned.where(f"kind = {REPLY}").select("part", "data"), len(STRENGTHS), []
    for _ in range(2 if total else 0):
        seats = seated(replies, dict(state), False)
        sums = summed(seats, dict(state), False)
        v, w = _sums(seats, 2 + 2 * grid), _sums(sums, grid)
        likely1 = np.array(v[2 + grid :]) + np.array(w)
        state |= {"tables": v[0], "customers": v[1], "strength": STRENGTHS[int(np.argmax(v[2 : 2 + grid]))], "strength1": STRENGTHS[int(np.argmax(likely1))]}
        replies = sums.where(f"kind = {REPLY}").select("part", "data")
        old += [seats, sums]
    seats = seated(replies, dict(state), True)
    sums = summed(seats, dict(state), True)
    v = _sums(seats, 2 * samples)
    customers, tables = v[:samples], v[samples:]
    ANSWER = "block long, codes binary, words binary, counts binary, data binary"

    def answer(own: pa.Table, got: pa.Table) -> pa.Table:
        """For each block, customers and tables of its words, contexts and pairs, for each sample."""
        known = {k: (w, x) for k, w, x in zip(*(got.column(k).to_pylist() for k in ("kind", "words", "data")), strict=True)}
        of_words = blocks.unpack_numbers(known[SEATS][0]).reshape(1 + 2 * samples, -1)
        of_words = np.concatenate([of_words, blocks.unpack_numbers(known[KEPT][1]).reshape(1 + samples, -1)])
        held = blocks.unpack_numbers(known[SEATS][1]).reshape(1 + samples, -1)
        held = np.concatenate([np.zeros((1 + samples, 1), dtype=np.int64), np.ones((1 + samples, 1), dtype=np.int64), held], axis=1)
        rows = []
        for b, c, w, x in zip(*(own.column(k) for k in ("block", "codes", "words", "data")), strict=True):
            rank, count = blocks.unpack_numbers(w.as_py()).reshape(2, -1)
            rows.append((b.as_py(), c.as_py(), blocks.pack_numbers(of_words[:, rank]), blocks.pack_numbers(count), blocks.pack_numbers(held[:, blocks.unpack_numbers(x.as_py())])))
        return _rows(rows, ANSWER)

    found = seats.where(f"kind = {SEATS}").select("kind", "part", "words", "data").union(sums.select("kind", "part", "words", "data"))
    asks = merged.where(f"kind = {ASKS}").select("part", "block", "codes", "words", "data")
    answers = asks.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(answer, ANSWER)
    s0, s1, d0, d1, even = (*(state[k] for k in ("strength", "strength1", "discount", "discount1")), 1.0 / (state["words"] + 1))
    n_words = state["words"]

    def compose(own: pa.Table, got: pa.Table) -> pa.Table:
        codes = [blocks.unpack(c.as_py(), "<u4").astype(np.int64) for c in got.column("codes")]
        known = sum(map(len, codes))
        words, word, context, back, begin = block_pairs([blocks.unpack(x.as_py(), "<u4") for x in own.column("data")], contexts, known)
        of_words = np.zeros((2 + 3 * samples, known), dtype=np.int64)
        held = np.zeros((1 + samples, len(word)), dtype=np.int64)
        for c, w, n, x in zip(codes, *(got.column(k) for k in ("words", "counts", "data")), strict=True):
            of_words[:, c] = blocks.unpack_numbers(w.as_py()).reshape(len(of_words), -1)
            held[:, blocks.spread(begin[c], blocks.unpack_numbers(n.as_py()))] = blocks.unpack_numbers(x.as_py()).reshape(len(held), -1)
        times, seen = of_words[0], of_words[1 + 2 * samples]
        p = np.zeros(len(word))
        for k in range(samples):
            parent = drawn(of_words[1 + k], of_words[1 + samples + k], d0, s0 + d0 * tables[k], even, s0 + customers[k])
            p += drawn(held[0], held[1 + k], d1, (s1 + d1 * of_words[2 + 2 * samples + k])[context], parent[word], (s1 + seen)[context])
        logs = np.log10(p / samples)
        every = np.concatenate(words).astype(np.int64)
        sizes = np.array([len(c) for c in words])
        cut = np.cumsum(sizes) - sizes
        base = np.log10((times + 0.5) / (total + 0.5 * (n_words + 1)))
        scores = np.add.reduceat(logs[back], cut)
        seen_ones = np.add.reduceat((times[every] > 0).astype(np.int64), cut)
        bases = np.add.reduceat(base[every], cut)
        return pa.table([own.column("doc_id"), own.column("mark"), sizes, seen_ones, np.full(len(sizes), int(total)), bases, scores, 10.0 ** np.minimum(-scores / sizes, 300)], names=[n for n, _ in OUT])

    out = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(compose, ", ".join(f"{n} {t}" for n, t in OUT))
    out = stored(out, "scores")
    discard(coded, named, merged, owned, seats, sums, *old)
    return out


OUT = [("doc_id", "long"), ("train", "boolean"), ("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double"), ("perplexity", "double")]


def drawn(customers: np.ndarray, tables: np.ndarray, discount: float, opened: np.ndarray, parent: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The probability of words with so many customers and tables, if a new table has the weight opened."""
    return (customers - discount * tables + opened * parent) / total


def tally(part: Part, state: dict, number: int, burn: int, samples: int) -> np.ndarray:
    """Tables of the contexts, and of the parent, for each sample."""
    drawn = list(sweeps(part, state, [2, number], burn + samples))[burn:]
    return np.concatenate([np.append(np.bincount(part.context[g["held"]], weights=g["tables1"], minlength=len(state["times"])), g["tables"].sum()) for g in drawn]).astype(float)


def predictive(part: Part, state: dict, tallies: np.ndarray, number: int, burn: int, samples: int) -> np.ndarray:
    """For each pair of the part, whether seen in training or not, the word's probability in the context, averaged over samples.

    tallies has a row for each sample: the sums of tables over all parts, by context, and of the parent."""
    s0, s1, d0, d1 = (state[k] for k in ("strength", "strength1", "discount", "discount1"))
    even = 1.0 / (state["words"] + 1)
    out = np.zeros(len(part.word))
    for k, got in enumerate(sweeps(part, state, [2, number], burn + samples)):
        if k >= burn:
            tables1, tables = tallies[k - burn, :-1], tallies[k - burn, -1]
            p = drawn(got["customers"], got["tables"], d0, s0 + d0 * tables, even, s0 + tables1.sum())
            t = np.zeros(len(part.word))
            t[got["held"]] = got["tables1"]
            out += drawn(part.times, t, d1, (s1 + d1 * tables1)[part.context], p[part.word], (s1 + state["times"])[part.context])
    return out / samples


def not_held_out() -> Column:
    return ~held_out("doc_id", 5, 1)

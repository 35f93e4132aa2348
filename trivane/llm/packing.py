"""Mixture-controlled packing by deficit round-robin.

Each source is a queue of the tokens of its documents. Every window (one sequence) serves every queue once, in one stretch: what
the queue has earned at its rate up to the window's end less what it was served before. Rates are in proportion to the
sources' tokens by default, so that all queues last to the end; fractions of a token are carried on, as deficits, from window to
window. A window so holds the target proportions to within two tokens a source, and a document is cut only where its queue's turn ends. By a common clock (the
time by which all queues together have earned the windows so far) what a queue was served after c windows depends on
c alone: no state has to pass from task to task, and the offsets of tokens in their queues say in which windows and where they lie.

Sources that earn fewer than QUANTUM tokens a window (shares below 0.8 %) are one queue together, so there are at most
SEQUENCE / QUANTUM + 1 queues, however many sources; in it, what one task holds of a source stays together, and these stretches are ordered by
the clock. Windows hold these sources' sum in proportion, and each of them over longer stretches.

Tokens are computed once, in the tasks that read the texts, and written to the shared folder with their offsets within
task and source; the sums by task and source (one narrow row each) then give the offsets in the queues. No row that is as
large as a text is shuffled.

Null texts count as empty and hold the end token alone; a null source is a queue of its own; repeated rows are packed as
often as they occur; an empty table gives an empty result. Extra columns are not read."""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from trivane.llm.common import arrow_map, stored
from trivane.operators.windows import running_sums

SEQUENCE, QUANTUM, END = 2048, 16, 1
#: Parts of a token in which queues earn, and rows of documents by windows that are looked at together.
PARTS, STEP = 1024, 1 << 15
#: Runs that the quick encoder isn't given; the library's own encoder takes texts that hold one.
_LONG_RUN = re.compile(r"\S{2000}|\s{2000}")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def _encoder(path: str):
    """Text to ids as the byte-level BPE file at path has them, without added special tokens."""
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    spec = json.load(open(path, encoding="utf-8"))
    special = [t["content"] for t in spec.get("added_tokens", [])]
    # Byte-level vocabularies write bytes as printable characters: those that print stand for themselves.
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(own))}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    quick = tiktoken.Encoding("quick", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if not text:
            return []
        if any(s in text for s in special) or _LONG_RUN.search(text):
            return exact.encode(text, add_special_tokens=False).ids
        return quick.encode_ordinary(text)

    probe = "It's 12 naïve  words,\n\tñ 東京 🙂  end "
    if encode(probe) != exact.encode(probe, add_special_tokens=False).ids:
        return lambda text: exact.encode(text, add_special_tokens=False).ids
    return encode


def tokenized(documents: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, source, part, local (tokens of the source before it in its task), n and ids (binary, uint32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        part = TaskContext.get().partitionId()
        seen: dict[str | None, int] = {}
        for b in batches:
            sources = b.column(1).to_pylist()
            texts = b.column(2)
            for s in range(0, b.num_rows, 256):
                ids, local, n = [], [], []
                for src, text in zip(sources[s : s + 256], texts.slice(s, 256).to_pylist(), strict=True):
                    a = np.array([*encode(text or ""), END], dtype=np.uint32)
                    ids.append(a.astype("<u2").tobytes() if a.max() < 65536 else b"\xff\xff" + a.astype("<u4").tobytes())
                    local.append(seen.get(src, 0))
                    n.append(len(a))
                    seen[src] = local[-1] + len(a)
                k = len(ids)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, k), b.column(1).slice(s, k), pa.array([part] * k, pa.int32()), pa.array(local, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "source", "part", "local", "n", "ids"])

    cols = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    return arrow_map(cols, run, "doc_id long, source string, part int, local long, n long, ids binary")


def _ids(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2").astype("<u4") if len(raw) == 2 * n else np.frombuffer(raw, "<u4", offset=2)


class Clock:
    """What each queue was served after so many windows. The largest queue comes last: its stretches fill the windows."""

    def __init__(self, totals: np.ndarray, rates: np.ndarray, window: int):
        self.totals, self.rates, self.window = totals.astype(np.int64), rates.astype(np.float64), window
        self.all = int(self.totals.sum())
        self.windows = -(-self.all // window)
        # Tokens that all queues together have earned when one more queue ends, and the time of that.
        ends = np.divide(self.totals, self.rates, out=np.zeros(len(rates)), where=self.rates > 0)
        self.time = np.append(0.0, np.unique(ends))
        self.earned = np.minimum(self.rates[:, None] * self.time, self.totals[:, None]).sum(axis=0)

    def parts(self, time: np.ndarray) -> np.ndarray:
        """Parts of a token that the queues have earned by a time, added up from the first queue on."""
        return np.cumsum(np.minimum((self.rates[:, None] * time * PARTS).astype(np.int64), self.totals[:, None] * PARTS), axis=0)

    def served(self, windows: np.ndarray) -> np.ndarray:
        """Tokens served after so many windows by the queues up to each one, a row for each queue and one of zeros before."""
        target = np.minimum(windows * self.window, self.all)
        time = np.interp(target, self.earned, self.time)
        # The clock may be short by rounding: it goes on until the windows are full.
        for _ in range(40):
            short = target * PARTS - self.parts(time)[-1]
            if (short <= 0).all():
                break
            active = (self.rates[:, None] * (time < (self.totals / np.maximum(self.rates, 1e-300))[:, None])).sum(axis=0)
            time = np.where(short > 0, time + (short + 2) / (np.maximum(active, self.rates.min()) * PARTS), time)
        out = np.concatenate([np.zeros((1, len(windows)), dtype=np.int64), self.parts(time) // PARTS])
        out[-1] = target
        out[:, target >= self.all] = np.append(0, np.cumsum(self.totals))[:, None]
        return np.minimum(out, target)

    def near(self, queue: np.ndarray, token: np.ndarray) -> np.ndarray:
        """About the window in which a token of a queue is served."""
        return np.interp(token / self.rates[queue], self.time, self.earned).astype(np.int64) // self.window


def cut(clock: Clock, queue: np.ndarray, at: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, start, length, window, offset there) of the pieces of documents with these queues, offsets and tokens, in order."""
    # A turn is two tokens off at most, and at least QUANTUM - 2 long but for those at a queue's end.
    first = np.maximum(clock.near(queue, at) - 2, 0)
    last = np.minimum(clock.near(queue, at + n - 1) + 2, clock.windows - 1)
    count = last - first + 1
    total = int(count.sum())
    ends = np.cumsum(count)
    for s in range(0, total, STEP):
        k = np.arange(s, min(total, s + STEP))
        doc = np.searchsorted(ends, k, side="right")
        window = first[doc] + k - (ends - count)[doc]
        known, back = np.unique(np.concatenate([window, window + 1]), return_inverse=True)
        served = clock.served(known)
        before, after = back[: len(k)], back[len(k) :]
        q = queue[doc]
        low = served[q + 1, before] - served[q, before]
        high = served[q + 1, after] - served[q, after]
        a, b = np.maximum(at[doc], low), np.minimum((at + n)[doc], high)
        keep = b > a
        place = served[q, after] - served[q, before] + a - low
        yield tuple(x[keep] for x in (doc, a - at[doc], b - a, window, place))


def queues(sums: DataFrame, window: int, quantum: int, weights: dict[str | None, float] | None) -> tuple[DataFrame, list]:
    """Of every source its tokens, rate, and whether it is a queue of its own; and these sources, the largest one last.

    Those are bounded by their rates: each has quantum / window of all or more."""
    out = sums.groupBy("source").agg(F.sum("sum").alias("total"))
    rate = F.col("total").cast("double")
    if weights is not None:
        named = {k: float(v) for k, v in weights.items() if k is not None}
        known = F.try_element_at(F.create_map(*[F.lit(x) for kv in named.items() for x in kv]), F.col("source")) if named else F.lit(None).cast("double")
        rate = F.coalesce(F.when(F.col("source").isNull(), F.lit(float(weights.get(None, 1.0)))).otherwise(known), F.lit(1.0))
    out = stored(out.withColumn("rate", rate), "queues")
    every = out.agg(F.sum("rate")).first()[0] or 1.0
    out = out.withColumn("own", F.col("rate") * window >= F.lit(quantum * every))
    large = [(r["source"], r["total"], r["rate"]) for r in out.where("own").collect()]
    large.sort(key=lambda r: (r[1], r[0] is None, r[0] or ""))
    return out, large


def pack(documents: DataFrame, tokenizer: str | None = None, window: int = SEQUENCE, quantum: int = QUANTUM, weights: dict[str | None, float] | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    Every token lies in one piece, the sequences are full but for the last. weights are the proportions in which sources are
    served as long as they last (1 for a source that isn't named); without them each source is served in proportion to its
    tokens and they all last to the end."""
    docs = stored(tokenized(documents, tokenizer or default_tokenizer()), "tokens")
    sums = stored(docs.groupBy("part", "source").agg(F.sum("n").alias("sum")), "sums")
    of, large = queues(sums, window, quantum, weights)
    small = of.where("NOT own").agg(F.sum("total").alias("total"), F.sum("rate").alias("rate")).first()
    # The queue of small sources is the first one.
    clock = Clock(np.array([small["total"] or 0, *(r[1] for r in large)]), np.array([small["rate"] or 1.0, *(r[2] for r in large)]), window)
    before = F.coalesce(F.sum("sum").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = sums.withColumn("before", before).join(of.select(F.col("source").alias("_q"), "rate", "own"), F.col("source").eqNullSafe(F.col("_q"))).drop("_q")
    base = base.withColumn("_last", F.col("source").isNull()).withColumn("time", F.col("before") / F.col("rate"))
    rest = running_sums(base.where("NOT own"), [], ["time", "_last", "source", "part"], {"at": "sum"})
    number = F.lit(0)
    for k, (name, _, _) in enumerate(large, 1):
        number = F.when(F.col("source").eqNullSafe(F.lit(name).cast("string")), k).otherwise(number)
    base = rest.select("part", "source", "at", F.lit(0).alias("queue")).union(base.where("own").select("part", "source", F.col("before").alias("at"), number.alias("queue")))
    base = stored(base.select(F.col("part").alias("_p"), F.col("source").alias("_s"), "at", "queue"), "offsets")
    rows = docs.join(base, (F.col("part") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_s")))
    rows = rows.select("doc_id", "source", (F.col("at") + F.col("local")).alias("at"), "n", "ids", "queue")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for every in batches:
            for s in range(0, every.num_rows, 256):
                b = every.slice(s, 256)
                at, n, queue = (b.column(k).to_numpy().astype(np.int64) for k in (2, 3, 5))
                ids = [memoryview(_ids(x, k)).cast("B") for x, k in zip(b.column(4).to_pylist(), n.tolist(), strict=True)]
                for doc, start, length, number, place in cut(clock, queue, at, n):
                    crc = [zlib.crc32(ids[d][4 * i : 4 * (i + k)]) for d, i, k in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
                    take = pa.array(doc)
                    new = {"start": start, "length": length, "ids_crc32": np.array(crc, dtype=np.int64), "doc_tokens": n[doc], "sequence_id": number, "offset": place}
                    yield pa.RecordBatch.from_arrays([b.column(0).take(take), *map(pa.array, new.values()), b.column(1).take(take)], names=["doc_id", *new, "source"])

    return arrow_map(rows, run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string")

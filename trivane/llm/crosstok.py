"""Alignment of the tokens of two tokenizers, over distinct segments of the texts.

A text, with a blank before it, is split before runs of white space that follow another character and begin with a
blank or line feed, where neither vocabulary can merge across: boundaries() looks through both for an entry that holds a
character other than white space followed by that one. Tokens of a text are then those of its segments, one after the
other. Segments are coded by block (blocks.py): distinct ones of all blocks meet by part, are tokenised and aligned once, and the alignments go back to the blocks,
which compose their texts.

Within a segment, byte offsets at which a token of each tokenizer ends cut both sequences into groups; a token of one
side is linked with all tokens of the other side in its group. How many texts hold an id pair linked is counted by
block, summed by part of the first id, and sent back with whether it is the highest of that id.

A segment whose tokens don't spell it (U+2581 is a blank to the second tokenizer, and shorter) spoils its text: no tokens,
groups or links, and it counts for no pair. Texts that are null or empty have no tokens either. Repeated rows count as often as
they occur; an empty table gives an empty result; extra columns are not read. Texts and segments may be of any length; of a group, the
distinct id pairs are kept with how often they occur."""

from __future__ import annotations

import functools
import hashlib
import json
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivane.llm import blocks
from trivane.llm.common import discard, partitions, stored


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Pair:
    """A byte-level BPE file and a SentencePiece BPE model: ids of both, and bytes of ids."""

    def __init__(self, first: str, second: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        # Byte-level vocabularies write bytes as printable characters: those that print stand for themselves.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(own))}
        added = {t["content"] for t in json.load(open(first, encoding="utf-8")).get("added_tokens", [])}
        self.a_bytes = {i: t.encode() if t in added else bytes(byte_of[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)}
        self.blank = self.b.piece_to_id("▁")
        plain = [p for i, p in enumerate(pieces) if not self.b.is_byte(i) and not self.b.is_control(i) and not self.b.is_unknown(i)]
        self.cuts = boundaries(list(self.a_bytes.values()), plain)
        self.split = re.compile(rf"(?<=\S)(?=[{re.escape(self.cuts)}])").split if self.cuts else lambda text: [text]

    def segments(self, text: str) -> list[bytes]:
        return [s.encode() for s in self.split(" " + text)] if text else []

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both for segments, which begin with a blank or, inside a text, with a line feed."""
        a = [e.ids for e in self.a.encode_batch(segments, add_special_tokens=False)]
        # The second one puts a blank before what it is given: take one away, or take its token away.
        b = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        b = [([self.blank] if s == " " else x) if s[0] == " " else x[1:] for s, x in zip(segments, b, strict=True)]
        return a, b

    def spelt(self, ids: list[int], first: bool) -> bytes:
        return b"".join(map((self.a_bytes if first else self.b_bytes).__getitem__, ids))


def boundaries(first: list[bytes], second: list[str]) -> str:
    """Of blank and line feed those before which both sequences of tokens can be cut, if another character stands before.

    A merged token would be an entry of the vocabulary that holds the two neighbours. A line feed must moreover be in no
    entry of the second one at all, so that the blank put before a text isn't merged with it."""
    out = ""
    for c in " \n":
        # White space beyond ASCII is several bytes, so entries that look like it are read as characters.
        across = re.compile(rb"\S" + c.encode())
        a = any(re.search(rf"\S{c}", t.decode(errors="replace")) for t in first if across.search(t))
        b = any(re.search(r"[^▁]▁", p) for p in second) if c == " " else any(c in p for p in second)
        if not a and not b:
            out += c
    return out


@functools.cache
def tokenizers_of(first: str, second: str) -> Pair:
    return Pair(first, second)


def groups(a: list[int], b: list[int], a_bytes: dict[int, bytes], b_bytes: dict[int, bytes]) -> list[tuple[list[int], list[int]]]:
    """Both sequences cut where tokens of both end."""
    if len(a) == 1 or len(b) == 1:
        return [(a, b)]
    out, i, j, x, y = [], 0, 0, 0, 0
    s = t = 0
    while i < len(a) and j < len(b):
        if x <= y:
            x += len(a_bytes[a[i]])
            i += 1
        while y < x and j < len(b):
            y += len(b_bytes[b[j]])
            j += 1
        if x == y:
            out.append((a[s:i], b[t:j]))
            s, t = i, j
        elif j == len(b):
            break
    if s < len(a) or t < len(b):
        # One side ended with tokens of no bytes or the other goes on: what is left is the last group.
        out.append((a[s:], b[t:]))
    return out


def aligned(segments: list[bytes], pair: Pair, step: int = 2_000) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Groups as text, (n_a, n_b, n_groups, n_links, spelt, distinct id pairs) and (a, b, times) of the pairs of each segment."""
    texts: list[bytes] = []
    counts, flat = array("q"), array("q")
    for s in range(0, len(segments), step):
        part = segments[s : s + step]
        ids_a, ids_b = pair.encode([x.decode() for x in part])
        for raw, a, b in zip(part, ids_a, ids_b, strict=True):
            if pair.spelt(a, True) != raw or pair.spelt(b, False) != raw:
                texts.append(b"")
                counts.extend((0, 0, 0, 0, 0, 0))
                continue
            cut = groups(a, b, pair.a_bytes, pair.b_bytes)
            texts.append(";".join([f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in cut]).encode())
            if len(a) == 1 and len(b) == 1:
                flat.extend((a[0], b[0], 1))
                counts.extend((1, 1, 1, 1, 1, 1))
                continue
            times: dict[tuple[int, int], int] = {}
            links = 0
            for x, y in cut:
                links += len(x) * len(y)
                if len(x) * len(y) < 64:
                    for p in x:
                        for q in y:
                            times[p, q] = times.get((p, q), 0) + 1
                else:
                    for p, n in zip(*(v.tolist() for v in np.unique(x, return_counts=True)), strict=True):
                        for q, m in zip(*(v.tolist() for v in np.unique(y, return_counts=True)), strict=True):
                            times[p, q] = times.get((p, q), 0) + n * m
            for (p, q), n in times.items():
                flat.extend((p, q, n))
            counts.extend((len(a), len(b), len(cut), links, 1, len(times)))
    return texts, np.frombuffer(counts, "<i8").reshape(-1, 6), np.frombuffer(flat, "<i8").reshape(-1, 3)


#: Two tasks of an executor with 3 GB compose a block each: of 20 MB they took more than that.
BLOCK = 12 << 20
NONE = np.zeros(0, dtype=np.int64)
COLUMNS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align(documents: DataFrame, tokenizers: tuple[str, str] | None = None, texts: bool = False, block: int = BLOCK) -> DataFrame:
    """One row per row of documents, by COLUMNS; with texts also the groups themselves, as text."""
    first, second = tokenizers or default_tokenizers()
    parts = partitions(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(True).alias("mark"))
    coded = stored(blocks.encoded(docs, lambda t: tokenizers_of(first, second).segments(t), block=block), "segments")

    def answer(asked: pa.Table) -> pa.Table:
        """Align the distinct segments of a part, and give each block what it asked for."""
        known, where = blocks.numbered(map(blocks.unpack_tokens, asked.column("data").to_pylist()))
        words, counts, pairs = aligned(known, tokenizers_of(first, second))
        begin = np.cumsum(counts[:, 5]) - counts[:, 5]
        rows = []
        for own in where:
            chosen = pairs[blocks.spread(begin[own], counts[own, 5])]
            rows.append((blocks.pack_tokens([words[i] for i in own.tolist()]), blocks.pack_numbers(counts[own].T), blocks.pack_numbers(chosen.T)))
        return pa.table([asked.column("block"), asked.column("codes"), *[pa.array([r[k] for r in rows], pa.binary()) for k in range(3)]], names=["block", "codes", "words", "counts", "pairs"])

    answers = coded.where("part is not null").groupBy("part").applyInArrow(answer, "block long, codes binary, words binary, counts binary, pairs binary")

    names = ["block", "part", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "pairs", "codes"]
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.string(), pa.string(), pa.binary(), pa.binary()]
    schema = "block long, part int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, pairs binary, codes binary"

    def compose(own: pa.Table, got: pa.Table) -> pa.Table:
        """Texts of a block with what doesn't depend on other texts, and by part the id pairs that its texts hold linked."""
        m = sum(len(blocks.unpack(c.as_py())) // 4 for c in got.column("codes"))
        words: list[bytes] = [b""] * m
        counts = np.zeros((m, 6), dtype=np.int64)
        keys, many, at = [], [], np.zeros(m, dtype=np.int64)
        size = 0
        # One part at a time; what a part says is dropped when it is taken over.
        for c, w, n, p in zip(*(got.column(k) for k in ("codes", "words", "counts", "pairs")), strict=True):
            c = blocks.unpack(c.as_py(), "<u4")
            for i, x in zip(c.tolist(), blocks.unpack_tokens(w.as_py()), strict=True):
                words[i] = x
            n = blocks.unpack_numbers(n.as_py()).reshape(6, -1).T
            counts[c] = n
            at[c] = size + np.cumsum(n[:, 5]) - n[:, 5]
            first_ids, second_ids, times = blocks.unpack_numbers(p.as_py()).reshape(3, -1)
            keys.append(first_ids << 32 | second_ids)
            many.append(times.copy())
            size += len(times)
        ids = np.unique(np.concatenate([np.unique(k) for k in keys])) if keys else np.zeros(0, dtype=np.int64)
        name = np.zeros(size, dtype="<i4")
        size = 0
        for k in range(len(keys)):
            name[size : size + len(keys[k])] = np.searchsorted(ids, keys[k])
            size += len(keys[k])
            keys[k] = None
        many = np.concatenate(many) if many else np.zeros(0, dtype=np.int64)
        holds = np.zeros(len(ids), dtype=np.int64)
        rows = []
        number = own.column("block")[0].as_py() if own.num_rows else None
        for i, raw in zip(own.column("doc_id").to_pylist(), own.column("data"), strict=True):
            c = blocks.unpack(raw.as_py(), "<u4")
            if not len(c) or not counts[c, 4].all():
                rows.append((number, None, i, 0, 0, 0, 0, "", "" if texts else None, blocks.pack_numbers(NONE), None))
                continue
            joined = b";".join([words[k] for k in c.tolist()])
            flat = blocks.spread(at[c], counts[c, 5])
            used, back = np.unique(name[flat], return_inverse=True)
            holds[used] += 1
            times = np.bincount(back, weights=many[flat]).astype("<i8")
            rows.append((number, None, i, *counts[c, :4].sum(axis=0).tolist(), hashlib.sha256(joined).hexdigest(), joined.decode() if texts else None, blocks.pack_numbers(np.concatenate([used, times])), None))
        held = np.flatnonzero(holds)
        of = (ids[held] >> 32) % parts
        order = np.argsort(of, kind="stable")
        for g in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
            if len(g):
                k = held[g]
                rows.append((number, int(of[g[0]]), *[None] * 7, blocks.pack_numbers(np.concatenate([ids[k], holds[k]])), blocks.pack(k.astype("<u4"))))
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    composed = stored(coded.where("part is null").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(compose, schema), "alignments")
    discard(coded)

    def count(asked: pa.Table) -> pa.Table:
        """Over all blocks: how many texts hold each pair, and whether no pair of its first id is held by more."""
        lists = [blocks.unpack_numbers(p.as_py()).reshape(2, -1) for p in asked.column("pairs")]
        ids, back = np.unique(np.concatenate([x[0] for x in lists]), return_inverse=True)
        total = np.zeros(len(ids), dtype=np.int64)
        np.add.at(total, back, np.concatenate([x[1] for x in lists]))
        first_id, group = np.unique(ids >> 32, return_inverse=True)
        most = np.zeros(len(first_id), dtype=np.int64)
        np.maximum.at(most, group, total)
        best = total == most[group]
        out, s = [], 0
        for x in lists:
            k = back[s : s + x.shape[1]]
            s += len(k)
            out.append(blocks.pack_numbers(np.concatenate([total[k], best[k]])))
        return pa.table([asked.column("block"), asked.column("codes"), pa.array(out, pa.binary())], names=["block", "codes", "totals"])

    totals = composed.where("part is not null").select("block", "part", "pairs", "codes").groupBy("part").applyInArrow(count, "block long, codes binary, totals binary")

    def finish(own: pa.Table, got: pa.Table) -> pa.Table:
        codes = [blocks.unpack(c, "<u4") for c in got.column("codes").to_pylist()]
        n = max((int(c.max()) + 1 for c in codes), default=0)
        total, best = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        for c, x in zip(codes, got.column("totals").to_pylist(), strict=True):
            total[c], best[c] = blocks.unpack_numbers(x).reshape(2, -1)
        sums: list[tuple[int, int]] = []
        for raw in own.column("pairs"):
            used, times = blocks.unpack_numbers(raw.as_py()).reshape(2, -1)
            sums.append((int((times * best[used]).sum()), int((times * total[used]).sum())))
        more = [pa.array([x[k] for x in sums], pa.int64()) for k in range(2)]
        kept = [own.column(k) for k in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
        last = [own.column(k) for k in ("groups_sha256", "groups")[: 1 + texts]]
        return pa.table([*kept, *more, *last], names=[c.split()[0] for c in out_schema.split(", ")])

    out_schema = COLUMNS + (", groups string" if texts else "")
    rows = composed.where("part is null").drop("part", "codes")
    return rows.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(finish, out_schema)

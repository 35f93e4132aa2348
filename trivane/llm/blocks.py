"""Texts as codes of distinct tokens by block, and questions about these tokens that the whole corpus answers.

A block is a stretch of rows of one task, of about BLOCK bytes. It is written as one row for each text, its tokens as codes (numbers
of the block's distinct tokens in order of first appearance), and one row for each part of the hash range, with the
distinct tokens of that part (packed into a binary value) and what the block knows about them. groupBy("part") brings together what
all blocks know about a token, whoever holds it, and answers go back to the blocks, in the order in which they asked; a
cogroup by block then composes the texts. So what is shuffled is a row for each block and part, however often a token occurs in a block, and a token that a third of all
words are costs one entry in each block. Parts are as many as shuffle partitions, so that they can be set for the input."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from trivane.llm.common import arrow_map, partitions

BLOCK = 20 << 20
#: A text's codes, or the tokens of a part: data; then codes of these tokens and whatever more the block tells of them.
SCHEMA = "block long, part int, doc_id long, mark boolean, data binary, codes binary, more binary"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]


def pack(x: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes())


def unpack(raw: bytes, dtype=None) -> np.ndarray | bytes:
    data = zstandard.ZstdDecompressor().decompress(raw)
    return data if dtype is None else np.frombuffer(data, dtype)


def pack_numbers(x: np.ndarray) -> bytes:
    """Whole numbers, their lowest bytes first, then the next ones: small numbers of any kind cost little."""
    return pack(np.ascontiguousarray(np.asarray(x).astype("<i8").reshape(-1, 1).view(np.uint8).T))


def unpack_numbers(raw: bytes) -> np.ndarray:
    planes = unpack(raw, np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").reshape(-1)


def pack_tokens(tokens: list[bytes]) -> bytes:
    """The byte 255 is in no UTF-8 text."""
    return pack(b"\xff".join(tokens))


def unpack_tokens(raw: bytes) -> list[bytes]:
    return unpack(raw).split(b"\xff")


#: What a block tells of its tokens beside their codes: from the tokens, the texts' codes and marks, and the codes of a part.
More = Callable[[list[bytes], list[np.ndarray], list[bool]], Callable[[np.ndarray], np.ndarray | bytes]]


def encoded(documents: DataFrame, split: Callable[[str], list[bytes]], more: More | None = None, block: int = BLOCK) -> DataFrame:
    """Rows of texts (part is null) and of parts, by SCHEMA. documents has the columns doc_id, text and mark.

    split gives the tokens of a text; null texts count as empty."""
    parts = partitions(documents.sparkSession)

    def flush(number: int, tokens: list[bytes], ids: list, marks: list[bool], codes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for s in range(0, len(ids), 2048):
            k = len(ids[s : s + 2048])
            data = [pack(c) for c in codes[s : s + 2048]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([number] * k, [None] * k, ids[s : s + k], marks[s : s + k], data, [None] * k, [None] * k), _TYPES, strict=True)], names=NAMES)
        of = np.fromiter((zlib.crc32(t) % parts for t in tokens), dtype=np.int64, count=len(tokens))
        order = np.argsort(of, kind="stable")
        told = more(tokens, codes, marks) if more else None
        for own in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
            if len(own):
                row = [number, int(of[own[0]]), None, None, pack_tokens([tokens[i] for i in own.tolist()]), pack(own.astype("<u4")), pack(told(own)) if told else None]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _TYPES, strict=True)], names=NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        known: dict[bytes, int] = {}
        ids, marks, codes, size = [], [], [], 0
        for b in batches:
            for i, text, mark in zip(*(b.column(k) for k in range(3)), strict=True):
                text = text.as_py() or ""
                ids.append(i.as_py())
                marks.append(mark.as_py())
                codes.append(np.array([known.setdefault(t, len(known)) for t in split(text)], dtype="<u4"))
                size += len(text)
                if size >= block:
                    yield from flush(number, list(known), ids, marks, codes)
                    number, size = number + 1, 0
                    known, ids, marks, codes = {}, [], [], []
        if ids:
            yield from flush(number, list(known), ids, marks, codes)

    return arrow_map(documents.select("doc_id", "text", "mark"), run, SCHEMA)


def numbered(lists: Iterable[list[bytes]]) -> tuple[list[bytes], list[np.ndarray]]:
    """The distinct tokens of several lists, and each list as their numbers."""
    known: dict[bytes, int] = {}
    where = [np.array([known.setdefault(t, len(known)) for t in x], dtype=np.int64) for x in lists]
    return list(known), where


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ..., count of them, for each entry."""
    return np.repeat(first, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)

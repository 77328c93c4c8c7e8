"""Documents as word codes, a chunk at a time: the texts are split once and travel in a small form."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut, integer_key

#: Bytes of text in a chunk; a longer document is a chunk of its own.
CHUNK_BYTES = 4_000_000
SCHEMA = "chunk long, ids array<long>, marks array<long>, lengths binary, codes binary, words binary, n_words int, n_tokens long"
#: Holds a space, so no word equals it.
END = b" end"


@dataclass
class Chunk:
    """``codes`` of all documents one after the other; a code is the place of the word's hash in ``words``. ``marks``: see ``encode_chunks``."""

    number: int
    ids: list
    marks: list
    lengths: np.ndarray
    codes: np.ndarray
    words: np.ndarray

    def bounds(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.lengths, dtype=np.int64)))


def pack_array(a: np.ndarray) -> bytes:
    """Compressed, with the length before it."""
    raw = np.ascontiguousarray(a).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack_array(b: bytes, dtype) -> np.ndarray:
    size = int.from_bytes(b[:8], "little")
    return np.frombuffer(pa.decompress(b[8:], decompressed_size=size, codec="zstd", asbytes=True), dtype=dtype) if size else np.zeros(0, dtype)


def pack_codes(codes: np.ndarray, words: np.ndarray) -> tuple[bytes, bytes]:
    """The codes and words of a chunk in a small form: words by how often they are used, codes as planes of bytes."""
    order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
    place = np.empty(len(words), dtype=np.uint32)
    place[order] = np.arange(len(words), dtype=np.uint32)
    placed = place[codes]
    planes = [pack_array((placed >> np.uint32(8 * k)).astype(np.uint8)) for k in range(3 if len(words) <= 1 << 24 else 4)]
    return b"".join(len(x).to_bytes(8, "little") + x for x in planes), pack_array(words[order])


def unpack_codes(packed: bytes, packed_words: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Codes and sorted words again."""
    used = unpack_array(packed_words, np.uint64)
    order = np.argsort(used)
    place = np.empty(len(used), dtype=np.uint32)
    place[order] = np.arange(len(used), dtype=np.uint32)
    placed, at, shift = None, 0, 0
    while at < len(packed):
        size = int.from_bytes(packed[at : at + 8], "little")
        plane = unpack_array(packed[at + 8 : at + 8 + size], np.uint8).astype(np.uint32)
        placed = plane if placed is None else placed | (plane << np.uint32(shift))
        at, shift = at + 8 + size, shift + 8
    return (place[placed] if len(used) else np.zeros(0, np.uint32)), used[order]


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def encode(ids: list, texts: list[bytes], end: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, codes and word hashes (64-bit, sorted) of documents; A-Z count as a-z; ``end`` adds a token to each."""
    known = _Codes()
    look = known.__getitem__
    parts, lengths = [], np.zeros(len(texts), dtype=np.int32)
    for i, text in enumerate(texts):
        words = text.lower().split()
        if end:
            words.append(END)
        lengths[i] = len(words)
        parts.append(np.fromiter(map(look, words), dtype=np.uint32, count=len(words)))
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in known), dtype=np.uint64, count=len(known))
    words, place = np.unique(hashes, return_inverse=True)
    codes = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    return lengths, place.astype(np.uint32)[codes] if len(codes) else codes, words


def encode_chunks(docs: DataFrame, text: str, key: str, end: bool = False, name: str = "chunks", marked: bool = False) -> DataFrame:
    """A stored table with one row for each chunk of documents, in the order in which tasks read them; ``marked``: with Spark's xxhash64 of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, marks, texts, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            lengths, codes, words = encode(ids, texts, end)
            columns = [[number], [ids], [marks], [pack_array(lengths)], *([x] for x in pack_codes(codes, words)), [len(words)], [len(codes)]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            for i, m, raw in zip(batch.column("id").to_pylist(), batch.column("mark").to_pylist(), batch.column("raw"), strict=True):
                raw = raw.as_py() or b""
                ids.append(i)
                marks.append(m)
                texts.append(raw)
                held += len(raw) + 64
                if held >= CHUNK_BYTES:
                    yield flush()
                    ids, marks, texts, held, number = [], [], [], 0, number + 1
        if ids:
            yield flush()

    rows = docs.select(integer_key(docs, key).alias("id"), (F.xxhash64(text) if marked else F.lit(None).cast("long")).alias("mark"), F.col(text).cast("binary").alias("raw"))
    return cut(rows.mapInArrow(run, SCHEMA), name)


def chunks_of(batch: pa.RecordBatch) -> Iterator[tuple[int, Chunk]]:
    """The row's place in the batch, and its chunk."""
    for i in range(batch.num_rows):
        row = {c: batch.column(c)[i].as_py() for c in ("chunk", "ids", "marks", "lengths", "codes", "words")}
        yield i, Chunk(row["chunk"], row["ids"], row["marks"], unpack_array(row["lengths"], np.int32), *unpack_codes(row["codes"], row["words"]))


def range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Bounds of ``ranges`` equal parts of the hash space in a sorted array."""
    starts = (np.arange(1, ranges, dtype=np.uint64) * np.uint64((1 << 64) // ranges)).astype(np.uint64)
    return np.concatenate(([0], np.searchsorted(hashes, starts), [len(hashes)]))

"""Byte-level BPE: encoding by padded numpy matrices, and decoding."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import tokenizer_path

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Rank of a pair that does not merge.
NONE = np.iinfo(np.int32).max
#: Pieces of more bytes than this are merged one by one, with a heap in place of a row of a matrix.
WIDEST = 512
#: Cells of one matrix.
CELLS = 1 << 20
#: Texts are handled in groups of about so many characters; a longer text is read in slices of so many pieces.
GROUP_CHARS, SLICE = 2_000_000, 200_000
#: Multiplier of the pair hash (the golden ratio in 64 bits).
SPREAD = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Rank of what two neighbouring tokens merge to: an open-addressed hash table in two numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> None:
        bits = max(4, int(4 * len(rank)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << bits, NONE, dtype=np.int32)
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        rank = rank.astype(np.int32)
        at = self._home(keys)
        while len(keys):  # all keys that still look for a slot try theirs; one of each slot gets it
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            self.ranks[at[free]] = rank[free]
            lost = self.keys[at] != keys
            # where several keys wrote to one slot, the rank must be the winner's
            won = free & ~lost
            self.ranks[at[won]] = rank[won]
            keys, rank, at = keys[lost], rank[lost], (at[lost] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * SPREAD) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; a pair with a negative id, or that does not merge, has rank NONE."""
        out = np.full(left.shape, NONE, dtype=np.int32)
        open_ = np.flatnonzero(((left >= 0) & (right >= 0)).ravel())
        keys = (left.ravel()[open_].astype(np.int64) << 32) | right.ravel()[open_].astype(np.int64)
        at, flat = self._home(keys), out.reshape(-1)
        while len(open_):
            held = self.keys[at]
            hit = held == keys
            flat[open_[hit]] = self.ranks[at[hit]]
            on = ~hit & (held >= 0)
            open_, keys, at = open_[on], keys[on], (at[on] + 1) & self.mask
        return flat.reshape(left.shape)


class ByteBpe:
    """A rank file: an id is a rank, and the rank of a pair is that of its joined bytes."""

    def __init__(self, path: str, pattern: str | None = None, most: int = 500_000) -> None:
        import regex

        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks, self.most = ranks, most
        self.find = regex.compile(pattern)
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int32)
        if (self.single < 0).any():
            raise ValueError("the vocabulary lacks some single bytes")
        found = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.pairs = PairTable(*np.array(found, dtype=np.int64).reshape(-1, 3).T)
        top = max(ranks.values()) + 1
        self.width = np.full(top, -1, dtype=np.int64)
        tokens = sorted(ranks.items(), key=lambda x: x[1])
        self.width[[r for _, r in tokens]] = [len(t) for t, _ in tokens]
        self.start = np.concatenate(([0], np.cumsum(np.maximum(self.width, 0))))[:-1]
        self.flat = np.frombuffer(b"".join(t for t, _ in tokens), dtype=np.uint8)
        self.known: dict[str, bytes] = {}

    def merge_rows(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (little-endian, 32 bits) of pieces of up to ``WIDEST`` bytes.

        Pieces are dealt out by length to matrices of one padded width. In each round every row
        merges its leftmost pair of least rank; the cells to the right move up, so all rows, and
        the matrix, get one column shorter. Rows without a pair to merge leave the matrix.
        """
        out: list[bytes] = [b""] * len(pieces)
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        order = np.argsort(lengths, kind="stable")
        at = 0
        while at < len(order):
            widest = 1 << max(1, int(lengths[order[at]] - 1).bit_length())  # a bucket is a power of two
            end = int(np.searchsorted(lengths[order], widest, side="right"))
            end = min(end, at + max(1, CELLS // widest))
            rows = order[at:end]
            width = int(lengths[rows[-1]])
            raw = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in rows.tolist()), dtype=np.uint8).reshape(len(rows), width)
            ids = np.where(np.arange(width) < lengths[rows][:, None], self.single[raw], np.int32(-1))
            self._merge(ids, rows, out)
            at = end
        return out

    def _merge(self, ids: np.ndarray, rows: np.ndarray, out: list[bytes]) -> None:
        rank = self.pairs(ids[:, :-1], ids[:, 1:])
        while len(rows):
            if rank.shape[1]:
                at = rank.argmin(axis=1)  # the leftmost of equal ones
                best = np.take_along_axis(rank, at[:, None], 1)[:, 0]
            else:
                at, best = np.zeros(len(rows), dtype=np.int64), np.full(len(rows), NONE, dtype=np.int32)
            done = best == NONE
            if done.any():
                left = ids[done]
                sizes = (left >= 0).sum(axis=1)
                raw, wide = left.astype("<i4").tobytes(), 4 * left.shape[1]
                for i, a, n in zip(rows[done].tolist(), range(0, len(raw), wide), sizes.tolist(), strict=True):
                    out[i] = raw[a : a + 4 * n]
                on = ~done
                ids, rank, rows, at, best = ids[on], rank[on], rows[on], at[on], best[on]
                if not len(rows):
                    return
            line = np.arange(len(rows))
            column = np.arange(ids.shape[1] - 1)
            ids[line, at] = best
            ids = np.where(column > at[:, None], ids[:, 1:], ids[:, :-1])
            column = column[:-1]
            rank = np.where(column > at[:, None], rank[:, 1:], rank[:, :-1]) if len(column) else rank[:, :0]
            # the merged token has a new pair on either side
            before = at > 0
            rank[line[before], at[before] - 1] = self.pairs(ids[line[before], at[before] - 1], best[before])
            after = at < ids.shape[1] - 1
            rank[line[after], at[after]] = self.pairs(best[after], ids[line[after], at[after] + 1])

    def merge_long(self, piece: bytes) -> bytes:
        """The same merges in the same order for one long piece, from a heap of (rank, place): a row of a matrix would take its square in time."""
        ids = self.single[np.frombuffer(piece, dtype=np.uint8)]
        first = self.pairs(ids[:-1], ids[1:])
        heap = [(r, i) for i, r in enumerate(first.tolist()) if r != NONE]
        heapq.heapify(heap)
        ends = list(range(1, len(ids) + 1))  # a token at i reaches to ends[i]; begins[e] is where the token that ends at e begins
        begins = list(range(-1, len(ids)))
        token: list[int] = ids.tolist()

        def pair(i: int, j: int) -> int:
            return self.ranks.get(piece[i : ends[j]], NONE)

        while heap:
            r, i = heapq.heappop(heap)
            if token[i] < 0 or ends[i] >= len(ids) or pair(i, ends[i]) != r:
                continue  # merged meanwhile
            j = ends[i]
            token[i], token[j] = r, -1
            ends[i] = ends[j]
            begins[ends[i]] = i
            for a, b in ((begins[i] if i else -1, i), (i, ends[i])):
                if a >= 0 and b < len(ids) and (new := pair(a, b)) != NONE:
                    heapq.heappush(heap, (new, a))
        return np.array([t for t in token if t >= 0], dtype="<u4").tobytes()

    def learn(self, pieces: Iterable[str]) -> None:
        """Put the ids of pieces into the store; a piece that is a token itself is that token."""
        new = [p for p in set(pieces) if p not in self.known]
        raw = [p.encode("utf-8", "surrogatepass") for p in new]
        rows: list[int] = []
        for i, b in enumerate(raw):
            if (r := self.ranks.get(b)) is not None:
                self.known[new[i]] = r.to_bytes(4, "little")
            elif len(b) > WIDEST:
                self.known[new[i]] = self.merge_long(b)
            else:
                rows.append(i)
        for i, ids in zip(rows, self.merge_rows([raw[i] for i in rows]), strict=True):
            self.known[new[i]] = ids

    def encode_group(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that together fit into memory."""
        if len(self.known) > self.most:
            self.known.clear()
        parts = [self.find.findall(t) for t in texts]
        self.learn(p for part in parts for p in part)
        return [np.frombuffer(b"".join(map(self.known.__getitem__, part)), dtype="<u4") for part in parts]

    def encode_long(self, text: str) -> np.ndarray:
        """Ids of a very long text, a slice of its pieces at a time."""
        found, parts = (m.group() for m in self.find.finditer(text)), []
        while part := list(islice(found, SLICE)):
            if len(self.known) > self.most:
                self.known.clear()
            self.learn(part)
            parts.append(b"".join(map(self.known.__getitem__, part)))
        return np.frombuffer(b"".join(parts), dtype="<u4")

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text in turn; null is empty."""
        held, size = [], 0
        for text in texts:
            text = text or ""
            if len(text) > GROUP_CHARS:
                yield from self.encode_group(held)
                held, size = [], 0
                yield self.encode_long(text)
                continue
            held.append(text)
            size += len(text)
            if size > GROUP_CHARS:
                yield from self.encode_group(held)
                held, size = [], 0
        yield from self.encode_group(held)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, gathered from the joined bytes of all tokens."""
        ids = ids.astype(np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.width) or (self.width[ids] < 0).any()):
            raise ValueError("an id is not in the vocabulary")
        parts = []
        for i in range(0, len(ids), 1 << 20):
            some = ids[i : i + (1 << 20)]
            wide = self.width[some]
            ends = np.cumsum(wide)
            shift = np.repeat(self.start[some] - (ends - wide), wide)
            parts.append(self.flat[shift + np.arange(len(shift))].tobytes())
        return b"".join(parts)


_CODERS: dict[tuple[str, str | None], ByteBpe] = {}


def byte_bpe(path: str, pattern: str | None = None) -> ByteBpe:
    """One for each worker process."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = ByteBpe(path, pattern)
    return _CODERS[path, pattern]


#: Bytes of ids and texts in one batch of results.
BATCH_BYTES = 8_000_000


def _run(docs: DataFrame, text: str, key: str, path: str, pattern: str | None, back: bool) -> DataFrame:
    kind = docs.select(key).schema[0].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("ids", T.ArrayType(T.IntegerType(), False)), *([T.StructField("decoded", T.BinaryType())] if back else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_bpe(path, pattern)
        for batch in batches:
            keys, begun, held, size = batch.column("key"), 0, [], 0

            def flush(keys=keys) -> pa.RecordBatch:
                bounds = np.concatenate(([0], np.cumsum([len(x) for x in held]))).astype(np.int32)
                flat = np.concatenate(held) if held else np.zeros(0, np.uint32)
                columns = [keys.slice(begun, len(held)), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat.astype(np.int32)))]
                if back:
                    columns.append(pa.array([coder.decode(x) for x in held], type=pa.binary()))
                return pa.RecordBatch.from_arrays(columns, names=["key", "ids", "decoded"][: len(columns)])

            for ids in coder.encode(value.as_py() for value in batch.column("text")):
                held.append(ids)
                size += 8 * len(ids) + 64
                if size > BATCH_BYTES:
                    yield flush()
                    begun, held, size = begun + len(held), [], 0
            if held:
                yield flush()

    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def encode(docs: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, ids array<int>) of each row: the ids of its whole text, without special tokens.

    Each match of ``pattern`` is merged by itself. A piece that is a token is that token; any other
    starts as single bytes, and the leftmost of its neighbouring pairs of least rank merges, until
    none does. New pieces of a task are merged together in matrices; a store of pieces, bounded in
    entries, spares those that come again. Pieces of more than 512 bytes give the same ids by way of
    a heap.

    Null and empty texts have no ids. Very long texts are read in slices. Keys may be of any type;
    rows with null or repeated keys each have their own row. Other columns are not read. An empty
    table gives an empty table. No shuffle.
    """
    return _run(docs, text, key, vocabulary or tokenizer_path(VOCABULARY), pattern, back=False)


def round_trip(docs: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """``encode`` with a column ``decoded``: the bytes that the ids decode to, found in the same pass."""
    return _run(docs, text, key, vocabulary or tokenizer_path(VOCABULARY), pattern, back=True)


def decode(rows: DataFrame, ids: str = "ids", key: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """(key, decoded binary): the bytes of each row's ids; null ids give null, no ids give no bytes.

    An id that the vocabulary lacks, or a null among the ids, stops the job with an error.
    """
    path = vocabulary or tokenizer_path(VOCABULARY)
    kind = rows.select(key).schema[0].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_bpe(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                out = []
                for value in part.column("ids"):
                    if not value.is_valid:
                        out.append(None)
                        continue
                    if value.values.null_count:
                        raise ValueError("a null among the ids")
                    out.append(coder.decode(value.values.to_numpy(zero_copy_only=False)))
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(out, type=pa.binary())], names=["key", "decoded"])

    schema = T.StructType([T.StructField("key", kind), T.StructField("decoded", T.BinaryType())])
    return rows.select(F.col(key).alias("key"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, schema).withColumnRenamed("key", key)

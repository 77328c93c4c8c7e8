"""Packing documents into training sequences by order-preserving dynamic programming."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import tokenizer_path, word_coder
from .scratch import integer_key


@dataclass(frozen=True)
class Costs:
    """What a plan pays, in tokens of padding.

    ``sentence``: a cut inside a document after a sentence; ``inside``: any other cut inside a
    document, offered every ``stride`` tokens where no sentence ends for that long; ``sequence``:
    each sequence, so that short ones (which need no padding at a power of two) are not free.
    """

    sentence: float = 6.0
    inside: float = 40.0
    stride: int = 128
    sequence: float = 24.0


def cut_places(doc_ends: np.ndarray, sentence_ends: np.ndarray, costs: Costs) -> tuple[np.ndarray, np.ndarray]:
    """Offsets at which a sequence may end, from 0 on, and what each costs."""
    soft = np.union1d(sentence_ends, doc_ends)
    known = np.concatenate(([0], soft)).astype(np.int64)
    known = np.unique(known)
    gaps = np.diff(known)
    wide = np.flatnonzero(gaps > costs.stride)
    more = [np.arange(known[i] + costs.stride, known[i + 1], costs.stride) for i in wide]
    places = np.union1d(known, np.concatenate(more)) if more else known
    price = np.full(len(places), costs.inside)
    price[np.searchsorted(places, sentence_ends)] = costs.sentence
    price[np.searchsorted(places, doc_ends)] = 0.0
    price[0] = 0.0
    return places, price


def best_cuts(places: np.ndarray, price: np.ndarray, width: int, costs: Costs) -> list[int]:
    """Offsets of the cuts of the cheapest plan, ends included.

    ``f(j) = price(j) + min f(i) + pad(p(j) - p(i))`` over the places i at most ``width`` before j.
    As the padding is ``width - p(j) + p(i)``, the best i is the least ``f(i) + p(i)`` in a sliding
    window, which a monotone queue gives in constant time. Lengths that are a power of two have no
    padding: those pairs of places are found beforehand.
    """
    n = len(places)
    if n == 1:
        return [0]
    exact_j, exact_i = [], []
    step = 1
    while step <= width:
        at = np.searchsorted(places, places - step)
        hit = np.flatnonzero((at < n) & (places[np.minimum(at, n - 1)] == places - step))
        exact_j.append(hit)
        exact_i.append(at[hit])
        step *= 2
    j_all, i_all = np.concatenate(exact_j), np.concatenate(exact_i)
    order = np.argsort(j_all, kind="stable")
    j_list, i_list = j_all[order].tolist(), i_all[order].tolist()
    j_list.append(n)
    p, c = places.tolist(), (price + costs.sequence).tolist()
    f, back = [0.0] * n, [0] * n
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    nxt = 0
    for j in range(1, n):
        here = p[j]
        while p[queue[0][1]] < here - width:
            queue.popleft()
        least, i = queue[0]
        best = least + width - here
        while j_list[nxt] == j:
            other = f[i_list[nxt]]
            if other < best:
                best, i = other, i_list[nxt]
            nxt += 1
        f[j], back[j] = best + c[j], i
        value = f[j] + here
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return [p[j] for j in reversed(cuts)]


OUT = "key long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, ids binary"
NAMES = [x.split()[0] for x in OUT.split(", ")]
KINDS = [pa.int64()] * 8 + [pa.binary()]


def pack_block(keys: list, coded: list[bytes], ends_sentence: np.ndarray, width: int, costs: Costs, first: int, with_ids: bool) -> tuple[list[list], int]:
    """Columns of the pieces of a block of documents; the number of the next sequence."""
    raw = b"".join(coded)
    ids = np.frombuffer(raw, dtype="<u4")
    doc_ends = np.cumsum([len(x) // 4 for x in coded])
    doc_starts = np.concatenate(([0], doc_ends[:-1]))
    sentence_ends = np.flatnonzero(ends_sentence[np.minimum(ids, len(ends_sentence) - 1)]) + 1
    cuts = np.array(best_cuts(*cut_places(doc_ends, sentence_ends, costs), width, costs), dtype=np.int64)
    bounds = np.union1d(np.concatenate(([0], doc_ends)), cuts)
    starts, stops = bounds[:-1], bounds[1:]
    doc = np.searchsorted(doc_ends, starts, side="right")
    seq = np.searchsorted(cuts, starts, side="right") - 1
    spans = list(zip((starts * 4).tolist(), (stops * 4).tolist(), strict=True))
    columns = [
        [keys[d] for d in doc.tolist()],
        (starts - doc_starts[doc]).tolist(),
        (stops - starts).tolist(),
        [zlib.crc32(raw[a:b]) for a, b in spans],
        (doc_ends - doc_starts)[doc].tolist(),
        (seq + first).tolist(),
        (starts - cuts[seq]).tolist(),
        np.diff(cuts)[seq].tolist(),
        [raw[a:b] if with_ids else None for a, b in spans],
    ]
    return columns, first + len(cuts) - 1


def pack(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 2048, costs: Costs = Costs(), end_id: int = 1, vocabulary: str | None = None, block: int = 256, with_ids: bool = True, words: int = 200_000) -> DataFrame:
    """Sequences of at most ``width`` tokens, as a row for each piece of a document.

    Documents keep the order in which a task reads them, and are planned a block of about ``block``
    full sequences at a time, so memory is bounded by the block (or by the longest document) and the
    only waste besides the plan's is at the end of a block. There is no shuffle. A sequence number
    holds the partition in its upper bits; a lost task is done again over the same rows and gives the
    same numbers.

    Columns: key, ``start`` (tokens of the document before the piece), ``length``, ``ids_crc32`` (of
    the little-endian 32-bit ids), ``doc_tokens``, ``sequence_id``, ``offset`` (of the piece in its
    sequence), ``sequence_tokens`` (before padding) and ``ids`` (binary; null without ``with_ids``).

    ``words`` of a worker's latest words are kept with their ids; more take memory and save time, and give the same rows.

    Null and empty texts are the one token ``end_id``. Null keys and repeated rows are packed as they
    come. An empty table gives an empty table. Other columns are not read.
    """
    path = vocabulary or tokenizer_path("word_bpe_49k.json")
    tail = np.array([end_id], dtype="<u4").tobytes()
    costs = replace(costs, stride=min(costs.stride, max(1, width // 2)))
    room = block * width * 4

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = word_coder(path, words)
        ends_sentence = coder.sentence_ends()
        number = TaskContext.get().partitionId() << 36
        keys, coded, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, keys, coded, held
            columns, number = pack_block(keys, coded, ends_sentence, width, costs, number, with_ids)
            keys, coded, held = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, KINDS, strict=True)], names=NAMES)

        for batch in batches:
            for k, value in zip(batch.column("key").to_pylist(), batch.column("raw").to_pylist(), strict=True):
                ids = coder.encode(value or b"") + tail
                keys.append(k)
                coded.append(ids)
                held += len(ids)
                if held >= room:
                    yield flush()
        if keys:
            yield flush()

    rows = docs.select(integer_key(docs, key).alias("key"), F.col(text).cast("binary").alias("raw"))
    return rows.mapInArrow(plan, OUT).withColumnRenamed("key", key)

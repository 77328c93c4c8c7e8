"""Token counts of sections by offsets of tokens in whole documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import byte_coder, tokenizer_path
from .scratch import integer_key

RULES = ("first", "last", "largest", "share")
OUT = "key long, section int, start long, length long, tokens double, crossing long"


def section_bounds(raw: bytes, mark: bytes) -> np.ndarray:
    """Bytes at which sections begin, and the end of the text: each section but the last ends with ``mark``."""
    at, found = [0], raw.find(mark)
    while found >= 0:
        at.append(found + len(mark))
        found = raw.find(mark, at[-1])
    return np.array([*at, len(raw)], dtype=np.int64)


def attribute(bounds: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of those lie partly in another section.

    ``ends`` are where tokens end; each begins where the one before ends. Both lists are sorted, so
    the join of the spans is a binary search for each end of a token, and tokens that cross a bound
    are few. These go to the section of their first character (``first``), of their last (``last``),
    to the one that holds most of it (``largest``; of equal ones the earlier), or to each by its
    share (``share``). Empty sections hold none.
    """
    n = len(bounds) - 1
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    # the section that holds a byte: the last one that begins at or before it
    a = np.searchsorted(bounds[1:], starts, side="right")
    b = np.searchsorted(bounds[1:], ends - 1, side="right")
    counts = np.zeros(n, dtype=np.float64)
    crossing = np.zeros(n, dtype=np.int64)
    inside = a == b
    counts += np.bincount(a[inside], minlength=n)[:n]
    for s, e, i, j in zip(starts[~inside].tolist(), ends[~inside].tolist(), a[~inside].tolist(), b[~inside].tolist(), strict=True):
        overlap = [min(e, int(bounds[k + 1])) - max(s, int(bounds[k])) for k in range(i, j + 1)]
        for k, part in enumerate(overlap, i):
            crossing[k] += part > 0
        if rule == "first":
            counts[i] += 1
        elif rule == "last":
            counts[j] += 1
        elif rule == "largest":
            counts[i + int(np.argmax(overlap))] += 1
        else:
            for k, part in enumerate(overlap, i):
                counts[k] += part / (e - s)
    return counts, crossing


def _characters(raw: bytes, at: np.ndarray) -> np.ndarray:
    """How many characters begin before each byte."""
    if raw.isascii():
        return at
    data = np.frombuffer(raw, dtype=np.uint8)
    before = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return before[at]


def section_tokens(docs: DataFrame, text: str = "text", key: str = "doc_id", mark: str = "\n", rule: str = "first", vocabulary: str | None = None) -> DataFrame:
    """Tokens of each section of each document.

    A document is encoded once, whole, as its tokens would be in training; the byte spans of the
    tokens are joined to the sections, which end after each ``mark``. Returns a row for each section:
    key, ``section`` (from 0), ``start`` and ``length`` in characters, ``tokens`` (double; whole
    unless ``rule`` is ``share``) and ``crossing`` (tokens that lie partly in another section). The
    tokens of a document's sections sum to the tokens of the document.

    Null and empty texts have one empty section without tokens. Rows with null or repeated keys each
    give their own sections. An empty table gives an empty table. Other columns are not read. No
    shuffle: each task encodes the documents that it reads, one at a time.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    path = vocabulary or tokenizer_path("byte_bpe_50k.tiktoken")
    cut_at = mark.encode()
    if not cut_at:
        raise ValueError("mark is empty")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_coder(path)
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            for k, value in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
                whole = value.as_py() or ""
                raw = whole.encode()
                bounds = section_bounds(raw, cut_at)
                counts, crossing = attribute(bounds, coder.ends(whole), rule)
                at = _characters(raw, bounds)
                for column, values in zip(columns, ([k] * len(counts), range(len(counts)), at[:-1].tolist(), np.diff(at).tolist(), counts.tolist(), crossing.tolist()), strict=True):
                    column.extend(values)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=["key", "section", "start", "length", "tokens", "crossing"])

    rows = docs.select(integer_key(docs, key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(encode, OUT).withColumnRenamed("key", key)


def document_tokens(sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """Tokens of each document, from its sections."""
    return sections.groupBy(key).agg(F.sum("tokens").cast("long").alias("tokens"), F.count(F.lit(1)).alias("sections"))

"""Lines that repeat across documents, found on range-partitioned hashes."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import LOWER, SPACE_CHARS, UPPER, cut, integer_key, lanes



def document(docs: DataFrame, text: str, key: str) -> Column:
    """What tells documents apart: the key; a row with a null key is known by its text."""
    return F.coalesce(integer_key(docs, key), F.xxhash64(F.lit("no key"), F.col(text)))


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACE_CHARS)), UPPER, LOWER)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def row_id(key: Column, text: Column) -> Column:
    """A row is known by its key and its text: rows that repeat both have one result."""
    return F.xxhash64(key, F.lit("|"), text)


def occurrences(docs: DataFrame, text: str, key: str, least: int) -> DataFrame:
    """(h, h2, id, rid, pos): the 128-bit hash of each line's key, for keys of ``least`` code points or more."""
    lines = docs.select(
        document(docs, text, key).alias("id"),
        row_id(F.col(key), F.col(text)).alias("rid"),
        F.posexplode(F.transform(lines_of(F.col(text)), line_key)).alias("pos", "key"),
    )
    return lines.where(F.char_length("key") >= least).select(
        F.xxhash64("key").alias("h"), F.xxhash64(F.lit("2"), "key").alias("h2"), "id", "rid", "pos"
    )


DROP, OPEN, REACHED = 0, 1, 2
FOUND = "kind int, h long, h2 long, id long, rid long, pos int"


class _Run:
    """The run of equal hashes that a sorted partition is in: its rows are held only until it has ``least`` documents."""

    def __init__(self, mark: tuple[int, int], first: bool) -> None:
        self.mark, self.first, self.docs, self.last, self.held, self.told = mark, first, 0, None, [], False


def scan_runs(least: int):
    """For mapInArrow over partitions sorted by (h, h2, id, rid, pos): the rows of runs with ``least`` documents.

    The first and the last run of a partition may go on in its neighbours. While such a run has too
    few documents here its rows come out as OPEN; once it has enough its rows come out as DROP, with
    one row REACHED for the neighbours.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: _Run | None = None
        begun = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            h, h2, ids, rid, pos = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            starts = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (h2[1:] != h2[:-1]))))
            ends = np.append(starts[1:], len(h))
            fresh = np.ones(len(h), dtype=np.int64)
            fresh[1:] = (ids[1:] != ids[:-1]) | (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])
            counts = np.add.reduceat(fresh, starts)
            kinds = np.full(len(h), -1, dtype=np.int32)
            out: list[tuple] = []
            inner = counts >= least
            for j in [0, *(np.flatnonzero(inner[1:-1]) + 1).tolist(), *([len(starts) - 1] if len(starts) > 1 else [])]:
                a, b = int(starts[j]), int(ends[j])
                mark = (int(h[a]), int(h2[a]))
                if 0 < j < len(starts) - 1:
                    kinds[a:b] = DROP
                    continue
                if run is None or run.mark != mark:
                    if run is not None and run.first:
                        out += [(OPEN, *r) for r in run.held]
                    run, begun = _Run(mark, begun == 0), begun + 1
                run.docs += int(counts[j]) - int(run.last == int(ids[a]))
                run.last = int(ids[b - 1])
                if run.docs >= least:
                    kinds[a:b] = DROP
                    out += [(DROP, *r) for r in run.held]
                    run.held = []
                    if not run.told:
                        out.append((REACHED, *run.mark, 0, 0, 0))
                        run.told = True
                else:
                    run.held += list(zip(*(x[a:b].tolist() for x in (h, h2, ids, rid, pos)), strict=True))
            keep = kinds >= 0
            if keep.any():
                yield _batch([kinds[keep], h[keep], h2[keep], ids[keep], rid[keep], pos[keep]])
            if out:
                yield _batch([np.array(x) for x in zip(*out, strict=True)])
        if run is not None and run.held:
            yield _batch([np.array(x) for x in zip(*[(OPEN, *r) for r in run.held], strict=True)])

    return scan


def _batch(columns: list[np.ndarray]) -> pa.RecordBatch:
    kinds = [pa.int32(), *[pa.int64()] * 4, pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=["kind", "h", "h2", "id", "rid", "pos"])


def repeated_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", min_docs: int = 10, least: int = 1, keep_first: bool = False) -> DataFrame:
    """(id, rid, pos) of the lines to drop: those whose key is found in ``min_docs`` documents or more.

    The occurrences are range-partitioned by (hash, document, position) and sorted; a line that
    stands in a third of all documents is thereby spread over many partitions, and each is read as a
    stream. Only rows of runs at the seams of partitions need a second look, and they are few. With
    ``keep_first`` the first occurrence by (document, position) stays.
    """
    order = ["h", "h2", "id", "rid", "pos"]
    found = cut(occurrences(docs, text, key, least), "occurrences")
    runs = found.repartitionByRange(lanes(docs.sparkSession), *order).sortWithinPartitions(*order)
    seen = cut(runs.mapInArrow(scan_runs(min_docs), FOUND), "runs")
    seams = seen.where(F.col("kind") != DROP)
    enough = (
        seams.groupBy("h", "h2")
        .agg(F.count_distinct(F.when(F.col("kind") == OPEN, F.col("id"))).alias("docs"), F.max("kind").alias("most"))
        .where((F.col("docs") >= min_docs) | (F.col("most") == REACHED))
    )
    late = seams.where(F.col("kind") == OPEN).join(enough, ["h", "h2"], "left_semi")
    drop = seen.where(F.col("kind") == DROP).select(*order).unionByName(late.select(*order))
    if keep_first:
        first = drop.groupBy("h", "h2").agg(F.min(F.struct("id", "rid", "pos")).alias("at")).select("h", "h2", "at.*")
        drop = drop.join(first, order, "left_anti")
    return drop.select("id", "rid", "pos")


def _bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for places in batch.column("places").to_pylist():
            bits = np.ones((max(places) // 8 + 1) * 8, dtype=np.uint8)
            bits[places] = 0
            maps.append(zlib.compress(np.packbits(bits).tobytes(), 6))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("rid"), pa.array(maps, type=pa.binary())], names=["id", "rid", "bitmap"])


def keep_bitmaps(docs: DataFrame, text: str = "text", key: str = "doc_id", min_docs: int = 10, least: int = 1, keep_first: bool = False) -> DataFrame:
    """(id, rid, bitmap) of the documents that lose lines: one bit for each line up to the last one that
    goes, 1 for those that stay, packed and deflated. Other documents keep all and have no row.
    ``id`` is as in ``document``, ``rid`` as in ``row_id``.
    """
    drop = repeated_lines(docs, text, key, min_docs, least, keep_first)
    return drop.groupBy("id", "rid").agg(F.collect_set("pos").alias("places")).mapInArrow(_bitmap, "id long, rid long, bitmap binary")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_lines, n_dropped, kept = [], [], []
        for text, bitmap in zip(batch.column("text"), batch.column("bitmap"), strict=True):
            text, bitmap = text.as_py() or "", bitmap.as_py()
            if bitmap is None:
                n_lines.append(text.count("\n") + 1)
                n_dropped.append(0)
                kept.append(text)
                continue
            lines = text.split("\n")
            bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8))[: len(lines)]
            gone = set(np.flatnonzero(bits == 0).tolist())
            n_lines.append(len(lines))
            n_dropped.append(len(gone))
            kept.append("\n".join(x for i, x in enumerate(lines) if i not in gone))
        sha = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in kept]
        arrays = [batch.column("key"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string()), pa.array(sha)]
        yield pa.RecordBatch.from_arrays(arrays, names=["key", "n_lines", "n_dropped", "kept", "sha"])


def without_repeated_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", min_docs: int = 10, least: int = 1, keep_first: bool = False) -> DataFrame:
    """Per row: the key, ``n_lines``, ``n_dropped``, ``kept_text``, ``kept_sha256``.

    The texts move once, to meet their bitmaps. Null and empty texts are one empty line, which with
    ``least`` of 1 or more always stays. Documents are told apart by key, rows with a null key
    by their texts; keys are integers. Rows repeated with key and text get the same result. An empty
    table gives an empty table; other columns are not read.
    """
    maps = keep_bitmaps(docs, text, key, min_docs, least, keep_first).withColumnRenamed("rid", "map_rid")
    rows = docs.select(integer_key(docs, key).alias("key"), document(docs, text, key).alias("row_key"), row_id(F.col(key), F.col(text)).alias("rid"), F.col(text).alias("text"))
    joined = rows.join(maps, (rows["row_key"] == maps["id"]) & (rows["rid"] == maps["map_rid"]), "left").select("key", "text", "bitmap")
    done = joined.mapInArrow(_apply, "key long, n_lines long, n_dropped long, kept string, sha string")
    return done.select(F.col("key").alias(key), "n_lines", "n_dropped", F.col("kept").alias("kept_text"), F.col("sha").alias("kept_sha256"))

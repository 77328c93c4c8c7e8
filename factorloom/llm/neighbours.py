"""Approximate nearest neighbours by a permutation index."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import cut, discard, integer_key


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows divided by the power of two at their largest component: cosines stay as they are to the last digit, and no square overflows or vanishes."""
    _, power = np.frexp(np.abs(vectors).max(axis=1, keepdims=True))
    return np.ldexp(vectors, -power)


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """For each vector its ``length`` nearest pivots by cosine, nearest first."""
    vectors = scaled(vectors)
    norms = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    near = (vectors / norms) @ pivots.T
    return np.argsort(-near, axis=1, kind="stable")[:, :length].astype(np.int16)


def inverted_file(prefixes: np.ndarray, n_pivots: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pivot the vectors that have it in their prefix, and its place there."""
    rows, length = prefixes.shape
    flat = prefixes.ravel()
    order = np.argsort(flat, kind="stable")
    bounds = np.searchsorted(flat[order], np.arange(n_pivots + 1))
    who, place = order // length, (order % length).astype(np.int32)
    return [(who[a:b], place[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def candidates(query: np.ndarray, postings: list[tuple[np.ndarray, np.ndarray]], rows: int, wanted: int) -> np.ndarray:
    """The ``wanted`` rows nearest by footrule distance, and all that tie with the last.

    With prefixes of length k, where a missing pivot counts as place k, the distance is a constant
    less twice the sum of ``k - max(place in query, place in vector)`` over the pivots in both, so
    only the postings of the query's own pivots are read.
    """
    length = len(query)
    near = np.zeros(rows, dtype=np.int32)
    for at, pivot in enumerate(query.tolist()):
        who, place = postings[pivot]
        near[who] += length - np.maximum(place, at)
    if wanted >= rows:
        return np.arange(rows)
    least = np.partition(near, rows - wanted)[rows - wanted]
    return np.flatnonzero(near >= least)


def search(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5, n_pivots: int = 256, prefix: int = 64, share: float = 0.06, least: int = 256, block: int = 4096, query_block: int = 16384) -> DataFrame:
    """The ``k`` nearest by cosine of each row whose key is divisible by ``every``, among all other rows.

    The index is fitted on ``n_pivots`` vectors of each number of components, those with the smallest hashes
    of their keys: a bounded sample. Every vector is represented by its ``prefix`` nearest pivots in order. Vectors
    are dealt out to blocks by a hash of their row; a block posts its vectors in an inverted file by
    pivot, and each query reads the lists of its own pivots, ranks the block by footrule distance,
    and computes the exact cosine for the nearest ``share`` of the block (``least`` rows at least,
    and whatever ties with the last). Blocks of queries meet blocks of vectors; memory is bounded by
    the two block sizes. The best of each block are then ranked for each query.

    Columns: query_id, rank (from 1), vec_id, score (cosine of the original vectors in double
    precision); ties go to the smaller id. Vectors that are null, zero or hold null or non-finite
    components, or whose key is null, take no part. Vectors meet only those of as many components. Rows that share a
    key are rows of their own, as queries and as candidates. Fewer candidates give fewer rows; an
    empty table gives an empty table. Other columns are not read.
    """
    spark = vectors.sparkSession
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("query_row", "query_id", "row", "vec_id")] + [T.StructField("score", T.DoubleType())])
    rows = vectors.where(usable(F.col(vector)) & F.col(key).isNotNull()).select(F.monotonically_increasing_id().alias("row"), integer_key(vectors, key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = cut(rows.withColumn("dims", F.size("v")), "vectors")
    nth = F.row_number().over(Window.partitionBy("dims").orderBy(F.xxhash64("id"), "id", "row"))
    chosen = rows.withColumn("nth", nth).where(F.col("nth") <= n_pivots).select("dims", "nth", "v").toPandas().sort_values(["dims", "nth"])
    pivots = {}
    for dims, some in chosen.groupby("dims"):
        some = scaled(np.array(some["v"].tolist(), dtype=np.float64))
        pivots[int(dims)] = some / np.sqrt((some * some).sum(axis=1, keepdims=True))
    shared = spark.sparkContext.broadcast(pivots)

    def permute(batches):
        for batch in batches:
            sizes = batch.column("dims").to_numpy()
            for dims in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == dims))
                own = shared.value[dims]
                prefixes = nearest_pivots(_matrix(part.column("v"), dims), own, min(prefix, len(own)))
                packed = pa.array([p.tobytes() for p in prefixes], type=pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "id", "dims", "v")), packed], names=["row", "id", "dims", "v", "prefix"])

    index = cut(rows.mapInArrow(permute, "row long, id long, dims int, v array<double>, prefix binary"), "permutations")
    discard(rows)
    asked = index.where(F.pmod("id", F.lit(every)) == 0)
    n, n_asked = index.count(), asked.count()
    blocks, query_blocks = -(-n // block) or 1, -(-n_asked // query_block) or 1
    home = F.xxhash64("row")
    held = index.withColumn("b", F.pmod(home, F.lit(blocks)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    sent = asked.withColumn("q", F.pmod(home, F.lit(query_blocks)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            dims = int(left["dims"][0].as_py())
            own, ids, data = left["row"].to_numpy(), left["id"].to_numpy(), scaled(_matrix(left["v"], dims))
            norms = np.sqrt(np.einsum("ij,ij->i", data, data))
            count = len(shared.value[dims])
            length = min(prefix, count)
            prefixes = np.frombuffer(b"".join(left["prefix"].to_pylist()), dtype=np.int16).reshape(-1, length)
            postings = inverted_file(prefixes, count)
            wanted = max(least, int(share * len(ids)))
            queries = scaled(_matrix(right["v"], dims))
            asks = np.frombuffer(b"".join(right["prefix"].to_pylist()), dtype=np.int16).reshape(-1, length)
            for mine, qid, q, ask in zip(right["row"].to_pylist(), right["id"].to_pylist(), queries, asks, strict=True):
                near = candidates(ask, postings, len(ids), wanted + 1)
                near = near[own[near] != mine]
                score = np.einsum("ij,j->i", data[near], q) / (norms[near] * np.sqrt(np.einsum("i,i->", q, q)))
                best = np.lexsort((own[near], ids[near], -score))[:k]
                out.append((np.full(len(best), mine), np.full(len(best), qid), own[near][best], ids[near][best], score[best]))
        columns = [np.concatenate(c) if out else np.array([]) for c in (zip(*out, strict=True) if out else ([],) * 5)]
        return pa.table({f.name: pa.array(c, pa.float64() if f.name == "score" else pa.int64()) for f, c in zip(schema.fields, columns, strict=True)})

    found = held.groupBy("dims", "b", "q").cogroup(sent.groupBy("dims", "b", "q")).applyInArrow(meet, schema)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(ids: np.ndarray, data: np.ndarray, every: int = 50, k: int = 5) -> pd.DataFrame:
    """The exact answer, for tests and for measuring recall."""
    out = []
    norms = np.sqrt(np.einsum("ij,ij->i", data, data))
    for i in np.flatnonzero(ids % every == 0):
        other = ids != ids[i]
        score = np.einsum("ij,j->i", data[other], data[i]) / (norms[other] * norms[i])
        best = np.lexsort((ids[other], -score))[:k]
        out += [(int(ids[i]), r + 1, int(ids[other][b]), float(score[b])) for r, b in enumerate(best)]
    return pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])

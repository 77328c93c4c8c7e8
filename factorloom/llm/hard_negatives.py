"""Hard negatives by rotated one-bit codes with a certain interval for every inner product."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut, discard, integer_key, lanes

#: Each stage codes what the stages before left over; a stage leaves about 0.6 of the length.
STAGES = 4
#: Bits of a component of an anchor, each a plane of its own.
PLANES = 8
SEED = 20
#: Bytes of vectors in a block of rows, and anchors in a block of anchors.
BLOCK_BYTES, ANCHORS = 16_000_000, 16_384
#: Sums of products below this are exact in double precision.
EXACT = float(1 << 53)
LARGEST = np.iinfo(np.int64).max

CODED = "uid long, id long, label long, dims int, x binary, codes binary, along binary, rest binary, norm double"
POSITIVE = "anchor_uid long, anchor_id long, uid long, id long, score long"
NEGATIVE = "anchor_uid long, anchor_id long, positive_uid long, positive_id long, positive_score long, uid long, id long, score long"


def padded(dims: int) -> int:
    """Components of a rotated vector: a power of two, 64 at least."""
    return max(64, 1 << max(0, dims - 1).bit_length())


def rotate(x: np.ndarray, stage: int) -> np.ndarray:
    """A random rotation of each row: signs and a Walsh-Hadamard transform, twice."""
    rows, size = x.shape
    rng = np.random.default_rng([SEED, stage, size])
    for _ in range(2):
        x = x * rng.choice(np.array([-1.0, 1.0]), size)
        half = 1
        while half < size:
            pairs = x.reshape(rows, -1, 2, half)
            x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(rows, size)
            half *= 2
        x = x / np.sqrt(size)
    return x


def bits(x: np.ndarray) -> np.ndarray:
    """Rows of booleans as words of 64 bits."""
    return np.packbits(x, axis=-1, bitorder="little").view(np.uint64)


def widened(x: np.ndarray) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, padded(x.shape[1]) - x.shape[1])))


def code_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One-bit codes of each stage, the length of what is left along the code, and the length of what is left after it.

    With y what a stage has to code, rotated, its code is the signs of y, b = signs / sqrt(size) has
    length 1, and y = along * b + rest with the rest at right angles to b. The next stage codes the rest.
    """
    y = widened(x)
    codes, along, rest = [], [], []
    for stage in range(STAGES):
        y = rotate(y, stage)
        positive = y >= 0
        b = np.where(positive, 1.0, -1.0) / np.sqrt(y.shape[1])
        a = np.einsum("ij,ij->i", y, b)
        y = y - a[:, None] * b
        codes.append(bits(positive))
        along.append(a)
        rest.append(np.sqrt(np.einsum("ij,ij->i", y, y)))
    return np.stack(codes, axis=1), np.stack(along, axis=1), np.stack(rest, axis=1)


@dataclass
class Anchor:
    """A rotated anchor in each stage, its components as whole numbers in planes of bits: y = low + step * levels + error."""

    planes: np.ndarray
    weights: np.ndarray
    low: np.ndarray
    step: np.ndarray
    error: np.ndarray
    norm: float
    size: int


def anchors_of(x: np.ndarray) -> Iterator[Anchor]:
    y = widened(x)
    size = y.shape[1]
    norm = np.sqrt(np.einsum("ij,ij->i", y, y))
    planes, low, step, error = [], [], [], []
    for stage in range(STAGES):
        y = rotate(y, stage)
        least = y.min(axis=1)
        width = (y.max(axis=1) - least) / ((1 << PLANES) - 1)
        level = np.rint((y - least[:, None]) / np.where(width > 0, width, 1.0)[:, None])
        off = y - least[:, None] - level * width[:, None]
        level = np.nan_to_num(level, nan=0.0, posinf=0.0, neginf=0.0).astype(np.int64)
        planes.append(np.stack([bits((level >> k & 1).astype(bool)) for k in range(PLANES)], axis=1))
        low.append(least)
        step.append(width)
        error.append(np.sqrt(np.einsum("ij,ij->i", off, off)))
    for i in range(len(x)):
        own = np.stack([p[i] for p in planes])
        weights = (np.bitwise_count(own).sum(axis=2).astype(np.int64) << np.arange(PLANES)).sum(axis=1)
        yield Anchor(own, weights, *(np.array([v[i] for v in values]) for values in (low, step, error)), float(norm[i]), size)


class Block:
    """Rows of one number of components, in order of label."""

    def __init__(self, table: pa.Table) -> None:
        order = np.argsort(table["label"].to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        self.uid, self.label = table["uid"].to_numpy(), table["label"].to_numpy()
        ids = table["id"].combine_chunks()
        self.no_id = np.asarray(ids.is_null())
        self.id = np.asarray(ids.fill_null(LARGEST))
        rows, self.dims = table.num_rows, int(table["dims"][0].as_py())
        self.x = np.frombuffer(b"".join(table["x"].to_pylist()), dtype="<f8").reshape(rows, self.dims)
        self.codes = np.frombuffer(b"".join(table["codes"].to_pylist()), dtype="<u8").reshape(rows, STAGES, -1)
        self.along = np.frombuffer(b"".join(table["along"].to_pylist()), dtype="<f8").reshape(rows, STAGES)
        self.rest = np.frombuffer(b"".join(table["rest"].to_pylist()), dtype="<f8").reshape(rows, STAGES)
        self.norm = table["norm"].to_numpy()
        self.ones = np.bitwise_count(self.codes).sum(axis=2).astype(np.int64)

    def of_label(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.label, label, side="left")), int(np.searchsorted(self.label, label, side="right"))

    def refine(self, anchor: Anchor, rows: np.ndarray, stage: int, middle: np.ndarray, slack: np.ndarray) -> tuple[np.ndarray, ...]:
        """Estimates with one stage more, and the ends of the certain interval: (middle, slack, least, most).

        The inner product is the sum over stages of along * <y, b> and of <anchor, rest>. By popcounts
        <y, b> is known up to the anchor's rounding error, which meets b of length 1; the rest is at
        right angles to the last b, so Cauchy-Schwarz bounds its product by the lengths of the rest and of
        the part of the anchor at right angles to b. An interval that is not a number spans everything.
        """
        codes = self.codes[rows, stage]
        level = np.zeros(len(rows), dtype=np.int64)
        for k in range(PLANES):
            level += np.bitwise_count(codes & anchor.planes[stage, k]).sum(axis=1).astype(np.int64) << k
        signs = anchor.low[stage] * (2 * self.ones[rows, stage] - anchor.size) + anchor.step[stage] * (2 * level - anchor.weights[stage])
        onto = signs / np.sqrt(anchor.size)
        along, error = self.along[rows, stage], anchor.error[stage]
        middle = middle + along * onto
        slack = slack + along * error
        aside = np.sqrt(np.maximum(anchor.norm**2 - np.maximum(np.abs(onto) - error, 0.0) ** 2, 0.0))
        half = slack + aside * self.rest[rows, stage] + 1e-9 * anchor.norm * self.norm[rows] + 1e-6
        least, most = middle - half, middle + half
        return middle, slack, np.where(np.isnan(least), -np.inf, least), np.where(np.isnan(most), np.inf, most)

    def exact(self, q: np.ndarray, norm: float, rows: np.ndarray) -> np.ndarray:
        """Whole inner products; those beyond a long become its ends."""
        if len(rows) == 0 or norm * float(self.norm[rows].max()) < EXACT:
            return (self.x[rows] @ q).astype(np.int64)
        mine = [int(v) for v in q.tolist()]
        sums = (sum(int(a) * b for a, b in zip(r, mine, strict=True)) for r in self.x[rows].tolist())
        return np.array([max(-LARGEST, min(LARGEST, s)) for s in sums], dtype=np.int64)

    def first(self, rows: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
        """Places of the ``k`` of highest score, ties by smaller id."""
        return np.lexsort((self.id[rows], -score))[:k]


def kth_largest(x: np.ndarray, k: int) -> float:
    return float(np.partition(x, len(x) - k)[len(x) - k]) if len(x) >= k else -np.inf


def nearest_of_label(block: Block, anchor: Anchor, q: np.ndarray, uid: int, label: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of the ``k`` first of the anchor's label, without the anchor."""
    rows = np.arange(*block.of_label(label))
    rows = rows[block.uid[rows] != uid]
    middle = slack = np.zeros(len(rows))
    for stage in range(STAGES):
        if len(rows) <= k:
            break
        middle, slack, least, most = block.refine(anchor, rows, stage, middle, slack)
        on = most >= kth_largest(least, k)
        rows, middle, slack = rows[on], middle[on], slack[on]
    score = block.exact(q, anchor.norm, rows)
    best = block.first(rows, score, k)
    return rows[best], score[best]


def in_bands(block: Block, anchor: Anchor, q: np.ndarray, label: int, bands: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each band (least, most score) the ``k`` first rows of other labels inside it.

    A row stays while its interval meets some band and ends above the k-th highest lower end among the
    intervals that lie wholly in that band.
    """
    a, b = block.of_label(label)
    rows = np.concatenate((np.arange(a), np.arange(b, len(block.label))))
    middle = slack = np.zeros(len(rows))
    for stage in range(STAGES):
        if len(rows) <= k:
            break
        middle, slack, least, most = block.refine(anchor, rows, stage, middle, slack)
        on = np.zeros(len(rows), dtype=bool)
        for low, high in bands:
            certain = least[(least >= low) & (most <= high)]
            on |= (most >= max(low, kth_largest(certain, k))) & (least <= high)
        rows, middle, slack = rows[on], middle[on], slack[on]
    score = block.exact(q, anchor.norm, rows)
    found = []
    for low, high in bands:
        inside = np.flatnonzero((score >= low) & (score <= high))
        best = inside[block.first(rows[inside], score[inside], k)]
        found.append((rows[best], score[best]))
    return found


def _code(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            sizes = np.asarray(v.value_lengths())
            for dims in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == dims))
                with np.errstate(all="ignore"):
                    x = np.floor(scale * part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, dims))
                    finite = np.isfinite(x).all(axis=1)
                    part, x = part.filter(pa.array(finite)), x[finite]
                    codes, along, rest = code_rows(x)
                    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
                pack = lambda a: pa.array([r.tobytes() for r in a], type=pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column("uid"), part.column("id"), part.column("label"), pa.array(np.full(len(x), dims, np.int32)), pack(x), pack(codes), pack(along), pack(rest), pa.array(norm)],
                    names=[c.split()[0] for c in CODED.split(", ")],
                )

    return run


def _ids(block: Block, rows: np.ndarray) -> pa.Array:
    return pa.array(block.id[rows], mask=block.no_id[rows])


def _long(values: list) -> pa.Array:
    return pa.array(values, type=pa.int64())


def _vectors(table: pa.Table, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(table["x"].to_pylist()), dtype="<f8").reshape(table.num_rows, dims)


def _positives(k: int):
    def run(held: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if held.num_rows and asked.num_rows:
            with np.errstate(all="ignore"):
                block = Block(held)
                x = _vectors(asked, block.dims)
                for anchor, q, uid, key, label in zip(anchors_of(x), x, *(asked[c].to_pylist() for c in ("uid", "id", "label")), strict=True):
                    rows, score = nearest_of_label(block, anchor, q, uid, label, k)
                    out.append(pa.table([_long([uid] * len(rows)), _long([key] * len(rows)), pa.array(block.uid[rows]), _ids(block, rows), pa.array(score)], names=["anchor_uid", "anchor_id", "uid", "id", "score"]))
        return pa.concat_tables(out) if out else pa.schema([(c.split()[0], pa.int64()) for c in POSITIVE.split(", ")]).empty_table()

    return run


def _negatives(k: int, low: int, high: int):
    def run(held: pa.Table, asked: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in NEGATIVE.split(", ")]
        out = []
        if held.num_rows and asked.num_rows:
            with np.errstate(all="ignore"):
                block = Block(held)
                x = _vectors(asked, block.dims)
                for anchor, q, uid, key, label, near in zip(anchors_of(x), x, *(asked[c].to_pylist() for c in ("uid", "id", "label", "near")), strict=True):
                    # 100 * score lies between low and high times the positive's score
                    bands = [(-(-low * p["score"] // 100), high * p["score"] // 100) for p in near]
                    for p, (rows, score) in zip(near, in_bands(block, anchor, q, label, bands, k), strict=True):
                        same = [[v] * len(rows) for v in (uid, key, p["uid"], p["id"], p["score"])]
                        out.append(pa.table([*map(_long, same), pa.array(block.uid[rows]), _ids(block, rows), pa.array(score)], names=names))
        return pa.concat_tables(out) if out else pa.schema([(c, pa.int64()) for c in names]).empty_table()

    return run


def usable(vector: Column) -> Column:
    """Not null, and no component null or non-finite."""
    v = vector.cast("array<double>")
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))), F.lit(False))


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = 100, scale: float = 256.0, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90
) -> DataFrame:
    """Hard negatives of each anchor (a row whose key ``every`` divides) and each of its positives.

    Components become floor(scale * x); a row's score is its integer inner product with the anchor, and
    rows come by higher score, ties by smaller key. An anchor's positives are its first ``positives``
    other rows of its label. Of the rows of other labels whose score is between ``low`` and ``high``
    hundredths of the positive's, the first ``negatives`` are returned: anchor_id, positive_id, rank
    (from 1), negative_id, positive_score, negative_score.

    Each row is coded once: rotated, its signs are its code, and its length along the code and the length
    of the rest are stored; ``STAGES`` codes follow one another, each of what the ones before left. An
    anchor's components are rounded to planes of bits. Popcounts estimate the inner product stage by
    stage with an interval that is certain (rounding error and Cauchy-Schwarz on the rest). Rows whose
    interval cannot be among the first are left out, all others are scored exactly: the result
    is that of scoring all. All rows, in blocks by a hash of the row and whatever its label, meet all
    anchors, in blocks: the work grows with rows times anchors, memory is bounded by the two blocks.

    Rows with a null label, a null vector, or a null or non-finite component (also after scaling) take no part. Rows
    meet only rows of as many components. Rows that repeat a key are rows of their own, as anchors too; rows
    with a null key are never anchors and come last in ties. Scores beyond a long count as its ends. Fewer
    rows give fewer results; an empty table gives an empty table. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.where(usable(F.col(vector)) & F.col(label).isNotNull()).select(
        F.monotonically_increasing_id().alias("uid"), integer_key(vectors, key).alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v")
    )
    coded = cut(rows.mapInArrow(_code(scale), CODED), "coded")
    # read anew: the two sides of a cogroup must not share columns
    columns = ["uid", "id", "label", "dims", "x"]
    asked = spark.read.schema(coded.schema).parquet(coded.cut_path).where(F.col("id") % every == 0).select(*columns)
    size = coded.agg(F.count(F.lit(1)).alias("n"), F.max("dims").alias("dims")).first()
    n_asked = asked.count()
    fit = max(1024, BLOCK_BYTES // (8 * max(1, size["dims"] or 0)))
    blocks = max(-(-size["n"] // fit), min(lanes(spark), -(-size["n"] // 1024)), 1)
    parts = -(-n_asked // ANCHORS) or 1
    home = F.xxhash64("uid")
    held = coded.withColumn("b", F.pmod(home, F.lit(blocks)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def sent(anchors: DataFrame) -> DataFrame:
        dealt = anchors.withColumn("q", F.pmod(home, F.lit(parts)).cast("int"))
        return dealt.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).groupBy("dims", "b", "q")

    by = ["dims", "b", "q"]
    near = held.groupBy(*by).cogroup(sent(asked)).applyInArrow(_positives(positives), POSITIVE)
    near = _first(near, ["anchor_uid"], positives)
    near = cut(near.groupBy("anchor_uid").agg(F.collect_list(F.struct("uid", "id", "score")).alias("near")), "positives")
    wanting = asked.join(near, asked["uid"] == near["anchor_uid"]).drop("anchor_uid")
    found = held.groupBy(*by).cogroup(sent(wanting)).applyInArrow(_negatives(negatives, low, high), NEGATIVE)
    found = cut(_first(found, ["anchor_uid", "positive_uid"], negatives), "negatives")
    discard(coded)
    discard(near)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

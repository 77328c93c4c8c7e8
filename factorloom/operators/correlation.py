"""Rank correlations of many names over many keys, with ranks taken anew for every pair of names.

A pair is ranked over the keys that have both. Nothing is joined pair by pair: the values of each name are
sorted once, and walking up them, how many keys so far also have each other name gives the ranks in
all pairs at once. Products of ranks are then summed key by key in square blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import rounded
from ..functions.store import stored

#: Numbers in the blocks of ranks that a task holds at once.
BLOCK = 2_000_000
#: Names are columns of those blocks; beyond so many this is the wrong operator.
MOST_NAMES = 1024
#: What a row of a range is: inside, in its first run of equal values, in its last; sums of a range and of those runs.
INNER, FIRST, LAST, WHOLE, FIRST_RUN, LAST_RUN = range(6)


def _ranges(width: int, other: list[list[int]]):
    """For mapInArrow over ranges sorted by (grp, name, value): each row's place among the rows of the range.

    ``other[name]``: the names that the rows of a name are counted with, as columns. Per row, twice the
    rows below and those of its own value, counted with each column. The first and the last value of a
    name's part of a range may go on in other ranges, so their rows wait for the sums of those runs.
    """

    def segment(part: int, rid: np.ndarray, grp: int, name: int, value: np.ndarray, masks: np.ndarray) -> pa.RecordBatch:
        has = masks[:, other[name]].astype(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
        sizes = np.add.reduceat(has, starts, axis=0)
        run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(value))))
        below = np.cumsum(sizes, axis=0) - sizes
        place = (2 * below + sizes)[run]
        kind = np.where(run == 0, FIRST, np.where(run == len(starts) - 1, LAST, INNER))
        n = len(rid) + 3
        sums = np.stack((sizes.sum(axis=0), sizes[0], sizes[-1]))
        vectors = np.concatenate((place, sums))
        ends = np.array([np.nan, value[0], value[-1]])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate((rid, [-1, -1, -1]))), pa.array(np.full(n, part)), pa.array(np.full(n, grp)), pa.array(np.full(n, name, np.int32)),
                pa.array(np.concatenate((kind, [WHOLE, FIRST_RUN, LAST_RUN])).astype(np.int32)), pa.array(np.concatenate((np.full(len(rid), np.nan), ends))), pa.array([v.tobytes() for v in vectors], type=pa.binary()),
            ],
            names=["rid", "part", "grp", "name", "kind", "value", "place"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: list[tuple] = []
        mark = None

        def flush() -> pa.RecordBatch:
            rid, value, masks = (np.concatenate(x) for x in zip(*held, strict=True))
            return segment(part, rid, *mark, value, masks)

        for batch in batches:
            if not batch.num_rows:
                continue
            rid, grp, name, value = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rid", "grp", "name", "value"))
            masks = np.frombuffer(b"".join(batch.column("mask").to_pylist()), dtype=np.uint8).reshape(batch.num_rows, width)
            starts = np.flatnonzero(np.concatenate(([True], (grp[1:] != grp[:-1]) | (name[1:] != name[:-1])))).tolist()
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                if held and mark != (int(grp[a]), int(name[a])):
                    yield flush()
                    held = []
                mark = (int(grp[a]), int(name[a]))
                held.append((rid[a:b], value[a:b], masks[a:b]))
        if held:
            yield flush()

    return run


class Offsets:
    """What the ranges before a range add to the places of its rows, and the places of runs that ranges share."""

    def __init__(self, sums: list) -> None:
        parts: dict[tuple, dict] = {}
        for r in sums:
            parts.setdefault((r["grp"], r["name"], r["part"]), {})[r["kind"]] = (np.frombuffer(r["place"], dtype=np.int64), r["value"])
        self.before: dict[tuple, np.ndarray] = {}
        self.runs: dict[tuple, np.ndarray] = {}
        self.totals: dict[tuple, np.ndarray] = {}
        by_name: dict[tuple, list] = {}
        for grp, name, part in sorted(parts):
            by_name.setdefault((grp, name), []).append(part)
        for key, held in by_name.items():
            total = np.zeros_like(parts[*key, held[0]][WHOLE][0])
            ties: dict[float, np.ndarray] = {}
            begun: dict[float, np.ndarray] = {}
            for part in held:
                one = parts[*key, part]
                first, last = one[FIRST_RUN], one[LAST_RUN]
                self.before[*key, part] = total
                begun.setdefault(first[1], total)
                ties[first[1]] = ties.get(first[1], 0) + first[0]
                if last[1] != first[1]:
                    begun[last[1]] = total + one[WHOLE][0] - last[0]
                    ties[last[1]] = ties.get(last[1], 0) + last[0]
                total = total + one[WHOLE][0]
            self.totals[key] = total
            for part in held:
                for kind, at in ((FIRST, FIRST_RUN), (LAST, LAST_RUN)):
                    v = parts[*key, part][at][1]
                    self.runs[*key, part, kind] = 2 * begun[v] + ties[v]

    def __call__(self, grp: int, name: int, part: int, kind: int, place: np.ndarray) -> np.ndarray:
        """Twice the mean place, less twice the middle of all: ranks around zero, in whole numbers."""
        found = place + 2 * self.before[grp, name, part] if kind == INNER else self.runs[grp, name, part, kind]
        return found - self.totals[grp, name]


def _products(names: int, other: list[list[int]], offsets, groups: int):
    """For mapInArrow over rows sorted by rid: sums of products of the two ranks of every pair."""
    where = [np.array(o, dtype=np.int64) for o in other]
    size = max(1, BLOCK // max(1, names * names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = offsets.value
        xy, xx = np.zeros((groups, names, names)), np.zeros((groups, names, names))

        def add(rows: pa.Table) -> None:
            """Rows of whole keys: their ranks as squares, some keys at a time."""
            rid, grp, name, part, kind = (rows[c].to_numpy() for c in ("rid", "grp", "name", "part", "kind"))
            places = rows["place"].to_pylist()
            slot = np.cumsum(np.concatenate(([0], rid[1:] != rid[:-1])))
            starts = np.searchsorted(slot, np.arange(0, slot[-1] + 1, size)).tolist()
            for i, j in zip(starts, [*starts[1:], len(rid)], strict=True):
                line = slot[i:j] - slot[i]
                block, has = np.zeros((line[-1] + 1, names, names)), np.zeros((line[-1] + 1, names), dtype=bool)
                has[line, name[i:j]] = True
                keys, of = np.unique(np.stack((grp[i:j], name[i:j], part[i:j], kind[i:j])), axis=1, return_inverse=True)
                order = np.argsort(of, kind="stable")
                bounds = np.searchsorted(of[order], np.arange(keys.shape[1] + 1)).tolist()
                for k, (g, n, p, e) in enumerate(keys.T.tolist()):
                    mine = order[bounds[k] : bounds[k + 1]]
                    place = np.frombuffer(b"".join([places[i + m] for m in mine.tolist()]), dtype=np.int64).reshape(len(mine), -1)
                    block[line[mine][:, None], n, where[n]] = at(g, n, p, e, place)
                block *= has[:, None, :]  # ranks count only where the other name is there
                of_key = grp[i:j][np.searchsorted(line, np.arange(line[-1] + 1))]
                for g in np.unique(of_key).tolist():
                    own = block[of_key == g]
                    xy[g] += np.einsum("kab,kba->ab", own, own)
                    xx[g] += np.einsum("kab,kab->ab", own, own)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rid = batch.column("rid").to_numpy()
            whole = int(np.searchsorted(rid, rid[-1]))  # the last key may go on in the next batch
            if whole or (held and held[-1].column("rid")[-1].as_py() != int(rid[0])):
                add(pa.Table.from_batches([*held, batch.slice(0, whole)]))
                held = []
            held.append(batch.slice(whole))
        if held:
            add(pa.Table.from_batches(held))
        g, a, b = np.nonzero(xx)
        keep = a < b
        g, a, b = g[keep], a[keep], b[keep]
        yield pa.RecordBatch.from_arrays(
            [pa.array(g), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(xy[g, a, b]), pa.array(xx[g, a, b]), pa.array(xx[g, b, a])], names=["grp", "a", "b", "xy", "xx", "yy"]
        )

    return run


def spearman(tall: DataFrame, key: str = "ticker", name: str = "name", value: str = "value", by: Sequence[str] = (), against: str | None = None, digits: int = 3, names: Sequence[str] | None = None) -> DataFrame:
    """(by, a, b, rho, n): rank correlation of every two names, over the keys of a group of ``by`` that have both.

    ``tall`` has a row for each key and name, once each; rows without value, or not a number, are left out. Ties take their mean
    rank. rho is null where one side of a pair is constant. ``against``: only pairs with this name, which comes as
    ``b``. ``names`` spares the search for them where they are known. Names (``MOST_NAMES`` at most) and groups are few: a
    task keeps one square of sums for each group. Equal values that fill several ranges are no single task's work.
    """
    spark = tall.sparkSession
    rows = tall.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*by, F.col(key).alias("_key"), F.col(name).alias("_name"), F.col(value).cast("double").alias("_value"))
    if by or names is None:
        rows = stored(rows, "tall")
    if names is None:
        names = [r[0] for r in rows.select("_name").distinct().limit(MOST_NAMES + 1).collect()]
    names = sorted(names)
    if len(names) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names")
    number = Window.partitionBy(F.lit(0)).orderBy(*by) if by else None  # one row for each group
    groups = rows.select(*by).distinct().withColumn("grp", F.row_number().over(number) - 1) if by else None
    n_groups = groups.count() if by else 1
    index = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "_name string, name int")
    numbered = rows.join(F.broadcast(index), "_name")
    if by:
        groups = stored(groups, "groups")
        shared = F.broadcast(groups) if n_groups <= 100_000 else groups
        same = [rows[c].eqNullSafe(groups[c]) for c in by]
        numbered = numbered.join(shared, same).select("_key", "grp", "name", "_value")
    else:
        numbered = numbered.select("_key", F.lit(0).alias("grp"), "name", "_value")
    cells = numbered.groupBy("grp", "_key").agg(F.collect_list(F.struct("name", F.col("_value").alias("value"))).alias("cells")).withColumn("rid", F.monotonically_increasing_id())
    cells = stored(cells.select("rid", F.col("grp").cast("long").alias("grp"), "cells"), "cells")
    last = names.index(against) if against in names else None
    if against is None:
        other = [[j for j in range(len(names)) if j != i] for i in range(len(names))]
    else:
        other = [[] if last is None else [j for j in range(len(names)) if j != i] if i == last else [last] for i in range(len(names))]
    width = len(names)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("cells")
            sizes = np.asarray(held.value_lengths())
            flat = held.flatten()
            name_, value_ = flat.field("name").to_numpy(zero_copy_only=False), flat.field("value").to_numpy(zero_copy_only=False)
            line = np.repeat(np.arange(batch.num_rows), sizes)
            masks = np.zeros((batch.num_rows, width), dtype=np.uint8)
            masks[line, name_] = 1
            packed = pa.array([m.tobytes() for m in masks], type=pa.binary())
            take = pa.array(line)
            yield pa.RecordBatch.from_arrays([batch.column("rid").take(take), batch.column("grp").take(take), pa.array(name_), pa.array(value_), packed.take(take)], names=["rid", "grp", "name", "value", "mask"])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["grp", "name", "value"]
    ranged = cells.mapInArrow(spread, "rid long, grp long, name int, value double, mask binary").repartitionByRange(tasks, *order, F.xxhash64("rid")).sortWithinPartitions(*order)
    placed = stored(ranged.mapInArrow(_ranges(width, other), "rid long, part long, grp long, name int, kind int, value double, place binary"), "places")
    # a few rows for each range, group and name
    sums = placed.where(F.col("kind") >= WHOLE).select("grp", "name", "part", "kind", "value", "place").collect()
    at = Offsets(sums)
    met = placed.where(F.col("kind") < WHOLE).select("rid", "grp", "name", "part", "kind", "place").repartition(tasks, "rid").sortWithinPartitions("rid")
    parts = met.mapInArrow(_products(width, other, spark.sparkContext.broadcast(at), n_groups), "grp long, a int, b int, xy double, xx double, yy double")
    total = parts.groupBy("grp", "a", "b").agg(*[F.sum(c).alias(c) for c in ("xy", "xx", "yy")])
    counts = [(int(g), i, j, int(c)) for (g, i), total_ in at.totals.items() for j, c in zip(other[i], total_.tolist(), strict=True) if i < j and c]
    n = spark.createDataFrame(counts, "grp long, a int, b int, n long")
    out = n.join(total, ["grp", "a", "b"], "left").withColumn("rho", F.when((F.col("xx") > 0) & (F.col("yy") > 0), rounded(F.col("xy") / F.sqrt(F.col("xx")) / F.sqrt(F.col("yy")), digits)))
    label = lambda c: index.select(F.col("name").alias(c), F.col("_name").alias(f"{c}_name"))
    out = out.join(F.broadcast(label("a")), "a").join(F.broadcast(label("b")), "b")
    if against is not None:
        out = out.withColumn("a_name", F.when(F.col("a") == last, F.col("b_name")).otherwise(F.col("a_name"))).withColumn("b_name", F.lit(against))
    if by:
        out = out.join(groups, "grp")
    return out.select(*by, F.col("a_name").alias("a"), F.col("b_name").alias("b"), "rho", "n")

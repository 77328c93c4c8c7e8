"""Securities whose scores change by month only through a series that they follow: a row for each security, with an array over the months.

What stands still is ordered or counted once. Values of all months of a security are worked out together in Arrow, and no row is made for a security and a month.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.ranks import numbered, placed, quantiles
from ..functions.stats import rounded
from ..functions.store import stored
from .backtest import CELLS, PIECE_ROWS, MonthParts, factors_of

#: Cells lie between -1000 and 1000 points; what lies beyond is in the first or the last.
LOW, SPAN = -1000 * CELLS, 2000 * CELLS + 1


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """Null is NaN."""
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.float64)


def matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A row for each array; they are of one length."""
    flat = batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(batch.num_rows, -1)


def lists(values: np.ndarray) -> pa.ListArray:
    n, wide = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * wide, pa.int32()), pa.array(values.ravel()))


def round_at(x: np.ndarray, digits: int) -> np.ndarray:
    """As ``stats.rounded``."""
    return np.rint(x * float(10**digits)) / float(10**digits)


def cells(values: np.ndarray) -> np.ndarray:
    """As ``backtest.cell_of``; NaN has one too."""
    return np.floor(np.clip(np.nan_to_num(values), -1000.0, 1000.0) * CELLS).astype(np.int64)


def met(parts: MonthParts, carried: Sequence[str], month: str = "as_of", group: str = "earner") -> DataFrame:
    """Securities with arrays, over the months in order, of the percentiles of their series in their sector (``pct_<metric>``) and of its columns ``carried``."""
    pcts = [f"pct_{m}" for m in parts.moving]
    one = parts.series.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(month, *carried, *pcts))).alias("at"))  # a series has a row in every month
    one = one.withColumn("nth", F.explode(F.array(*[F.lit(i) for i in range(len(parts.sectors))])) if parts.sectors else F.lit(0))
    of_sector = lambda c: F.transform("at", lambda x: F.get(x[c], F.col("nth"))).alias(c)
    plain = lambda c: F.transform("at", lambda x: x[c]).alias(c)
    one = one.select(group, "nth", *[of_sector(c) for c in pcts], *[plain(c) for c in carried])
    return parts.base.hint("merge").join(one.hint("merge"), [group, "nth"])


def category_by_month(batch: pa.RecordBatch, category: str, moving: Mapping) -> np.ndarray:
    """The score of a category that changes, as in ``monthly_scores``; NaN where there is none."""
    p, w = column(batch, f"p_{category}")[:, None], column(batch, f"w_{category}")[:, None]
    for m, d in moving.items():
        if d["category"] == category:
            pct, own = matrix(batch, f"pct_{m}"), column(batch, f"own_{m}")[:, None]
            there = ~np.isnan(pct)
            p, w = p + np.where(there, own * pct, 0.0), w + np.where(there, own, 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return round_at(np.where(w > 0, p / w, np.nan), 9)


def tallied(rows: DataFrame, columns: Sequence[str], slots_of: Callable, n_slots: int) -> np.ndarray:
    """How many of the values that ``slots_of`` a batch says (values, slots, each a row for each security; NaN does not count) lie in each cell of each slot."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(n_slots * SPAN, dtype=np.int64)
        for batch in batches:
            values = slots_of(batch)
            key = np.arange(n_slots) * SPAN + cells(values) - LOW
            np.add.at(held, *np.unique(key[~np.isnan(values)], return_counts=True))
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["key", "n"])

    found = rows.select(*columns).mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()  # cells and slots
    out = np.zeros(n_slots * SPAN, dtype=np.int64)
    out[found["key"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(n_slots, SPAN)


def quantile_by_slot(rows: DataFrame, columns: Sequence[str], slots_of: Callable, n_slots: int, q: float) -> np.ndarray:
    """Exact quantiles, linear between neighbours, of each slot's values; NaN where it has none. Only values of the cells that hold the neighbours are put in order."""
    counts = tallied(rows, columns, slots_of, n_slots)
    upto = np.cumsum(counts, axis=1)
    total = upto[:, -1]
    h = (total - 1) * q
    wanted = np.zeros((n_slots, SPAN), dtype=bool)
    before = np.zeros(n_slots, dtype=np.int64)  # values in cells before the first that is wanted
    for s in np.flatnonzero(total):
        ends = [int(np.searchsorted(upto[s], x(h[s]), side="right")) for x in (np.floor, np.ceil)]
        wanted[s, ends[0] : ends[1] + 1] = True
        before[s] = upto[s, ends[0]] - counts[s, ends[0]]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = slots_of(batch)
            row, slot = np.nonzero(wanted[np.arange(n_slots), cells(values) - LOW] & ~np.isnan(values))
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(values[row, slot])], names=["slot", "value"])

    near = rows.select(*columns).mapInArrow(pick, "slot int, value double").groupBy("slot", "value").agg(F.count(F.lit(1)).alias("n"))
    spark = rows.sparkSession
    whole = spark.createDataFrame([(int(s), int(before[s]), int(total[s])) for s in range(n_slots)], "slot int, before long, all long")
    at = placed(near, ["slot"]).join(F.broadcast(whole), "slot").withColumns({"below": F.col("below") + F.col("before"), "total": F.col("all")})
    out = np.full(n_slots, np.nan)
    for r in quantiles(at, {"q": q}, ["slot"]).collect():  # a row for each slot
        out[r["slot"]] = r["q"]
    return out


def last_of_top(rows: DataFrame, columns: Sequence[str], value: str, key: str, held_by: Callable, n_slots: int, most: int) -> list[tuple[float, str] | None]:
    """Of each slot's rows in falling order of ``value``, ties by ``key``: value and key of row ``most``; none where there are no more rows.

    ``held_by`` says of a batch which slots a row is in. Only rows of the cell of ``value`` that holds the last one are put in order.
    """
    valued = lambda batch: np.where(held_by(batch), column(batch, value)[:, None], np.nan)
    counts = tallied(rows, columns, valued, n_slots)
    down = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]  # rows in a cell and those above
    short = down[:, 0] <= most
    cell = np.where(short, -1, SPAN - 1 - np.argmax(down[:, ::-1] >= most, axis=1))
    local = {s: int(most - (down[s, cell[s]] - counts[s, cell[s]])) for s in np.flatnonzero(~short).tolist()}

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = column(batch, value)
            row, slot = np.nonzero(held_by(batch) & (cells(values)[:, None] - LOW == cell))
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(-values[row]), batch.column(key).take(pa.array(row))], names=["slot", "falling", "key"])

    out: list = [None] * n_slots
    if local:
        near = rows.select(*columns).mapInArrow(pick, "slot int, falling double, key string")
        spark = rows.sparkSession
        nth = F.broadcast(spark.createDataFrame(list(local.items()), "slot int, nth long"))
        for r in numbered(near, ["slot"], ["falling", "key"]).join(nth, ["slot", "nth"]).collect():  # a row for each slot
            out[r["slot"]] = (-r["falling"], r["key"])
    return out


PORTFOLIOS = ("value", "value_quality", "value_quality_momentum")


def value_trap_by_month(parts: MonthParts, q: float = 0.3, least: int = 20, share: int = 5, digits: int = 6, month: str = "as_of", group: str = "earner") -> DataFrame:
    """``backtest.value_trap_compare`` on scores that are rounded at ``digits``, where value and quality stand still and momentum and the return ``fwd`` follow a series.

    The first two portfolios hold the same names in every month.
    """
    spark, moving, months = parts.base.sparkSession, parts.moving, parts.months
    schema = f"{month} {dict(parts.series.dtypes)[month]}, portfolio string, n long, ret double"
    none = spark.createDataFrame([], schema)
    scores = [rounded(F.col(f"{a}_score"), digits).alias(b) for a, b in (("valuation", "value"), ("quality", "quality"))]
    used = [*[f"own_{m}" for m in moving], *[f"pct_{m}" for m in moving], "p_momentum", "w_momentum"]
    wide = met(parts, ["fwd"], month, group).where("valuation_score is not null").select("ticker", *scores, "fwd", *used)

    def with_momentum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            momentum = round_at(category_by_month(batch, "momentum", moving), digits)
            # null in place of NaN would cost as much, and return to NaN
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("ticker", "value", "quality", "fwd")], lists(momentum)], names=["ticker", "value", "quality", "fwd", "momentum"])

    schema_of = StructType([*wide.select("ticker", "value", "quality", "fwd").schema.fields, *StructType.fromDDL("momentum array<double>").fields])
    rows = stored(wide.mapInArrow(with_momentum, schema_of), "names-by-month")
    total = rows.count()
    if total < least or not months:
        return none
    most, n_months = max(1, total // share), len(months)
    both = lambda batch: np.concatenate([column(batch, "quality")[:, None], matrix(batch, "momentum")], axis=1)
    limits = quantile_by_slot(rows, ["quality", "momentum"], both, 1 + n_months, q)

    def held_by(batch: pa.RecordBatch) -> np.ndarray:
        """All names, those of quality, and of them those of momentum in each month."""
        high = both(batch) >= limits  # not where either is NaN
        return np.concatenate([np.ones((len(high), 1), dtype=bool), high[:, :1], high[:, :1] & high[:, 1:]], axis=1)

    last = last_of_top(rows, ["ticker", "value", "quality", "momentum"], "value", "ticker", held_by, 2 + n_months, most)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, 3, n_months))  # by portfolio: names, those with a return, and its sum
        for batch in batches:
            mine, value = held_by(batch), column(batch, "value")
            for s, cut in enumerate(last):
                if cut is not None:
                    mine[:, s] &= value >= cut[0]
                    tie = np.flatnonzero(mine[:, s] & (value == cut[0]))
                    if len(tie):
                        mine[tie, s] = pc.less_equal(batch.column("ticker").take(pa.array(tie)), pa.scalar(cut[1])).to_numpy(zero_copy_only=False)
            fwd = matrix(batch, "fwd")
            there = ~np.isnan(fwd)
            for k in range(3):
                of = mine[:, k : k + 1] if k < 2 else mine[:, 2:]
                held[k, 0] += of.sum(axis=0)
                held[k, 1] += (of & there).sum(axis=0)
                held[k, 2] += np.where(of & there, fwd, 0.0).sum(axis=0)
        k, at = np.nonzero(held[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(at.astype(np.int32)), *[pa.array(held[k, i, at]) for i in range(3)]], names=["k", "at", "n", "priced", "total"])

    found = rows.mapInArrow(sums, "k int, at int, n double, priced double, total double").groupBy("k", "at").agg(*[F.sum(c).alias(c) for c in ("n", "priced", "total")])
    at = F.broadcast(spark.createDataFrame([(i, m) for i, m in enumerate(months)], f"at int, {month} {dict(parts.series.dtypes)[month]}"))
    name = F.get(F.array(*[F.lit(p) for p in PORTFOLIOS]), F.col("k"))
    ret = F.when(F.col("priced") > 0, F.col("total") / F.col("priced")).otherwise(0.0)
    return found.join(at, "at").select(month, name.alias("portfolio"), F.col("n").cast("long").alias("n"), ret.alias("ret"))


def composite_by_month(scores: Mapping[str, np.ndarray], batch: pa.RecordBatch, parts: Sequence, known: Mapping, weights: Mapping[str, float]) -> np.ndarray:
    """The raw composite, as in ``monthly_scores``, from the scores of the categories that change; NaN where there is none."""
    total, points = np.zeros((batch.num_rows, 1)), np.zeros((batch.num_rows, 1))
    for k, of in enumerate(parts):
        if k in known:
            total, points = total + column(batch, f"_t{k}")[:, None], points + column(batch, f"_s{k}")[:, None]
        else:
            w, score = float(weights[of[0]]), scores[of[0]]
            there = ~np.isnan(score)
            total, points = total + np.where(there, w, 0.0), points + np.where(there, w * np.nan_to_num(score), 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return round_at(np.where(total > 0, points / total, np.nan), 9)


#: Names of a cell of one point of a score, about; where there are more names a point has more cells.
POINT_NAMES = 2_000_000


def ic_by_month(parts: MonthParts, weights: Mapping[str, float], least: int = 20, digits: int = 6, month: str = "as_of", group: str = "earner") -> DataFrame:
    """(month, factor, n, ic): rank correlations with the return ``fwd`` of the composite (as ``with_steps`` gives it) and of the scores, rounded at ``digits``, of the categories that change.

    ``parts`` are those with ``returns``: they are ranked on the series, weighted by the names that have a factor, so a name's values meet the ranks of their returns. Values of all names and months are dealt out
    once, in arrays by factor, month and cell of the value; a cell leaves only its sums, or, for the composite, its raw composites in order, whose percentiles follow from the counts of the cells before.
    """
    spark, categories = parts.base.sparkSession, sorted(parts.changing)
    factors = factors_of(parts.changing)
    if not parts.months:
        return spark.createDataFrame([], f"{month} {dict(parts.series.dtypes)[month]}, factor string, n long, ic double")
    moving, sums_of, known, n_months = parts.moving, parts.parts, parts.known, len(parts.months)
    per = 1 + parts.base.count() // POINT_NAMES
    wide = met(parts, [f"f_{f}" for f in factors], month, group)
    used = [*[f"{x}_{c}" for c in categories for x in "pw"], *[f"{x}_{m}" for m in moving for x in ("own", "pct")], *[f"{x}{k}" for k in known for x in ("_t", "_s")], *[f"f_{f}" for f in factors]]
    low, span = -1000 * per, 2000 * per + 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            scores = {c: category_by_month(batch, c, moving) for c in categories}
            values = [composite_by_month(scores, batch, sums_of, known, weights), *[round_at(scores[c], digits) for c in categories]]
            for k, v in enumerate(values):
                f = matrix(batch, f"f_{factors[k]}")
                v = np.broadcast_to(v, f.shape)
                row, at = np.nonzero(~np.isnan(v) & (~np.isnan(f) if k else True))  # all names have a place in the composite's percentiles
                v, f = v[row, at], f[row, at]
                key = at * span + np.floor(np.clip(v, -1000.0, 1000.0) * per).astype(np.int64) - low
                order = np.argsort(key, kind="stable")
                key = key[order]
                starts = np.flatnonzero(np.append(True, np.diff(key) != 0))[: len(key)]
                ends = pa.array(np.append(starts, len(key)), pa.int32())
                lists_ = [pa.ListArray.from_arrays(ends, pa.array(x[order])) for x in (v, f)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), k, dtype=np.int32)), pa.array(key[starts]), *lists_], names=["k", "key", "v", "f"])

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of some whole cells."""
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        flat = lambda c: table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).copy()
        table = table.take(pa.array(np.lexsort((table.column("key").to_numpy(), table.column("k").to_numpy()))))
        many = pc.list_value_length(table.column("v")).to_numpy()
        k, key = (table.column(c).to_numpy() for c in ("k", "key"))
        v, f = flat("v"), flat("f")
        new = np.append(True, (k[1:] != k[:-1]) | (key[1:] != key[:-1]))
        bounds = np.append(np.append(0, np.cumsum(many))[:-1][new], len(v))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):  # cell by cell
            order = np.argsort(v[a:b])
            v[a:b], f[a:b] = v[a:b][order], f[a:b][order]
        k, key = np.repeat(k, many), np.repeat(key, many)
        fresh = np.append(True, (k[1:] != k[:-1]) | (key[1:] != key[:-1]))
        start = np.flatnonzero(fresh)
        n = np.diff(np.append(start, len(v)))
        ends = np.flatnonzero(np.append(fresh[1:] | (v[1:] != v[:-1]), True)) + 1
        ties = np.diff(ends, prepend=0)
        rank = np.repeat(2.0 * ends - ties, ties) - 2.0 * np.repeat(start, n)
        is_score = k[start] > 0
        there = np.where(np.repeat(is_score, n), f, 0.0)
        sums = [np.where(is_score, np.add.reduceat(x, start), 0.0) for x in (rank, rank * rank, rank * there, there)]
        # only the composite's values go on
        whole = np.where(is_score, 0, n)
        bounds = pa.array(np.append(0, np.cumsum(whole)), pa.int32())
        on = k == 0
        lists_ = [pa.ListArray.from_arrays(bounds, pa.array(x[on])) for x in (v, f)]
        yield pa.RecordBatch.from_arrays([pa.array(k[start]), pa.array(key[start]), pa.array(n), *[pa.array(x) for x in sums], *lists_], names=["k", "key", "n", "r", "rr", "rf", "sf", "v", "f"])

    arrays = "v array<double>, f array<double>"
    pieces = max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts.base.count() * n_months * len(factors) // PIECE_ROWS)
    dealt = wide.select(*used).mapInArrow(deal, f"k int, key long, {arrays}").repartition(pieces, "k", "key")
    found = stored(dealt.mapInArrow(inside, f"k int, key long, n long, r double, rr double, rf double, sf double, {arrays}"), "cells-by-month")
    counts = found.where("k = 0").select("key", "n").toArrow()  # cells of one point, at most, of each month
    here = np.zeros(n_months * span, dtype=np.int64)
    here[counts["key"].to_numpy()] = counts["n"].to_numpy()
    here = here.reshape(n_months, span)
    totals, before = here.sum(axis=1), (np.cumsum(here, axis=1) - here).ravel()

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Names with a return, and the ranks of their returns, by the composites of a cell."""
        for batch in batches:
            for i in range(batch.num_rows):
                key = batch.column("key")[i].as_py()
                v, f = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in "vf")
                ends = np.flatnonzero(np.append(v[1:] != v[:-1], True)) + 1
                ties = np.diff(ends, prepend=0)
                pct = (before[key] + ends - ties + (ties + 1) / 2) / totals[key // span] * 100
                step = np.repeat(np.rint(pct * 100.0).astype(np.int32), ties)
                start = np.flatnonzero(np.append(True, np.diff(step) != 0))
                there = ~np.isnan(f)
                sums = [np.add.reduceat(x, start) for x in (there.astype(np.int64), np.where(there, f, 0.0))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(start), key // span, dtype=np.int32)), pa.array(step[start]), *[pa.array(x) for x in sums]], names=["at", "cell", "n", "sf"])

    # a cell of the composite is one of its values
    composite = found.where("k = 0").select("key", "v", "f").mapInArrow(steps, "at int, cell int, n long, sf double").groupBy("at", "cell").agg(F.sum("n").alias("n"), F.sum("sf").alias("sf")).where("n > 0")
    n = F.col("n").cast("double")
    composite = composite.select(F.lit(0).alias("k"), "at", F.col("cell").cast("long").alias("cell"), "n", (n * n).alias("r"), (n * n * n).alias("rr"), (n * F.col("sf")).alias("rf"), "sf")
    others = found.where("k > 0").select("k", F.floor(F.col("key") / span).cast("int").alias("at"), F.col("key").alias("cell"), "n", "r", "rr", "rf", "sf")
    sums = composite.unionByName(others)
    whole = Window.partitionBy("k", "at")
    shift = (2 * F.coalesce(F.sum("n").over(whole.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.sum("n").over(whole)).cast("double")
    sums = sums.withColumn("shift", shift)
    s = F.col("shift")
    sums = sums.groupBy("k", "at").agg(F.sum("n").alias("n"), F.sum(F.col("rf") + s * F.col("sf")).alias("xy"), F.sum(F.col("rr") + 2 * s * F.col("r") + s * s * F.col("n")).alias("xx"))
    # the spread of the ranks of returns
    yy = [F.sum(F.col(f"n_{f}") * F.col(f"f_{f}") * F.col(f"f_{f}")).alias(str(k)) for k, f in enumerate(factors)]
    yy = parts.series.groupBy(month).agg(*yy).unpivot([month], [str(k) for k in range(len(factors))], "k", "yy")
    at = F.broadcast(spark.createDataFrame([(i, m) for i, m in enumerate(parts.months)], f"at int, {month} {dict(parts.series.dtypes)[month]}"))
    out = sums.join(at, "at").join(yy.select(month, F.col("k").cast("int").alias("k"), "yy"), [month, "k"])
    ic = F.when((F.col("xx") > 0) & (F.col("yy") > 0), rounded(F.col("xy") / F.sqrt("xx") / F.sqrt("yy"), digits))
    return out.where(F.col("n") >= least).select(month, F.get(F.array(*[F.lit(f) for f in factors]), F.col("k")).alias("factor"), "n", ic.alias("ic"))

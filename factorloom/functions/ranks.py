"""Ranks and order statistics of groups of any size.

A window over a group sorts it in one task. Here the distinct values of all groups are cut into ranges
that Spark balances, each task numbers its own range, and a table with a row for each range and group
carries the counts of the ranges before it. A value held by many rows is one row with a count.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .store import stored


#: Rows of a range, about: where there are more rows there are more ranges, not larger ones.
RANGE_ROWS = 100_000


#: Columns that hold no nulls wherever they are joined here; plain equality sorts and hashes fewer columns.
NEVER_NULL = ("metric", "value", "part", "ticker")


def meet(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns of one name, where nulls are equal; the left side's columns stay."""
    if not on:
        return left.crossJoin(right)
    other = right.withColumnsRenamed({c: f"_{c}_" for c in on})
    pairs = [(c, left[c], other[f"_{c}_"]) for c in on]
    same = reduce(lambda a, b: a & b, [mine == theirs if c in NEVER_NULL else mine.eqNullSafe(theirs) for c, mine, theirs in pairs])
    return left.join(other, same, how).drop(*[f"_{c}_" for c in on])


def counted(rows: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Distinct values of each group and how many rows have them; rows without value are left out."""
    return rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def placed(counts: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """counts(by, value, n) with ``below``, the rows of the group with a smaller value, and ``total``, all its rows."""
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(counts.repartitionByRange(parts, *by, value).withColumn("part", F.spark_partition_id()), "ranges")
    whole = Window.partitionBy(*by)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*by, "part").agg(F.sum("n").alias("here"))
    sums = sums.select(*by, "part", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("offset"), F.sum("here").over(whole).alias("total"))
    inside = Window.partitionBy("part", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    numbered = ranged.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return meet(numbered, sums, [*by, "part"]).select(*by, value, "n", (F.col("offset") + F.col("inside")).alias("below"), "total")


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], nth: str = "nth", total: str = "total") -> DataFrame:
    """Rows with their place in their group by ``order``, from 1, and the group's number of rows.

    ``order`` ends in something that no two rows of a group share, so places do not depend on how rows are read. Rows are
    cut into ranges by group and order, each is numbered by itself, and a row for each range and group carries the
    counts of the ranges before: no task holds a group.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(rows.repartitionByRange(parts, *by, *order).withColumn("part", F.spark_partition_id()), "numbers")
    whole = Window.partitionBy(*by)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*by, "part").agg(F.count(F.lit(1)).alias("here"))
    sums = sums.select(*by, "part", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("offset"), F.sum("here").over(whole).alias(total))
    inside = ranged.withColumn(nth, F.row_number().over(Window.partitionBy("part", *by).orderBy(*order)))
    return meet(inside, sums, [*by, "part"]).withColumn(nth, F.col("offset") + F.col(nth)).drop("offset", "part")


def codes(columns: Sequence[pa.ChunkedArray]) -> np.ndarray:
    """A number for each row, the same where all columns are the same (null is a value)."""
    out = np.zeros(len(columns[0]), dtype=np.int64)
    for column in columns:
        one = column.combine_chunks().dictionary_encode(null_encoding="encode")
        out = out * max(1, len(one.dictionary)) + one.indices.to_numpy(zero_copy_only=False)
    return out


def places(code: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row: how many rows of its code have a smaller value, and how many have its value. NaN is the largest value."""
    n = len(value)
    order = np.lexsort((value, code))
    c, v = code[order], value[order]
    group = np.append(True, c[1:] != c[:-1])
    fresh = group | np.append(True, (v[1:] != v[:-1]) & ~(np.isnan(v[1:]) & np.isnan(v[:-1])))
    starts = np.flatnonzero(fresh)
    run = np.cumsum(fresh) - 1
    below, ties = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    below[order] = starts[run] - np.maximum.accumulate(np.where(group, np.arange(n), 0))
    ties[order] = np.diff(np.append(starts, n))[run]
    return below, ties


def range_places(whole: Sequence[str], inner: str, value: str):
    """Rows of a range with their places in it: in their group (``_in``, ``_n``), and in the group's part of one inner value."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        group = codes([table.column(c) for c in whole]) if whole else np.zeros(len(table), dtype=np.int64)
        part = codes([table.column(inner)])
        values = table.column(value).combine_chunks().to_numpy(zero_copy_only=False)
        found = [*places(group, values), *places(group * (part.max() + 1) + part, values)]
        for name, x in zip(("_in", "_n", "_inner_in", "_inner_n"), found, strict=True):
            table = table.append_column(name, pa.array(x, pa.int64()))
        yield from table.to_batches()

    return count


def placed_rows(rows: DataFrame, by: Sequence[str], inner: str, value: str = "value", key: str = "ticker") -> DataFrame:
    """Rows with their places in their group (``below``, ``n``, ``total`` as in ``placed``), and in its part of one ``inner`` value (``inner_below``, ...).

    One sort serves both: rows are cut into ranges by group, value and a hash of the key, each range counts by
    itself as it arrives (``range_places``), and a row for each range, group and inner value carries the counts of the ranges before. A value that
    many rows share may fill several ranges; only the first and the last value of a range can, so their counts are
    in that row too. Nothing is joined by value. Rows without value are left out. ``rows`` are read twice, once to count them.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.where(F.col(value).isNotNull())
    ranges = max(parts, rows.count() // RANGE_ROWS)
    whole, own = [*by], [*by, inner]
    dealt = rows.repartitionByRange(ranges, *by, value, F.xxhash64(key)).withColumn("part", F.spark_partition_id())
    counts = [StructField(c, LongType()) for c in ("_in", "_n", "_inner_in", "_inner_n")]
    ranged = stored(dealt.mapInArrow(range_places(whole, inner, value), StructType([*dealt.schema.fields, *counts])), "ranges")
    here = stored(ranged.groupBy(*own, "part").agg(F.count(F.lit(1)).alias("here"), F.min(value).alias("low"), F.max(value).alias("high")), "range-counts")
    # a row for each range, group and inner value from here on
    ends = here.groupBy(*whole, "part").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("here").alias("all_here"))
    upto = lambda g: Window.partitionBy(*g).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    none = lambda c: F.coalesce(c, F.lit(0))
    ends = ends.select("*", none(F.sum("all_here").over(upto(whole))).alias("before"), F.sum("all_here").over(Window.partitionBy(*whole)).alias("total"))
    here = here.select(*own, "part", none(F.sum("here").over(upto(own))).alias("inner_before"), F.sum("here").over(Window.partitionBy(*own)).alias("inner_total"))
    at_ends = meet(ranged.select(*own, "part", value), ends.select(*whole, "part", "low", "high"), [*whole, "part"]).where((F.col(value) == F.col("low")) | (F.col(value) == F.col("high")))
    runs = stored(at_ends.groupBy(*own, value, "part").agg(F.count(F.lit(1)).alias("run")), "runs")
    all_runs = runs.groupBy(*whole, value, "part").agg(F.sum("run").alias("run"))

    def along(df: DataFrame, g: Sequence[str], prefix: str) -> DataFrame:
        """Of each value at an end of a range: how often it is in the ranges before, and in all."""
        of = [*g, value]
        return df.select(*of, "part", none(F.sum("run").over(upto(of))).alias(f"{prefix}prior"), F.sum("run").over(Window.partitionBy(*of)).alias(f"{prefix}ties"))

    def at(df: DataFrame, name: str, g: Sequence[str], prefix: str, end: str) -> DataFrame:
        one = along(df, g, prefix).withColumnsRenamed({value: end, f"{prefix}prior": f"{prefix}{name}_prior", f"{prefix}ties": f"{prefix}{name}_ties"})
        return one

    ends = meet(ends, at(all_runs, "low", whole, "", "low"), [*whole, "part", "low"], "left")
    ends = meet(ends, at(all_runs, "high", whole, "", "high"), [*whole, "part", "high"], "left")
    small = meet(here, ends.drop("all_here"), [*whole, "part"])
    small = meet(small, at(runs, "low", own, "inner_", "low"), [*own, "part", "low"], "left")
    small = stored(meet(small, at(runs, "high", own, "inner_", "high"), [*own, "part", "high"], "left"), "range-offsets")
    met = meet(ranged, small, [*own, "part"])
    first, last = F.col(value) == F.col("low"), F.col(value) == F.col("high")
    columns = {}
    for prefix in ("", "inner_"):
        columns[f"{prefix}below"] = F.col(f"{prefix}before") + F.col(f"_{prefix}in") - F.when(first, none(F.col(f"{prefix}low_prior"))).otherwise(0)
        columns[f"{prefix}n"] = F.when(first, F.col(f"{prefix}low_ties")).when(last, F.col(f"{prefix}high_ties")).otherwise(F.col(f"_{prefix}n"))
    return met.select(*rows.columns, *[c.alias(n) for n, c in columns.items()], "total", "inner_total")


def average_pct() -> Column:
    """Of rows of ``placed``: the rank with ties at their mean, over the number of rows, times 100."""
    return (F.col("below") + (F.col("n") + 1) / 2) / F.col("total") * 100


def quantiles(at: DataFrame, wanted: Mapping[str, float | tuple[Column, float]], by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Exact quantiles, linear between neighbours, of rows of ``placed``: one row for each group of ``by``.

    ``wanted``: name -> q, or (condition on the rows, q).
    """
    cols = []
    for name, w in wanted.items():
        where, q = w if isinstance(w, tuple) else (F.lit(True), w)
        h = (F.col("total") - 1) * F.lit(float(q))
        pick = lambda p, where=where: F.max(F.when(where & (F.col("below") <= p) & (p < F.col("below") + F.col("n")), F.col(value)))
        low, high = pick(F.floor(h)), pick(F.ceil(h))
        rest = F.max(F.when(where, h - F.floor(h)))
        cols.append((low + (high - low) * rest).alias(name))
    return at.groupBy(*by).agg(*cols)

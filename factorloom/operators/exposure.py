"""Factor returns and regressions on them."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FACTORS = ("Mkt-RF", "SMB", "HML", "RMW", "CMA", "UMD")


def factor_returns(five: DataFrame, momentum: DataFrame, dt: str = "dt") -> DataFrame:
    """Percent to fractions, names without blanks, on the dates of both tables; the momentum column is called UMD."""
    trimmed = lambda df: df.toDF(*[c.strip() for c in df.columns])
    both = trimmed(five).join(trimmed(momentum), dt)
    out = both.select(dt, *[(both[f"`{c}`"] / 100).alias("UMD" if c in ("Mom", "WML") else c) for c in both.columns if c != dt])
    return out


OUT = "factor string, coefficient double, std_error double, t_value double, p_value double, n long, r2 double, r2_adjusted double, f_value double"


def by_windows(rows: DataFrame, windows: DataFrame, dt: str = "dt") -> DataFrame:
    """rows in each of windows(window, start, end) that holds their date; windows are few."""
    return rows.join(F.broadcast(windows), (F.col(dt) >= F.col("start")) & (F.col(dt) <= F.col("end"))).drop("start", "end")


def two_sided_p(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Chance of a t value at least as far from 0, with ``df`` degrees of freedom: the incomplete beta function by its continued fraction."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    log_gamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(all="ignore"):
        front = np.exp(log_gamma(a + b) - log_gamma(a) - math.lgamma(b) + a * np.log(x) + b * np.log1p(-x))
    near = x < (a + 1) / (a + b + 2)
    p, q, z = np.where(near, a, b), np.where(near, b, a), np.where(near, x, 1 - x)
    tiny = 1e-300
    c = np.ones_like(z)
    d = 1 / np.where(np.abs(1 - (p + q) * z / (p + 1)) < tiny, tiny, 1 - (p + q) * z / (p + 1))
    h = d.copy()
    for m in range(1, 300):
        for step in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + step * d
            c = 1 + step / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    part = front * h / p
    out = np.where(near, part, 1 - part)
    return np.where(t == 0, 1.0, np.where(np.isinf(t), 0.0, np.clip(out, 0, 1)))


def _solve(names: Sequence[str], least: int):
    """Batches of means and sums of products, one row for each key, into rows of coefficients."""
    k = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy(zero_copy_only=False).astype(np.float64)
            at = np.flatnonzero(n >= max(least, 1))
            sums = np.array(batch.column("sums").to_pylist(), dtype=np.float64).reshape(batch.num_rows, -1)[at]
            n = n[at]
            rows = len(at)
            # means of the factors and y, then their products about the means, upper triangle row by row
            means, centred = sums[:, : k + 1], np.zeros((rows, k + 1, k + 1))
            i, j = np.triu_indices(k + 1)
            centred[:, i, j] = centred[:, j, i] = sums[:, k + 1 :]
            # factors of one length, so that what counts as dependent does not hang on their units
            scale = np.sqrt(np.maximum(np.einsum("rii->ri", centred[:, :k, :k]), 0))
            scale = np.where(scale > 0, scale, 1.0)
            unit = centred[:, :k, :k] / (scale[:, :, None] * scale[:, None, :])
            inverse = np.linalg.pinv(unit, rcond=1e-10, hermitian=True) / (scale[:, :, None] * scale[:, None, :]) if k else unit
            rank = np.linalg.matrix_rank(unit, tol=1e-10, hermitian=True) if k else np.zeros(rows)
            beta = np.einsum("rij,rj->ri", inverse, centred[:, :k, k])
            explained = np.einsum("ri,ri->r", beta, centred[:, :k, k])
            total = centred[:, k, k]
            left = np.maximum(total - explained, 0)
            const = means[:, k] - np.einsum("ri,ri->r", beta, means[:, :k])
            with np.errstate(all="ignore"):
                df = n - rank - 1
                variance = np.where(df > 0, left / df, np.nan)
                spread = np.concatenate((np.sqrt(np.maximum(variance[:, None] * np.einsum("rii->ri", inverse), 0)), np.sqrt(variance * (1 / n + np.einsum("ri,rij,rj->r", means[:, :k], inverse, means[:, :k])))[:, None]), axis=1)
                coefficient = np.concatenate((beta, const[:, None]), axis=1)
                t = coefficient / spread
                p = two_sided_p(t, np.repeat(df[:, None], k + 1, axis=1))
                r2 = np.where(total > 0, 1 - left / total, np.nan)
                adjusted = 1 - (1 - r2) * (n - 1) / df
                f = (explained / rank) / variance
            each = lambda v: _doubles(np.repeat(v[:, None], k + 1, axis=1).ravel())
            take = pa.array(np.repeat(at, k + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(take), pa.array([*names, "const"] * rows, pa.string()), *map(_doubles, (coefficient.ravel(), spread.ravel(), t.ravel(), p.ravel())), pa.array(np.repeat(n, k + 1).astype(np.int64)), each(r2), each(adjusted), each(f)],
                names=["key", *(c.split()[0] for c in OUT.split(", "))],
            )

    return run


def _doubles(v: np.ndarray) -> pa.Array:
    """What is not a number is null."""
    return pa.array(v, mask=~np.isfinite(v))


def factor_regression(portfolio: DataFrame, factors: DataFrame, names: Sequence[str] = FACTORS, least: int = 30, dt: str = "dt", keys: Sequence[str] = ()) -> DataFrame:
    """portfolio(keys, dt, ret): for each of ``keys`` least squares of the return over RF on the factors, with a constant; a row for each coefficient.

    One aggregate sums the products of factors and return about their means for all keys (portfolios, windows of time),
    partly before it moves; the small systems of equations are solved in batches on the cluster. Rows with a null
    are left out; a key with fewer than ``least`` rows has no result. Factors that depend on
    each other share their effect (the shortest solution). What cannot be told (no degree of freedom, no spread) is null.
    """
    used = [n for n in names if n in factors.columns]
    rows = portfolio.select(*keys, dt, "ret").join(factors, dt)
    values = [F.col(f"`{n}`").cast("double") for n in used] + [(F.col("ret") - F.col("RF")).cast("double")]
    rows = rows.select(F.struct(*keys).alias("key") if keys else F.lit(0).alias("key"), *[v.alias(f"x{i}") for i, v in enumerate(values)]).dropna(subset=[f"x{i}" for i in range(len(values))])
    size = len(values)
    # means, and products about the means: these partial sums do not cancel out where means are far from 0
    sums = [F.avg(f"x{i}") for i in range(size)] + [F.covar_pop(f"x{i}", f"x{j}") * F.count(F.lit(1)) for i in range(size) for j in range(i, size)]
    grouped = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("sums"))
    schema = T.StructType([grouped.schema["key"], *T.StructType.fromDDL(OUT).fields])
    out = grouped.mapInArrow(_solve(used, least), schema)
    fields = [c.split()[0] for c in OUT.split(", ")]
    return out.select(*[F.col(f"key.`{c}`").alias(c) for c in keys], *fields)


def annualised_alpha(regression: DataFrame, days: int = 252, keys: Sequence[str] = ()) -> DataFrame:
    """The constant as percent a year, and stars for its significance."""
    stars = F.when(F.col("p_value") < 0.01, "***").when(F.col("p_value") < 0.05, "**").when(F.col("p_value") < 0.1, "*").otherwise("")
    return regression.where("factor = 'const'").select(*keys, (F.col("coefficient") * days * 100).alias("alpha_pct"), "t_value", "p_value", stars.alias("significance"))

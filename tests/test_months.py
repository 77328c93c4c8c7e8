"""Scores of months as arrays of a security: the same as from a row for each security and month, none of which is stored."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from factorloom.functions import ranks
from factorloom.functions.stats import rounded
from factorloom.operators import backtest as B
from factorloom.operators import months as MO
from factorloom.operators import scoring as S

DIMENSION = [("va", "valuation", True, 60.0, 20.0), ("qu", "quality", False, 40.0, 80.0), ("ms", "momentum", True, 25.0, 25.0), ("mo", "momentum", True, 40.0, 10.0), ("mq", "momentum", False, 35.0, 35.0)]
WEIGHTS = {"valuation": 22.0, "quality": 22.0, "momentum": 13.0}


@pytest.fixture
def kept_rows(monkeypatch):
    """Rows of each table that an operator stores."""
    sizes: dict[str, int] = {}
    for module in (ranks, B, S, MO):
        plain = module.stored

        def counting(df, name="table", plain=plain):
            table = plain(df, name)
            sizes[name] = max(sizes.get(name, 0), table.count())
            return table

        monkeypatch.setattr(module, "stored", counting)
    return sizes


def inputs(spark, names=400, months=7, seed=3):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice([None, float("nan"), *x, *x, *x])
    static = [(f"T{i}", rng.choice(["x", "y", None]), i % 4 == 0, pick(*map(float, range(9))), pick(rng.random()), pick(rng.random(), 0.5)) for i in range(names)]
    followers = [(f"T{i}", f"P{i % 3}", f"E{i % 17}") for i in range(names)]
    dynamic = [(m, f"E{e}", pick(*map(float, range(5))) if m else None, pick(rng.random())) for m in range(months) for e in range(16) if (m, e) != (2, 7)]
    fwd = [(m, f"E{e}", rng.random() - 0.5) for m in range(months) for e in range(17) if (m + e) % 5 and m != 1]
    return (
        spark.createDataFrame(static, "ticker string, sector string, is_bank boolean, va double, qu double, ms double"),
        spark.createDataFrame(dynamic, "as_of int, earner string, mo double, mq double"),
        spark.createDataFrame(followers, "ticker string, series string, earner string"),
        spark.createDataFrame(DIMENSION, "metric string, category string, higher boolean, generic double, bank double"),
        WEIGHTS,
        spark.createDataFrame(fwd, "as_of int, earner string, fwd double"),
    )


def test_value_portfolios_of_months_without_a_row_for_each(spark, kept_rows):
    given = inputs(spark)
    got = {(r.as_of, r.portfolio): (r.n, r.ret) for r in MO.value_trap_by_month(B.month_parts(*given), q=0.5).collect()}
    sizes = dict(kept_rows)
    rows = B.monthly_scores(*given)
    r6 = lambda c: rounded(F.col(f"{c}_score"), 6)
    rows = rows.select("as_of", "ticker", r6("valuation").alias("value"), r6("quality").alias("quality"), r6("momentum").alias("momentum"), "fwd")
    want = {(r.as_of, r.portfolio): (r.n, r.ret) for r in B.value_trap_compare(rows, q=0.5).collect()}
    assert len(want) == 21 and got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)
    assert want[1, "value"][1] == 0 and len({v[0] for v in want.values()}) > 1  # some months have fewer names than a fifth
    assert max(sizes.values()) < 4 * 400  # values of the metrics; there are 2,800 names and months
    assert MO.value_trap_by_month(B.month_parts(*inputs(spark, names=15))).count() == 0


def test_coefficients_of_months_without_a_row_for_each(spark, kept_rows):
    given = inputs(spark)
    parts = B.month_parts(*given, returns=True)
    got = {(r.as_of, r.factor): (r.n, r.ic) for r in MO.ic_by_month(parts, WEIGHTS).collect()}
    sizes = dict(kept_rows)
    rows = B.monthly_scores(*given).withColumn("momentum_score", rounded(F.col("momentum_score"), 6))
    factors = ["composite", "momentum_score"]
    want = {(r.as_of, r.factor): (r.n, r.ic) for r in B.ic_series(rows, rows.where("fwd is not null").select("as_of", "ticker", "fwd"), factors).collect()}
    assert len(want) == 12 and got == want  # one month has no returns
    assert len({v[0] for v in want.values()}) > 1
    assert max(n for name, n in sizes.items() if name != "cells-by-month") < 4 * 400  # values of the metrics; there are 2,800 names and months
    assert sizes["cells-by-month"] <= 2 * 7 * 101

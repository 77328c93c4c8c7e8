from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest

from factorloom.operators import correlation as C


def brute(rows: list[tuple], digits: int, against: str | None = None) -> dict:
    """rows(group, key, name, value) by pandas, pair by pair."""
    out = {}
    frame = pd.DataFrame(rows, columns=["g", "k", "name", "v"]).dropna()
    for g, part in frame.groupby("g"):
        wide = part.pivot(index="k", columns="name", values="v")
        for a in wide.columns:
            for b in wide.columns:
                if (a < b and against is None) or (b == against and a != b):
                    both = wide[[a, b]].dropna()
                    if not len(both):
                        continue
                    x, y = both[a].rank() - (len(both) + 1) / 2, both[b].rank() - (len(both) + 1) / 2
                    d = np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())
                    out[g, a, b] = (round(float((x * y).sum() / d), digits) + 0.0 if d > 0 else None, len(both))
    return out


def some(seed: int, groups: int, keys: int, names: str, values: int) -> list[tuple]:
    r = random.Random(seed)
    rows = []
    for g in range(groups):
        for k in range(keys):
            for i, name in enumerate(names):
                if r.random() < 0.15 + 0.2 * (i % 3):
                    continue
                rows.append((g, f"k{k}", name, 7.0 if r.random() < 0.35 else float(r.randint(0, values))))
    return rows


def found(df, digits: int) -> dict:
    return {(r["g"], r["a"], r["b"]): (None if r["rho"] is None else round(r["rho"], digits) + 0.0, r["n"]) for r in df.collect()}


@pytest.mark.parametrize("groups, keys, values", [(1, 200, 8), (3, 60, 1000), (2, 40, 0)])
def test_equals_pandas(spark, groups, keys, values):
    rows = some(groups, groups, keys, "abcdef", values)
    df = spark.createDataFrame(rows, "g int, k string, name string, v double")
    got = found(C.spearman(df, "k", "name", "v", by=["g"], digits=6), 6)
    want = brute(rows, 6)
    assert got.keys() == want.keys()
    for pair, (rho, n) in want.items():
        assert got[pair][1] == n and (got[pair][0] == rho or abs(got[pair][0] - rho) < 2e-6), pair


def test_against_one_name(spark):
    rows = some(9, 2, 50, "abcd", 30)
    df = spark.createDataFrame(rows, "g int, k string, name string, v double")
    got, want = found(C.spearman(df, "k", "name", "v", by=["g"], against="b", digits=6), 6), brute(rows, 6, "b")
    assert got.keys() == want.keys() and all(got[p][1] == want[p][1] and abs(got[p][0] - want[p][0]) < 2e-6 for p in want)


def test_equal_values_that_fill_many_ranges(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        rows = [(0, f"k{k}", n, float(1 if k % 50 else k) if n == "a" else float(k % 17)) for k in range(500) for n in "ab"]
        df = spark.createDataFrame(rows, "g int, k string, name string, v double")
        assert found(C.spearman(df, "k", "name", "v", by=["g"], digits=6), 6) == brute(rows, 6)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_blocks_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 40)
    rows = some(4, 1, 60, "abc", 10)
    odd = [(0, "x", "a", None), (0, "y", "b", float("nan")), (0, "z", "d", 1.0)]
    df = spark.createDataFrame(rows + odd, "g int, k string, name string, v double")
    got = {(r.a, r.b): r.n for r in C.spearman(df, "k", "name", "v").collect()}
    assert got == {(a, b): n for (_, a, b), (_, n) in brute(rows, 3).items()}
    assert C.spearman(df.limit(0), "k", "name", "v").count() == 0

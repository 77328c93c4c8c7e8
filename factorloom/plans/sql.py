"""Pieces of SQL that the checks share."""

from __future__ import annotations


def rd(x: str, d: int) -> str:
    """Half to even on the scaled double."""
    return f"(round_even(({x}) * 1e{d}::DOUBLE, 0) / 1e{d}::DOUBLE)"


def pct_sql(value: str, by: str) -> str:
    return f"((rank() OVER (PARTITION BY {by} ORDER BY {value}) + (count(*) OVER (PARTITION BY {by}, {value}) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY {by}) * 100)"

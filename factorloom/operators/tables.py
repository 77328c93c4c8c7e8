"""Universes, upserts and append-only history tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.store import stored


def universe(raw: DataFrame, ticker: str, company: str, sector: str) -> DataFrame:
    """Three columns under their own names; dots in tickers become dashes."""
    return raw.select(F.regexp_replace(ticker, r"\.", "-").alias("ticker"), F.col(company).alias("company"), F.col(sector).alias("sector"))


BAD = "_bad_row"


def read_listing(spark: SparkSession, path: str, kind: str, columns: Sequence[str]) -> DataFrame:
    """Constituents from CSV files with a header line or from JSON lines, with the declared ``columns`` as strings and ``_bad_row``.

    A row that does not fit (too few or too many fields, broken JSON) is kept with its text in ``_bad_row``; the
    other rows have null there. Files are read once, whole rows at a time, by as many tasks as their size takes;
    other fields of JSON are not read. CSV columns are taken by position, and a header with other names is an error.
    """
    schema = ", ".join([*(f"`{c}` string" for c in columns), f"{BAD} string"])
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD)
    if kind == "csv":
        df = reader.option("header", True).option("enforceSchema", False).option("multiLine", False).csv(path)
    elif kind == "json":
        df = reader.json(path)
    else:
        raise ValueError("kind is csv or json")
    return stored(df, "listing")  # parsed whole: a column alone would hide what is wrong in the others


def universe_of(listing: DataFrame, ticker: str, company: str, sector: str) -> DataFrame:
    """``universe`` of the rows that fit and have a ticker; of rows that repeat a ticker one stays, the first by company and sector."""
    good = universe(listing.where(F.col(BAD).isNull()), ticker, company, sector).where("ticker is not null and ticker <> ''")
    return first_of_each(good, "ticker", "company", "sector")


def first_that_holds(listings: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """The first universe that has rows, with its name as ``source``: a network's listing, else the local one."""
    out = None
    for name, df in listings:
        named = df.withColumn("source", F.lit(name))
        if out is None:
            out = named
        else:
            some = out.limit(1).agg((F.count(F.lit(1)) == 0).alias("none"))
            out = out.unionByName(named.crossJoin(F.broadcast(some)).where("none").drop("none"))
    return out


def listing_quality(listing: DataFrame) -> DataFrame:
    """How many rows fit, how many do not, and how many that fit lack a value in each column."""
    names = [c for c in listing.columns if c != BAD]
    fits = F.col(BAD).isNull()
    return listing.agg(F.count_if(fits).alias("good"), F.count_if(~fits).alias("bad"), *[F.count_if(fits & F.col(c).isNull()).alias(f"no_{c.lower().replace(' ', '_')}") for c in names])


def exclude(df: DataFrame, tickers: Sequence[str] = (), sectors: Sequence[str] = ()) -> DataFrame:
    """Without the tickers and sectors; rows without a ticker or sector stay. Lists of any length are joined, so the plan does not grow with them."""
    for column, values in (("ticker", tickers), ("sector", sectors)):
        if values:
            gone = df.sparkSession.createDataFrame([(v,) for v in set(values)], f"{column} string")
            df = df.join(gone, column, "left_anti")
    return df


def first_of_each(df: DataFrame, key: str, *order: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("nth", nth).where("nth = 1").drop("nth")


def subset(df: DataFrame, tickers: Sequence[str]) -> DataFrame:
    """Listed tickers; those that the universe does not have come as Unknown if it has none of them."""
    wanted = df.sparkSession.createDataFrame([(t,) for t in tickers], "ticker string")
    found = df.join(F.broadcast(wanted), "ticker", "left_semi")
    have = found.agg((F.count(F.lit(1)) == 0).alias("none"))
    made = wanted.crossJoin(F.broadcast(have)).where("none").select("ticker", F.col("ticker").alias("company"), F.lit("Unknown").alias("sector"))
    return found.select("ticker", "company", "sector").unionByName(made)


def drift(old: DataFrame, new: DataFrame, alert: float = 10.0) -> DataFrame:
    """Tickers that came and went, and their share of the old list in percent."""
    both = old.select("ticker", F.lit(1).alias("o")).join(new.select("ticker", F.lit(1).alias("n")), "ticker", "full_outer")
    out = both.agg(F.count_if(F.col("o").isNull()).alias("added"), F.count_if(F.col("n").isNull()).alias("removed"), F.count("o").alias("old"))
    return out.withColumn("drift_pct", (F.col("added") + F.col("removed")) / F.col("old") * 100).withColumn("alert", F.col("drift_pct") > alert)


def min_market_cap(df: DataFrame, floor: float) -> DataFrame:
    return df.where(F.col("market_cap").isNull() | (F.col("market_cap") >= floor))


def sector_override(records: DataFrame, names: DataFrame) -> DataFrame:
    """The universe's sector wins; its company only where the record has none or the ticker."""
    theirs = names.select("ticker", F.col("sector").alias("u_sector"), F.col("company").alias("u_company"))
    out = records.join(theirs, "ticker", "left")
    company = F.when(F.col("company").isNull() | (F.col("company") == F.col("ticker")), F.coalesce("u_company", "company")).otherwise(F.col("company"))
    return out.withColumns({"sector": F.coalesce("u_sector", "sector"), "company": company}).drop("u_sector", "u_company")


def enrich(df: DataFrame, raw: DataFrame, names: Mapping[str, str], key: str = "ticker") -> DataFrame:
    """Raw fields joined on under their display names; only those that ``raw`` has and ``df`` lacks."""
    wanted = {old: new for old, new in names.items() if old in raw.columns and new not in df.columns}
    if not wanted:
        return df
    return df.join(raw.select(key, *[F.col(old).alias(new) for old, new in wanted.items()]), key, "left")


def drop_failed(records: DataFrame) -> DataFrame:
    return records.where(~(F.col("error").isNotNull() & F.col("market_cap").isNull()))


def refresh_upsert(first: DataFrame, second: DataFrame, key: str = "ticker") -> DataFrame:
    """Records of the second pass in place of failed ones of the first."""
    names = [c for c in first.columns if c != key]
    s = second.select(key, *[F.col(c).alias(f"s_{c}") for c in names], F.lit(True).alias("again"))
    out = first.join(s, key, "left")
    use = F.col("error").isNotNull() & F.col("again").isNotNull()
    return out.select(key, *[F.when(use, F.col(f"s_{c}")).otherwise(F.col(c)).alias(c) for c in names])


def append_new(history: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """History and those rows whose keys it does not have."""
    return history.unionByName(rows.join(history.select(*keys).distinct(), list(keys), "left_anti").select(*history.columns))


def merge_histories(historical: DataFrame, live: DataFrame) -> DataFrame:
    return historical.withColumn("source", F.lit("historical")).unionByName(live.withColumn("source", F.lit("live")), allowMissingColumns=True)


def snapshot(scored: DataFrame, portfolio: DataFrame, run_date: str) -> DataFrame:
    members = portfolio.select("ticker", F.lit(True).alias("m")).distinct()
    out = scored.join(members, "ticker", "left").withColumn("in_portfolio", F.coalesce("m", F.lit(False))).drop("m")
    return out.withColumn("run_date", F.lit(run_date).cast("date"))


def history_status(history: DataFrame, tiers: Sequence[tuple[int, str]] = ((50, "mature"), (24, "growing"), (8, "early"))) -> DataFrame:
    out = history.agg(F.count_distinct("run_date").alias("run_dates"), F.count(F.lit(1)).alias("rows"), F.sum("n_tickers").alias("ticker_dates"))
    tier = F.when(F.lit(False), "")
    for least, name in tiers:
        tier = tier.when(F.col("run_dates") >= least, name)
    return out.withColumn("tier", tier.otherwise("new"))

"""Statement lines and fiscal periods, in long form: ticker, statement, freq, line_no, label, period_end, value."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINE = ["ticker", "statement", "freq"]


def label_match(lines: DataFrame, labels: Sequence[str]) -> DataFrame:
    """For each requested label and statement the stored label: equal without case first, else one that begins or ends with it."""
    wanted = lines.sparkSession.createDataFrame([(x,) for x in labels], "wanted string")
    known = lines.select(*LINE, "line_no", "label").distinct()
    low, ask = F.lower(F.trim("label")), F.lower(F.trim("wanted"))
    rank = F.when(low == ask, 0).when(F.startswith(low, ask) | F.endswith(low, ask), 1)
    hits = known.crossJoin(F.broadcast(wanted)).withColumn("priority", rank).where("priority is not null")
    nth = F.row_number().over(Window.partitionBy(*LINE, "wanted").orderBy("priority", "line_no", "label"))
    return hits.withColumn("nth", nth).where("nth = 1").select(*LINE, "wanted", "label", "priority")


def numbered(lines: DataFrame) -> DataFrame:
    """Non-null values of each label, newest first, from k = 0."""
    k = F.row_number().over(Window.partitionBy(*LINE, "label").orderBy(F.col("period_end").desc())) - 1
    return lines.where("value is not null").withColumn("k", k)


def value_at(lines: DataFrame, k: int = 0) -> DataFrame:
    return numbered(lines).where(F.col("k") == k).select(*LINE, "label", "period_end", "value")


def ltm(lines: DataFrame, offset: int = 0, quarters: int = 4) -> DataFrame:
    """Sum of the last quarters; null with fewer. With three of four at offset 0 it is scaled up and marked partial."""
    part = F.when((F.col("k") >= offset) & (F.col("k") < offset + quarters), F.col("value"))
    out = numbered(lines.where("freq = 'Q'")).groupBy("ticker", "statement", "label").agg(F.count(part).alias("n"), F.sum(part).alias("total"))
    partial = F.lit(offset == 0) & (F.col("n") == quarters - 1)
    value = F.when(F.col("n") == quarters, F.col("total")).when(partial, F.col("total") * quarters / (quarters - 1))
    return out.select("ticker", "statement", "label", "n", value.alias("ltm"), partial.alias("partial"))


def partial_labels(found: DataFrame) -> DataFrame:
    """Per ticker the labels whose sums are partial."""
    return found.groupBy("ticker").agg(F.array_sort(F.collect_set(F.when(F.col("partial"), F.col("label")))).alias("labels"), F.max("partial").alias("annualized"))


def alias_chain(found: DataFrame, chain: Sequence[str], value: str = "ltm") -> DataFrame:
    """Per ticker the value of the first label of the chain that has one."""
    order = found.sparkSession.createDataFrame(list(enumerate(chain)), "place int, label string")
    return found.join(F.broadcast(order), "label").where(F.col(value).isNotNull()).groupBy("ticker").agg(F.min_by(value, "place").alias("value"), F.min_by("label", "place").alias("label"))


def mrq_balance(lines: DataFrame, statement: str = "balance") -> DataFrame:
    """Latest value of each label of a statement and the one before: of quarters, or for a ticker without any, of years.

    Before means four periods back if the ticker's quarterly statement has five periods or more, else one; values are counted label by
    label, without the missing ones.
    """
    rows = lines.where(F.col("statement") == statement)
    periods = rows.groupBy("ticker").agg(F.count_distinct(F.when(F.col("freq") == "Q", F.col("period_end"))).alias("quarters"))
    found = numbered(rows).join(periods, "ticker").where((F.col("freq") == "Q") == (F.col("quarters") > 0))
    back = F.when(F.col("quarters") >= 5, 4).otherwise(1)
    source = F.when(F.col("quarters") > 0, "quarterly").otherwise("annual")
    return found.groupBy("ticker", "label", source.alias("source")).agg(F.max(F.when(F.col("k") == 0, F.col("value"))).alias("latest"), F.max(F.when(F.col("k") == back, F.col("value"))).alias("prior"))


def requests(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """(statement, freq, label, k): look-ups of the k-th value, or of a sum of four quarters where k is null."""
    return spark.createDataFrame(list(rows), "statement string, freq string, label string, k int")


def misses(lines: DataFrame, tickers: DataFrame, wanted: DataFrame, quarters: int = 4) -> DataFrame:
    """Look-ups ``wanted`` that give nothing for some of ``tickers``, counted by label and reason.

    Reasons: the ticker has no such statement (``empty statement``), or no such label in it, or too few values for the
    k-th (``out of range``), or fewer than three of four quarters for a sum (``insufficient quarters``). Labels are compared
    without case. The look-ups are a few dozen rows.
    """
    held = lines.select("ticker", "statement", "freq").distinct()
    low = F.lower(F.trim("label")).alias("low")
    labels = lines.groupBy("ticker", "statement", "freq", low).agg(F.count("value").alias("n"))
    asked = tickers.select("ticker").distinct().crossJoin(F.broadcast(wanted.withColumn("low", F.lower(F.trim("label")))))
    joined = asked.join(held.withColumn("held", F.lit(True)), LINE, "left").join(labels, [*LINE, "low"], "left")
    reason = (
        F.when(F.col("held").isNull(), "empty statement")
        .when(F.col("n").isNull(), "label not found")
        .when(F.col("k").isNotNull() & (F.col("n") <= F.col("k")), "out of range")
        .when(F.col("k").isNull() & (F.col("n") < quarters - 1), "insufficient quarters")
    )
    return joined.withColumn("reason", reason).where("reason is not null").groupBy("label", "reason").agg(F.count(F.lit(1)).alias("n"))


def freshness(lines: DataFrame, as_of: str, stale: int = 200) -> DataFrame:
    out = lines.groupBy("ticker", "statement").agg(F.max("period_end").alias("newest"))
    out = out.withColumn("age", F.datediff(F.lit(as_of).cast("date"), "newest"))
    return out.withColumn("stale", F.col("age") > stale)


def prior_year(lines: DataFrame) -> DataFrame:
    """Per ticker and label the sum of the four quarters before the last four, or the year before the last of the annual statements."""
    quarterly = ltm(lines, offset=4).select("ticker", "label", "ltm")
    annual = numbered(lines.where("freq = 'A'")).where("k = 1").select("ticker", "label", F.col("value").alias("annual"))
    out = quarterly.join(annual, ["ticker", "label"], "full_outer")
    return out.select("ticker", "label", F.coalesce("ltm", "annual").alias("prior"), F.when(F.col("ltm").isNotNull(), "quarterly").when(F.col("annual").isNotNull(), "annual").alias("source"))


def source_blocks(lines: DataFrame, decisive: Mapping[str, Sequence[str]]) -> DataFrame:
    """Per ticker and statement the labels of one source: sums of four quarters, unless all ``decisive`` ones of the statement are missing; then all labels come from the last annual statement.

    The tag says which: quarterly or annual. ``decisive``: statement -> labels; other statements are left out.
    """
    pairs = lines.sparkSession.createDataFrame([(st, x) for st, labels in decisive.items() for x in labels], "statement string, label string").withColumn("decides", F.lit(True))
    rows = lines.where(F.col("statement").isin(*decisive))
    quarterly = ltm(rows).select("ticker", "statement", "label", "ltm")
    annual = numbered(rows.where("freq = 'A'")).where("k = 0").select("ticker", "statement", "label", F.col("value").alias("annual"))
    both = quarterly.join(annual, ["ticker", "statement", "label"], "full_outer").join(F.broadcast(pairs), ["statement", "label"], "left")
    found = F.count(F.when(F.col("decides"), F.col("ltm"))).over(Window.partitionBy("ticker", "statement"))
    out = both.withColumn("source", F.when(found > 0, "quarterly").otherwise("annual"))
    return out.select("ticker", "statement", "label", F.when(F.col("source") == "quarterly", F.col("ltm")).otherwise(F.col("annual")).alias("value"), "source").where("value is not null")


def current_and_prior(lines: DataFrame, chains: dict[str, Sequence[str]]) -> DataFrame:
    """One row per ticker: for each field the last annual value and the one before, each by the first label of the field's chain that has it."""
    rows = [(field, place, label.lower()) for field, labels in chains.items() for place, label in enumerate(labels)]
    order = lines.sparkSession.createDataFrame(rows, "field string, place int, low string")
    known = numbered(lines.where("freq = 'A'")).where("k <= 1").withColumn("low", F.lower(F.trim("label"))).join(F.broadcast(order), "low")
    pick = lambda f, k: F.min_by("value", F.when((F.col("field") == f) & (F.col("k") == k), F.col("place")))
    return known.groupBy("ticker").agg(*[x for f in chains for x in (pick(f, 0).alias(f), pick(f, 1).alias(f"{f}_prior"))])

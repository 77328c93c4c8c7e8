"""Cross-sectional cleaning and scoring.

Inside, scores are tall: one row per (keys, ticker, metric) with a value. ``keys`` (dates, runs,
scenarios) lets one plan score many cross-sections at once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import METRICS, OPTIONAL, REDUCIBLE
from ..functions.ranks import average_pct, counted, meet, placed, placed_rows, quantiles
from ..functions.stats import quantile, rounded, steady, weighted_mean
from ..functions.store import stored

IDS = ["ticker", "sector", "is_bank"]


def to_tall(wide: DataFrame, metrics: Sequence[str], ids: Sequence[str] = IDS, keys: Sequence[str] = ()) -> DataFrame:
    """One row per value; missing values have no row."""
    tall = wide.select(*keys, *ids, *[F.col(m).cast("double").alias(m) for m in metrics])
    return tall.unpivot([*keys, *ids], list(metrics), "metric", "value").where(F.col("value").isNotNull() & ~F.isnan("value"))


def with_dimension(tall: DataFrame, dimension: DataFrame) -> DataFrame:
    """Add category, direction and the weight of the row's profile; the dimension is a few dozen rows."""
    return tall.join(F.broadcast(dimension), "metric").withColumn("weight", profile_weight())


def profile_weight() -> Column:
    return F.when(F.col("is_bank"), F.col("bank")).otherwise(F.col("generic"))


def clamp_limits(at: DataFrame, low: float, high: float, least: int, by: Sequence[str]) -> DataFrame:
    """Of values placed in their metric: the smallest and largest that stay, k = int(share * n) from either end; none for small metrics."""
    enough = F.col("total") >= least
    floor = F.min(F.when(enough & (F.col("below") + F.col("n") > F.floor(F.lit(low) * F.col("total"))), F.col("value")))
    ceiling = F.max(F.when(enough & (F.col("below") < F.col("total") - F.floor(F.lit(high) * F.col("total"))), F.col("value")))
    return at.groupBy(*by).agg(floor.alias("floor"), ceiling.alias("ceiling"))


def clamped(rows: DataFrame, limits: DataFrame, by: Sequence[str]) -> DataFrame:
    value = F.when(F.col("floor").isNull(), F.col("value")).otherwise(F.greatest("floor", F.least("ceiling", "value")))
    return meet(rows, limits, by).withColumn("value", value).drop("floor", "ceiling")


def winsorize(tall: DataFrame, low: float = 0.01, high: float = 0.01, least: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """Replace the k lowest and highest values of a metric by the next order statistic, k = int(share * n)."""
    by = [*keys, "metric"]
    tall = stored(tall, "values")
    return clamped(tall, clamp_limits(placed(counted(tall, by), by), low, high, least, by), by)


def directed(pct: Column, higher: Column) -> Column:
    """Lower-is-better metrics are turned around: the best gets 100 - 100/n, the worst 0."""
    return F.when(higher, pct).otherwise(F.lit(100) - pct)


def pct_rank_universe(tall: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    by = [*keys, "metric"]
    tall = stored(tall, "values")
    ranks = placed(counted(tall, by), by).select(*by, "value", average_pct().alias("pct"))
    return meet(tall, ranks, [*by, "value"]).withColumn("pct", directed(F.col("pct"), F.col("higher")))


def sector_ranks(inside: DataFrame, everywhere: DataFrame, least: int, by: Sequence[str]) -> DataFrame:
    """Percentile of each value of a sector: in the sector, or in the universe where the sector has fewer than ``least`` values."""
    own = inside.select(*by, "sector", "value", average_pct().alias("inside"), (F.col("total") < least).alias("few"))
    all_ = everywhere.select(*by, "value", average_pct().alias("everywhere"))
    out = meet(own, all_, [*by, "value"])
    return out.select(*by, "sector", "value", F.when(F.col("few"), F.col("everywhere")).otherwise(F.col("inside")).alias("pct"))


def pct_rank_sector(tall: DataFrame, least: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """Rank inside the sector, or in the universe where the sector has fewer than ``least`` values."""
    by = [*keys, "metric"]
    tall = stored(tall, "values")
    counts = counted(tall, [*by, "sector"])
    ranks = sector_ranks(placed(counts, [*by, "sector"]), placed(counted(tall, by), by), least, by)
    return meet(tall, ranks, [*by, "sector", "value"]).withColumn("pct", directed(F.col("pct"), F.col("higher")))


def cleaned_ranks(tall: DataFrame, low: float = 0.01, high: float = 0.01, least: int = 10, keys: Sequence[str] = (), dimension: DataFrame | None = None) -> DataFrame:
    """``winsorize`` and then ``pct_rank_sector``, from one sort of the values of each metric for both.

    Clamped values keep their order, so ranks of what is clamped follow from those of the values: all at or
    below the lowest value that stays tie there, and all at or above the highest. With a ``dimension`` (by metric, and key if it has it)
    rows need not bring what it holds through the sort: it is added after it, as by ``with_dimension``.
    """
    by = [*keys, "metric"]
    tall = stored(tall, "values")
    at = placed_rows(tall, by, "sector")  # read from stored ranges each time
    limits = stored(clamp_limits(at, low, high, least, by), "limits")
    rows = meet(at, limits, by)
    under, over = F.col("value") <= F.col("floor"), F.col("value") >= F.col("ceiling")
    ends = stored(rows.groupBy(*by, "sector").agg(F.count_if(under).alias("inner_under"), F.count_if(over).alias("inner_over")), "ends")
    every = ends.groupBy(*by).agg(F.sum("inner_under").alias("under"), F.sum("inner_over").alias("over"))
    rows = meet(meet(rows, ends, [*by, "sector"]), every, by)
    same = F.coalesce(F.col("floor") == F.col("ceiling"), F.lit(False))
    for prefix in ("", "inner_"):
        total, below, n = (F.col(f"{prefix}{c}") for c in ("total", "below", "n"))
        rows = rows.withColumns(
            {
                f"{prefix}below": F.when(same | F.coalesce(under, F.lit(False)), 0).when(over, total - F.col(f"{prefix}over")).otherwise(below),
                f"{prefix}n": F.when(same, total).when(under, F.col(f"{prefix}under")).when(over, F.col(f"{prefix}over")).otherwise(n),
            }
        )
    pct = lambda prefix: (F.col(f"{prefix}below") + (F.col(f"{prefix}n") + 1) / 2) / F.col(f"{prefix}total") * 100
    rank = F.when(F.col("inner_total") < least, pct("")).otherwise(pct("inner_"))
    value = F.when(F.col("floor").isNull(), F.col("value")).otherwise(F.greatest("floor", F.least("ceiling", "value")))
    columns = list(tall.columns)
    if dimension is not None:
        own = [c for c in by if c in dimension.columns]  # one dimension may serve all keys
        rows = meet(rows, dimension, own).withColumn("weight", profile_weight())
        columns += [c for c in (*dimension.columns, "weight") if c not in columns]
    out = rows.withColumns({"pct": directed(rank, F.col("higher")), "value": value})
    return out.select(*columns, "pct")


def logistic(pct: Column, steepness: float = 0.08) -> Column:
    return F.lit(100.0) / (F.lit(1.0) + F.exp(F.lit(-steepness) * (pct - F.lit(50.0))))


def category_scores(ranked: DataFrame, categories: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One row per ticker with a score for each category: the weighted mean over the percentiles it has."""
    cols = [
        steady(weighted_mean(F.when(F.col("category") == c, F.col("pct")), F.when(F.col("category") == c, F.col("weight")))).alias(f"{c}_score")
        for c in categories
    ]
    return ranked.groupBy(*keys, *IDS).agg(*cols)


def _moved(ranked: DataFrame, on: Column, to: Sequence[str], factor: float, dimension: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Where ``on``, the F-score's weight is lowered, and what is freed goes to the metrics ``to`` by their generic weights.

    ``dimension`` has a row for each metric (and key); its sums are one row for each key.
    """
    parts = {f"generic_{m}": F.max(F.when(F.col("metric") == m, F.col("generic"))) for m in ("piotroski_f_score", *to)}
    own = [k for k in keys if k in dimension.columns]  # one dimension may serve all keys
    sums = dimension.groupBy(*own).agg(*[x.alias(n) for n, x in parts.items()])
    out = meet(ranked.withColumn("on", on), sums, own)
    pool = sum((F.coalesce(f"generic_{m}", F.lit(0.0)) for m in to), F.lit(0.0))
    freed = F.col("generic_piotroski_f_score") * (1 - factor)
    weight = (
        F.when(F.col("on") & (F.col("metric") == "piotroski_f_score"), F.col("generic_piotroski_f_score") * factor)
        .when(F.col("on") & F.col("metric").isin(*to) & (pool > 0) & (F.col("generic") > 0), F.col("generic") + freed * F.col("generic") / pool)
        .otherwise(F.col("weight"))
    )
    return out.withColumn("weight", weight).drop("on", *parts)


def _dear(threshold: float, keys: Sequence[str]) -> Column:
    """Non-banks with a valuation score under the threshold: one window by ticker, on the partitioning of the category scores."""
    mine = Window.partitionBy(*keys, "ticker")
    of = F.col("category") == "valuation"
    got = F.sum(F.when(of, F.col("weight"))).over(mine)
    valuation = F.when(got > 0, F.sum(F.when(of, F.col("weight") * F.col("pct"))).over(mine) / got)
    return F.coalesce(~F.col("is_bank") & (steady(valuation) < threshold), F.lit(False))


def piotroski_conditional(ranked: DataFrame, dimension: DataFrame, threshold: float = 50.0, factor: float = 0.5, to: Sequence[str] = ("roic", "gross_profit_assets"), keys: Sequence[str] = ()) -> DataFrame:
    """Lower the F-score's weight of dear non-banks and give what is freed to other metrics by their weights."""
    return _moved(ranked, _dear(threshold, keys), to, factor, dimension, keys)


def piotroski_growth_trap(ranked: DataFrame, dimension: DataFrame, earlier: DataFrame, high: float = 0.7, low: float = 0.35, threshold: float = 50.0, factor: float = 0.5, to: Sequence[str] = ("accruals", "gross_profit_assets"), keys: Sequence[str] = ()) -> DataFrame:
    """The same for non-banks that are not dear but had growth in its highest part and quality in its lowest in ``earlier`` scores."""
    had = stored(earlier.select(*keys, "ticker", "growth_score", "quality_score"), "earlier")
    limits = thresholds(had, {"g": ("growth_score", high), "q": ("quality_score", low)}, keys)
    trapped = meet(had, limits, keys).where((F.col("growth_score") >= F.col("g")) & (F.col("quality_score") <= F.col("q"))).select(*keys, "ticker", F.lit(True).alias("trapped"))
    out = meet(ranked, trapped, [*keys, "ticker"], "left").withColumn("dear", _dear(threshold, keys))
    on = F.coalesce("trapped", F.lit(False)) & ~F.col("is_bank") & ~F.col("dear")
    return _moved(out, on, to, factor, dimension, keys).drop("trapped", "dear")


def composite_raw(scored: DataFrame, weights: Mapping[str, float | Column]) -> Column:
    """Weighted mean of the category scores that are there; weights are numbers or columns."""
    used = {c: F.lit(w) if isinstance(w, (int, float)) else w for c, w in weights.items()}
    total = sum((F.when(F.col(f"{c}_score").isNotNull(), w).otherwise(F.lit(0.0)) for c, w in used.items()), F.lit(0.0))
    score = sum((F.coalesce(w * F.col(f"{c}_score"), F.lit(0.0)) for c, w in used.items()), F.lit(0.0))
    return F.when(total > 0, steady(score / total))


def metric_coverage(wide: DataFrame, dimension_rows: Sequence[tuple], metrics: Sequence[str]) -> tuple[Column, Column]:
    """Metrics present, and metrics that apply to the row's profile."""
    applies = {r[0]: r[5] for r in dimension_rows}
    used = {m: {"all": F.lit(True), "bank": F.col("is_bank"), "nonbank": ~F.col("is_bank")}[applies[m]] for m in metrics}
    present = sum((F.when(ok & F.col(m).isNotNull(), 1).otherwise(0) for m, ok in used.items()), F.lit(0))
    applicable = sum((F.when(ok, 1).otherwise(0) for ok in used.values()), F.lit(0))
    return present, applicable


def coverage_filter(wide: DataFrame, dimension_rows: Sequence[tuple], metrics: Sequence[str], least: float = 0.6) -> DataFrame:
    """Keep securities with at least ``least`` of the metrics that apply to them."""
    present, applicable = metric_coverage(wide, dimension_rows, metrics)
    out = wide.withColumn("present", present).withColumn("applicable", applicable)
    return out.where(F.col("present") >= F.greatest(F.lit(1), F.floor(F.col("applicable") * F.lit(least))))


def coverage_filter_simple(wide: DataFrame, metrics: Sequence[str], least: float = 0.6) -> DataFrame:
    present = sum((F.col(m).isNotNull().cast("int") for m in metrics), F.lit(0))
    return wide.withColumn("present", present).where(F.col("present") >= max(1, int(len(metrics) * least)))


def coverage_discount(score: Column, present: Column, applicable: Column, threshold: float = 0.8, rate: float = 0.15) -> Column:
    coverage = present / applicable
    return F.when(coverage < threshold, score * (1 - (F.lit(threshold) - coverage) * F.lit(rate))).otherwise(score)


def composite_percentile(scored: DataFrame, raw: str = "composite_raw", keys: Sequence[str] = ()) -> DataFrame:
    """Percentile of the raw composite, at two digits; null stays null."""
    scored = stored(scored, "raw")
    at = placed(counted(scored, keys, raw), keys, raw).select(*keys, raw, rounded(average_pct(), 2).alias("composite"))
    return meet(scored, at, [*keys, raw], "left")


def composite_sector_relative(scored: DataFrame, raw: str = "composite_raw", least: int = 3, keys: Sequence[str] = ()) -> DataFrame:
    by = [*keys, "sector"]
    scored = stored(scored.where(F.col(raw).isNotNull()), "raw")
    at = placed(counted(scored, by, raw), by, raw).select(*by, raw, F.when(F.col("total") < least, 50.0).otherwise(rounded(average_pct(), 2)).alias("composite"))
    return meet(scored, at, [*by, raw])


def contributions(scored: DataFrame, weights: Mapping[str, float | Column]) -> DataFrame:
    """Points that each category adds to the raw composite; 0 where it is missing."""
    used = {c: F.lit(w) if isinstance(w, (int, float)) else w for c, w in weights.items()}
    total = sum((F.when(F.col(f"{c}_score").isNotNull(), w).otherwise(F.lit(0.0)) for c, w in used.items()), F.lit(0.0))
    return scored.withColumns({f"{c}_contrib": F.coalesce(F.when(total > 0, rounded(F.col(f"{c}_score") * w / total, 2)), F.lit(0.0)) for c, w in used.items()})


def thresholds(scored: DataFrame, cuts: dict[str, tuple[str, float]], keys: Sequence[str] = ()) -> DataFrame:
    """One row (per key) of exact quantiles: name -> (column, q)."""
    columns = sorted({c for c, _ in cuts.values()})
    tall = scored.select(*keys, *columns).unpivot(list(keys), columns, "column", "value")
    at = placed(counted(tall, [*keys, "column"]), [*keys, "column"])
    return quantiles(at, {name: (F.col("column") == c, q) for name, (c, q) in cuts.items()}, keys)


def _with_thresholds(scored: DataFrame, cuts: dict[str, tuple[str, float]], keys: Sequence[str]) -> DataFrame:
    if all(name in scored.columns for name in cuts):
        return scored
    scored = stored(scored, "scores")
    return meet(scored, thresholds(scored, cuts, keys), keys)


def _votes(*conditions: Column) -> Column:
    return sum((F.coalesce(c.cast("int"), F.lit(0)) for c in conditions), F.lit(0))


VALUE_DIMS = ("quality", "momentum", "revisions")


def value_cuts(q: float = 0.3) -> dict[str, tuple[str, float]]:
    return {f"vt_{d}": (f"{d}_score", q) for d in VALUE_DIMS}


def growth_cuts(high: float = 0.7, low: float = 0.35) -> dict[str, tuple[str, float]]:
    return {"gt_growth": ("growth_score", high), "gt_quality": ("quality_score", low), "gt_revisions": ("revisions_score", low)}


def value_trap(scored: DataFrame, q: float = 0.3, keys: Sequence[str] = ()) -> DataFrame:
    """Two of quality, momentum and revisions in their lowest ``q``; and how far below, in percent."""
    dims = VALUE_DIMS
    out = _with_thresholds(scored, value_cuts(q), keys)
    flag = _votes(*[F.col(f"{d}_score") <= F.col(f"vt_{d}") for d in dims]) >= 2
    depth = [F.when(F.col(f"{d}_score").isNotNull() & (F.col(f"vt_{d}") > 0), F.greatest(F.lit(0.0), F.col(f"vt_{d}") - F.col(f"{d}_score")) / F.col(f"vt_{d}") * 100) for d in dims]
    n = sum((d.isNotNull().cast("int") for d in depth), F.lit(0))
    severity = F.when(flag, F.when(n > 0, rounded(sum((F.coalesce(d, F.lit(0.0)) for d in depth), F.lit(0.0)) / n, 1)).otherwise(F.lit(0.0))).otherwise(F.lit(0.0))
    return out.withColumns({"value_trap": flag, "value_trap_severity": severity}).drop(*[f"vt_{d}" for d in dims])


def growth_trap(scored: DataFrame, high: float = 0.7, low: float = 0.35, keys: Sequence[str] = ()) -> DataFrame:
    """Two of: growth in its highest part, quality low, revisions low; and how far beyond, in percent."""
    out = _with_thresholds(scored, growth_cuts(high, low), keys)
    flag = _votes(F.col("growth_score") >= F.col("gt_growth"), F.col("quality_score") <= F.col("gt_quality"), F.col("revisions_score") <= F.col("gt_revisions")) >= 2
    depth = [F.when(F.col("growth_score").isNotNull() & (F.col("gt_growth") < 100), F.greatest(F.lit(0.0), F.col("growth_score") - F.col("gt_growth")) / (F.lit(100.0) - F.col("gt_growth")) * 100)]
    depth += [F.when(F.col(f"{d}_score").isNotNull() & (F.col(f"gt_{d}") > 0), F.greatest(F.lit(0.0), F.col(f"gt_{d}") - F.col(f"{d}_score")) / F.col(f"gt_{d}") * 100) for d in ("quality", "revisions")]
    n = sum((d.isNotNull().cast("int") for d in depth), F.lit(0))
    severity = F.when(flag, F.when(n > 0, rounded(sum((F.coalesce(d, F.lit(0.0)) for d in depth), F.lit(0.0)) / n, 1)).otherwise(F.lit(0.0))).otherwise(F.lit(0.0))
    return out.withColumns({"growth_trap": flag, "growth_trap_severity": severity}).drop("gt_growth", "gt_quality", "gt_revisions")


def insufficient_data(scored: DataFrame) -> DataFrame:
    missing = F.col("quality_score").isNull() | F.col("momentum_score").isNull() | F.col("revisions_score").isNull()
    return scored.withColumn("insufficient_data", missing)


def rank_stocks(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rank 1 is the highest composite; ties share a rank; without composite there is no rank."""
    scored = stored(scored, "composites")
    at = placed(counted(scored, keys, "composite"), keys, "composite")
    at = at.select(*keys, "composite", (F.col("total") - F.col("below") - F.col("n") + 1).cast("int").alias("rank"))
    return meet(scored, at, [*keys, "composite"], "left")


def composite_and_rank(scored: DataFrame, raw: str = "composite_raw", keys: Sequence[str] = ()) -> DataFrame:
    """``composite_percentile`` and ``rank_stocks`` from one placing: rounding keeps the order of the raw composites."""
    at = placed(counted(scored, keys, raw), keys, raw).withColumn("composite", rounded(average_pct(), 2))
    same = Window.partitionBy(*keys, "composite")
    above = F.col("total") - F.max(F.col("below") + F.col("n")).over(same)
    return meet(scored, at.select(*keys, raw, "composite", (above + 1).cast("int").alias("rank")), [*keys, raw], "left")


def ranked_metrics(wide: DataFrame, dimension: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Tall percentiles with weights: winsorized, ranked by sector, F-score adjusted."""
    ranked = cleaned_ranks(to_tall(wide, metrics, keys=keys), keys=keys, dimension=F.broadcast(dimension))
    return piotroski_conditional(ranked, dimension, keys=keys)


def score_pipeline(
    wide: DataFrame,
    dimension: DataFrame,
    metrics: Sequence[str],
    weights: dict[str, float],
    keys: Sequence[str] = (),
    applies: Sequence[tuple] = METRICS,
    least_coverage: float = 0.6,
    optional: Mapping[str, Sequence[str]] = OPTIONAL,
    least_optional: float = 0.3,
    most_missing: float = 70.0,
    steepness: float | None = None,
    history: DataFrame | None = None,
    discount: bool = True,
) -> DataFrame:
    """The whole chain, one row per security that is covered.

    Steps: coverage filter, optional categories without data switched off, weights of sparse metrics
    given to others, winsorizing, sector percentiles, an optional logistic transform (``steepness``),
    category scores, the momentum weight by regime (``history``), composite with coverage discount,
    contributions, rank, traps. Metrics without any weight are not ranked. Weights are tables of a few
    dozen rows; the covered rows, their values and the category scores are stored once each.
    """
    wide = stored(coverage_filter(wide, applies, metrics, least_coverage), "covered")
    n = wide.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *[F.count(m).alias(m) for m in metrics])
    filled = stored(n.unpivot([*keys, "rows"], list(metrics), "metric", "filled"), "filled")
    spread = stored(reduced_weights(filled, dimension, most_missing, keys=keys), "metric-weights")
    used = [r[0] for r in applies if r[0] in metrics and (r[3] or r[4])]
    ranked = cleaned_ranks(to_tall(wide, used, keys=keys), keys=keys, dimension=spread)
    if steepness is not None:
        ranked = ranked.withColumn("pct", logistic(F.col("pct"), steepness))
    scored = category_scores(piotroski_conditional(ranked, spread, keys=keys), list(weights), keys)
    every = wide.select(*keys, *IDS, "present", "applicable")
    categories = stored(meet(every, scored.drop("sector", "is_bank"), [*keys, "ticker"], "left"), "categories")
    scored = meet(categories, category_weights_used(filled, categories, weights, optional, least_optional, history, keys), keys)
    columns = {c: F.col(f"w_{c}") for c in weights}
    scored = scored.withColumn("undiscounted", composite_raw(scored, columns))
    raw = coverage_discount(F.col("undiscounted"), F.col("present"), F.col("applicable")) if discount else F.col("undiscounted")
    scored = contributions(scored.withColumn("composite_raw", steady(raw)), columns).drop(*[f"w_{c}" for c in weights])
    scored = meet(composite_and_rank(scored, keys=keys), thresholds(categories, value_cuts() | growth_cuts(), keys), keys)
    return growth_trap(value_trap(insufficient_data(scored), keys=keys), keys=keys)


def reduced_weights(filled: DataFrame, dimension: DataFrame, most_missing: float = 70.0, of: Sequence[str] = REDUCIBLE, keys: Sequence[str] = ()) -> DataFrame:
    """filled(keys, rows, metric, filled): per metric its category, direction and weights.

    A metric of ``of`` that is missing beyond ``most_missing`` percent gives its generic weight to the
    others of ``of`` in its category, by their weights.
    """
    out = meet(filled, dimension, ["metric"]).withColumn("may", F.col("metric").isin(*of) & (F.col("generic") > 0))
    gone = F.col("may") & ((F.col("rows") - F.col("filled")) / F.col("rows") * 100 > most_missing)
    out = out.withColumn("gone", gone)
    by = Window.partitionBy(*keys, "category")
    freed, rest = F.sum(F.when(F.col("gone"), F.col("generic"))).over(by), F.sum(F.when(F.col("may") & ~F.col("gone"), F.col("generic"))).over(by)
    new = F.when(F.col("gone"), 0.0).when(F.col("may") & (freed > 0), rounded(F.col("generic") + freed * F.col("generic") / rest, 2)).otherwise(F.col("generic"))
    return out.withColumn("new", new).select(*keys, "metric", "category", "higher", F.col("new").alias("generic"), "bank")


def category_weights_used(filled: DataFrame, scored: DataFrame, weights: dict[str, float], optional: Mapping[str, Sequence[str]] = OPTIONAL, least: float = 0.3, history: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """One row per key with the weights w_<category>: optional categories whose metrics are filled below ``least`` give theirs to the others, then the momentum regime moves some."""
    of = lambda c, x: F.sum(F.when(F.col("metric").isin(*optional[c]), F.col(x)))
    out = filled.groupBy(*keys).agg(*[F.coalesce(of(c, "filled") / of(c, "rows") < least, F.lit(True)).alias(f"off_{c}") for c in optional])
    w = {c: F.lit(float(x)) for c, x in weights.items()}
    for c in optional:
        rest = sum((w[o] for o in w if o != c), F.lit(0.0))
        w = {o: F.when(F.col(f"off_{c}"), F.lit(0.0) if o == c else rounded(w[o] + w[c] * w[o] / rest, 2)).otherwise(w[o]) for o in w}
    out = out.select(*keys, *[x.alias(f"w_{c}") for c, x in w.items()])
    if history is None:
        return out
    regime = momentum_regime(scored, history, keys=keys).select(*keys, "regime")
    return regime_weights(meet(out, regime, keys)).drop("regime")


def regime_weights(weights: DataFrame, up: float = 1.15, down: float = 0.7) -> DataFrame:
    """weights(w_<category>, regime): a high regime gives a part of momentum's weight to quality and valuation in halves, a low one takes some from valuation."""
    m, q, v, is_ = F.col("w_momentum"), F.col("w_quality"), F.col("w_valuation"), F.col("regime")
    return weights.select(
        *[F.col(c) for c in weights.columns if c not in ("w_momentum", "w_quality", "w_valuation")],
        F.when(is_ == "high", rounded(m * down, 2)).when(is_ == "low", rounded(m * up, 2)).otherwise(m).alias("w_momentum"),
        F.when(is_ == "high", rounded(q + m * (1 - down) / 2, 2)).otherwise(q).alias("w_quality"),
        F.when(is_ == "high", rounded(v + m * (1 - down) / 2, 2)).when(is_ == "low", rounded(v - m * (up - 1), 2)).otherwise(v).alias("w_valuation"),
    )


def weights_check(weights: DataFrame, slack: float = 0.5) -> DataFrame:
    """Per profile and category: the sum, and whether it is 100 with no weight below 0."""
    out = weights.groupBy("profile", "category").agg(F.sum("weight").alias("total"), F.min("weight").alias("lowest"))
    return out.withColumn("valid", (F.abs(F.col("total") - 100) <= slack) & (F.col("lowest") >= 0))


def auto_disable_category(coverage: DataFrame, weights: DataFrame, optional: Sequence[str] = ("revisions", "investment"), least: float = 0.3) -> DataFrame:
    """coverage(category, coverage): optional categories below ``least`` lose their weight to the others, pro rata."""
    joined = weights.join(coverage, "category", "left")
    off = F.col("category").isin(*optional) & (F.coalesce("coverage", F.lit(0.0)) < least)
    kept = joined.withColumn("kept", F.when(off, 0.0).otherwise(F.col("weight")))
    everything = Window.partitionBy()
    return kept.withColumn("new_weight", rounded(F.col("kept") * F.sum("weight").over(everything) / F.sum("kept").over(everything), 2)).select("category", "weight", "coverage", "new_weight")


def auto_reduce_sparse_metric(missing: DataFrame, weights: DataFrame, most: float = 70.0) -> DataFrame:
    """missing(metric, missing_pct): weighted metrics beyond ``most`` lose their weight inside their category."""
    joined = weights.join(missing, "metric", "left")
    kept = joined.withColumn("kept", F.when((F.coalesce("missing_pct", F.lit(100.0)) > most) & (F.col("weight") > 0), 0.0).otherwise(F.col("weight")))
    by = Window.partitionBy("category")
    rest = F.sum("kept").over(by)
    new = F.when(rest > 0, rounded(F.col("kept") * F.sum("weight").over(by) / rest, 2)).otherwise(F.col("weight"))
    return kept.withColumn("new_weight", new).select("category", "metric", "weight", "missing_pct", "new_weight")


def momentum_regime(scored: DataFrame, history: DataFrame, least: int = 20, up: float = 1.15, down: float = 0.7, keys: Sequence[str] = ()) -> DataFrame:
    """Spread of momentum scores against the quartiles of its history(momentum_vol): high, low or normal, and the weight factor.

    A history has one row for each run, so its quartiles are taken by an aggregate.
    """
    now = scored.groupBy(*keys).agg(steady(F.stddev_samp("momentum_score")).alias("momentum_vol"))
    past = history.agg(F.count(F.lit(1)).alias("n"), quantile(F.col("momentum_vol"), 0.25).alias("p25"), quantile(F.col("momentum_vol"), 0.75).alias("p75"))
    regime = F.when(F.col("n") < least, "unknown").when(F.col("momentum_vol") > F.col("p75"), "high").when(F.col("momentum_vol") < F.col("p25"), "low").otherwise("normal")
    out = now.crossJoin(past).withColumn("regime", regime)
    return out.withColumn("factor", F.when(F.col("regime") == "high", down).when(F.col("regime") == "low", up).otherwise(1.0))

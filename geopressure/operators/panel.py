"""Operators on panels: one value per entity and month.

All take DataFrames and column names. A month is a DATE, its first day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geopressure.functions import exprs as X

SIGMA_FLOOR = 1e-9


def month_of(ts: str | Column) -> Column:
    """First day of the month."""
    return F.trunc(X.col(ts).cast("date"), "month")


def monthly(df: DataFrame, key: str, ts: str, value: str, how: str = "avg") -> DataFrame:
    """``key, month, value, n`` with the mean or exact median of the readings of a month."""
    agg = {"avg": F.avg, "median": F.median, "sum": F.sum}[how]
    rows = df.where(F.col(value).isNotNull())
    return rows.groupBy(key, month_of(ts).alias("month")).agg(agg(value).alias("value"), F.count("*").alias("n"))


def monthly_median(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Exact median and count of the readings of a month."""
    return monthly(df, key, ts, value, "median")


def climatology(df: DataFrame, key: str, ts: str, value: str, ref_from: str | None = None, ref_to: str | None = None) -> DataFrame:
    """Mean, sample deviation and count by entity and calendar month, over a reference period if given."""
    if ref_from:
        df = df.where(F.col(ts) >= F.lit(ref_from).cast("date"))
    if ref_to:
        df = df.where(F.col(ts) <= F.lit(ref_to).cast("date"))
    return df.groupBy(key, F.month(ts).alias("calendar_month")).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n")
    )


def standardise(value: Column, mean: Column, sd: Column) -> Column:
    """``(value - mean) / sd``; NULL where the deviation is unknown or degenerate."""
    return F.when(sd >= SIGMA_FLOOR, (value - mean) / sd)


def served(df: DataFrame, ts: str, start: str | None) -> DataFrame:
    """Rows from ``start`` on."""
    return df if start is None else df.where(F.col(ts) >= F.lit(start).cast("date"))


def seasonal_anomaly(df: DataFrame, key: str, ts: str, value: str, served_from: str | None = None) -> DataFrame:
    """Standardised anomaly ``z`` of a panel against the same calendar month over all its history.

    The climatology is a window over (entity, calendar month), so the panel is shuffled once and not
    joined with itself; the served window is cut afterwards.
    """
    w = Window.partitionBy(key, F.month(ts))
    out = df.select(
        key, ts, value, F.avg(value).over(w).alias("mean"), F.stddev_samp(value).over(w).alias("sd"), F.count(value).over(w).alias("n")
    )
    out = out.withColumn("z", standardise(F.col(value), F.col("mean"), F.col("sd")))
    return served(out, ts, served_from).select(key, ts, value, "z", "n")


def anomaly_against(df: DataFrame, clim: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """The same against a stored climatology (also the stream-static form)."""
    joined = df.withColumn("calendar_month", F.month(ts)).join(clim, [key, "calendar_month"])
    return joined.select(key, ts, value, standardise(F.col(value), F.col("mean"), F.col("sd")).alias("z"))


def normal_score(
    df: DataFrame, key: str, ts: str, value: str, min_years: int = 15, served_from: str | None = None
) -> DataFrame:
    """Weibull position by rank in the same calendar month and its normal quantile, with the class.

    NULL values take no part; fewer than ``min_years`` values in a calendar month give NULL scores.
    """
    rows = df.where(F.col(value).isNotNull())
    w = Window.partitionBy(key, F.month(ts))
    out = rows.select(
        key,
        ts,
        value,
        F.count(value).over(w).alias("n"),
        F.avg(value).over(w).alias("mean"),
        F.stddev_samp(value).over(w).alias("sd"),
        F.rank().over(w.orderBy(value)).alias("r"),
    )
    enough = F.col("n") >= min_years
    out = out.withColumn("z", F.when(enough, standardise(F.col(value), F.col("mean"), F.col("sd"))))
    out = out.withColumn("nqt", F.when(enough, X.probit(F.col("r") / (F.col("n") + 1))))
    out = out.withColumn("index_class", X.index_class("nqt"))
    return served(out, ts, served_from).select(key, ts, value, "n", "z", "nqt", "index_class")


def weighted_mean(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """``sum(value * weight) / sum(weight)`` over known values of positive weight, and their count."""
    rows = df.where(F.col(value).isNotNull() & (F.col(weight) > 0))
    return rows.groupBy(*keys).agg(
        (F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("value"), F.count("*").alias("n")
    )


def eligible_series(df: DataFrame, key: str, ts: str, min_years: float, served_from: str) -> DataFrame:
    """Series that span enough years and reach into the served window: key, first, last, years."""
    out = df.groupBy(key).agg(F.min(F.col(ts).cast("date")).alias("first"), F.max(F.col(ts).cast("date")).alias("last"))
    out = out.withColumn("years", F.datediff("last", "first") / 365.25)
    return out.where((F.col("years") >= min_years) & (F.col("last") >= F.lit(served_from).cast("date")))


def cap_history(df: DataFrame, key: str, ts: str, years: float) -> DataFrame:
    """Rows of at most ``years`` before the last date of their own series."""
    last = F.max(F.col(ts).cast("date")).over(Window.partitionBy(key))
    rows = df.withColumn("__last", last)
    return rows.where(F.col(ts).cast("date") >= F.date_sub("__last", round(years * 365.25))).drop("__last")


def append_new(new: DataFrame, coverage: DataFrame, key: str, ts: str) -> DataFrame:
    """Rows later than what ``coverage(key, covered_to)`` says is stored; keys it lacks come whole."""
    known = coverage.select(key, "covered_to")
    return new.join(known, key, "left").where(F.col("covered_to").isNull() | (F.col(ts) > F.col("covered_to"))).drop("covered_to")


def month_spine(df: DataFrame, ts: str) -> DataFrame:
    """Every month from the first to the last of a panel, one row each."""
    ends = df.agg(F.min(ts).alias("a"), F.max(ts).alias("b")).where("a is not null")
    return ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias(ts))


def latest_value(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """The value at the latest date of each entity, NULL values ignored."""
    known = df.where(F.col(value).isNotNull())
    return known.groupBy(key).agg(F.max_by(value, ts).alias(value), F.max(ts).alias(ts))


def latest_row(df: DataFrame, key: str, ts: str) -> DataFrame:
    """The whole row of the latest date of each entity; ties give the greatest row."""
    rest = [c for c in df.columns if c not in (key, ts)]
    best = df.groupBy(key).agg(F.max(F.struct(ts, *rest)).alias("r"))
    return best.select(key, "r.*")


def latest_period(df: DataFrame, ts: str) -> DataFrame:
    """The rows of the latest date of the whole table."""
    last = df.agg(F.max(ts).alias("__last"))
    return df.join(F.broadcast(last), F.col(ts) == F.col("__last")).drop("__last")


def top1(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def quantile_thresholds(df: DataFrame, value: str, quantiles: Sequence[float], fallback: Sequence[float]) -> DataFrame:
    """One row of rounded interpolated quantiles ``q1, q2, ...`` over a pooled column; a fallback if empty."""
    pooled = df.agg(F.percentile(value, F.array(*[F.lit(q) for q in quantiles])).alias("q"))
    return pooled.select(
        *[F.coalesce(F.bround(F.get("q", F.lit(i))), F.lit(float(fallback[i]))).alias(f"q{i + 1}") for i in range(len(quantiles))]
    )


def quantile_levels(df: DataFrame, score: str, gate: str, quantiles: Sequence[float] = X.QUANTILES) -> DataFrame:
    """Level 1 to 5 of a score by quantiles pooled over gated rows; NULL where the gate is not positive.

    The thresholds are a one-row table, so their broadcast does not grow with the data.
    """
    gated = df.where(F.col(gate) > 0)
    cuts = quantile_thresholds(gated, score, quantiles, X.FALLBACK_THRESHOLDS)
    out = df.crossJoin(F.broadcast(cuts))
    names = [f"q{i + 1}" for i in range(len(quantiles))]
    code = X.bin_by(score, [F.col(n) for n in names], range(1, len(names) + 2))
    out = out.withColumn("level_code", F.when(F.col(gate) > 0, code))
    return out.withColumn("level", F.get(F.array(*[F.lit(x) for x in X.LEVELS]), F.col("level_code") - 1)).drop(*names)


def months_of(df: DataFrame, ts: str) -> list[str]:
    """The months of a panel as ``YYYYMM``, in order; an error if there is none to pivot."""
    found = [r[0] for r in df.where(F.col(ts).isNotNull()).select(F.date_format(ts, "yyyyMM")).distinct().collect()]
    if not found:
        raise ValueError("the panel has no month to pivot")
    return sorted(found)


def pivot_months(df: DataFrame, key: str, ts: str, measures: dict[str, str], months: Sequence[str]) -> DataFrame:
    """One row per entity, one column ``prefix_YYYYMM`` for each month and measure (prefix to column)."""
    tag = F.date_format(ts, "yyyyMM")
    wide = df.withColumn("__m", tag).groupBy(key).pivot("__m", list(months))
    wide = wide.agg(*[F.max(c).alias(p) for p, c in measures.items()])
    if len(measures) == 1:
        (prefix,) = measures
        return wide.select(key, *[F.col(m).alias(f"{prefix}_{m}") for m in months])
    return wide.select(key, *[F.col(f"{m}_{p}").alias(f"{p}_{m}") for m in months for p in measures])


def pivot_attributes(df: DataFrame, key: str, attribute: str, value: str, spec: dict[str, tuple[str, str]], sentinel: str | None = None) -> DataFrame:
    """Attribute-value rows to typed columns; ``spec`` maps attribute to (column, type)."""
    raw = df.where(F.col(attribute).isin(list(spec))).groupBy(key).pivot(attribute, list(spec)).agg(F.max(value))
    out = [X.safe_cast(F.col(f"`{a}`"), kind).alias(name) for a, (name, kind) in spec.items()]
    if sentinel is None:
        return raw.select(key, *out)
    flags = df.groupBy(key).agg(F.bool_or(X.is_suppressed(value, sentinel)).alias("has_suppressed"))
    return flags.join(raw.select(key, *out), key, "left")


def level_histogram(df: DataFrame, ts: str, level: str) -> DataFrame:
    """Count of entities by month and level, all five levels as columns ``l1`` to ``l5``."""
    return df.groupBy(ts).agg(*[F.count_if(F.col(level) == i).alias(f"l{i}") for i in range(1, 6)])


def score_matrix(df: DataFrame, key: str, ts: str, score: str, gate: str) -> DataFrame:
    """One array of scores per entity over every month of the panel, gaps 0, limited to 0-255; and a flag."""
    spine = F.broadcast(month_spine(df, ts))
    whole = df.groupBy(key).agg((F.max(gate) > 0).alias("exposed")).crossJoin(spine)
    cells = whole.join(df.select(key, ts, score), [key, ts], "left")
    value = F.least(F.greatest(F.coalesce(F.col(score), F.lit(0)), F.lit(0)), F.lit(255)).cast("int")
    rows = cells.groupBy(key).agg(F.first("exposed").alias("exposed"), F.sort_array(F.collect_list(F.struct(ts, value.alias("v")))).alias("s"))
    return rows.select(key, "exposed", F.col("s.v").alias("scores"))


def calendar_matrix(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Year by month matrix of each entity: columns ``m1`` to ``m12``."""
    wide = df.withColumn("__m", F.month(ts)).groupBy(key, F.year(ts).alias("year")).pivot("__m", list(range(1, 13))).agg(F.max(value))
    return wide.select(key, "year", *[F.col(str(i)).alias(f"m{i}") for i in range(1, 13)])


def compare(df: DataFrame, key: str, ts: str, value: str, ids: Sequence) -> DataFrame:
    """Series of a few entities side by side: one row per month, one column per entity."""
    wide = df.where(F.col(key).isin(list(ids))).groupBy(ts).pivot(key, list(ids)).agg(F.max(value))
    return wide.select(ts, *[F.col(str(i)).alias(f"e{i}") for i in ids])


def distinct_values(df: DataFrame, c: str) -> DataFrame:
    return df.select(c).distinct().orderBy(c)

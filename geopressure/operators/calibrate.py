"""Past events: profiles, severities, and a pooled empirical distribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geopressure.functions import exprs as X

MIN_POOL, MAX_MONTHS, NATIONAL = 30, 24, "NAT"


def dedup_orders(orders: DataFrame, key: str, order: str, start: str, end: str) -> DataFrame:
    """One row per entity and order with its first start and last end."""
    return orders.groupBy(key, order).agg(F.min(start).alias(start), F.max(end).alias(end))


def order_profile(orders: DataFrame, key: str, order: str, start: str, end: str) -> DataFrame:
    """Per entity: number of orders, first start, last start, distinct sorted years, and the events."""
    one = dedup_orders(orders, key, order, start, end)
    event = F.struct(F.col(start).alias("start"), F.col(end).alias("end"), F.col(order).alias("order_id"), F.year(start).alias("year"))
    return one.groupBy(key).agg(
        F.count("*").alias("freq"),
        F.min(start).alias("first"),
        F.max(start).alias("last"),
        F.sort_array(F.collect_set(F.year(start))).alias("years"),
        F.sort_array(F.collect_list(event)).alias("events"),
    )


def explode_events(profile: DataFrame, key: str) -> DataFrame:
    return profile.select(key, F.explode("events").alias("e")).select(key, "e.*")


def peak_severity(events: DataFrame, series: DataFrame, key: str, ts: str, z: str, max_months: int = MAX_MONTHS) -> DataFrame:
    """Greatest severity ``-z`` over the months of each event's window; events without a month vanish.

    The window runs from the start's month to the end's month, both included, and begins at most
    ``max_months`` before the end's month. Its at most ``max_months + 1`` months are listed, so the join
    is an equi-join on entity and month; ``series`` is dated by the first day of each month.
    """
    last = F.trunc("end", "month")
    first = F.greatest(F.trunc("start", "month"), F.add_months(last, -max_months))
    listed = F.explode(F.sequence(F.least(first, last), last, F.expr("interval 1 month")))
    windows = events.where(first <= last).select(key, "order_id", listed.alias(ts))
    months = windows.join(series.select(key, ts, z).where(F.col(z).isNotNull()), [key, ts])
    return months.groupBy(key, "order_id").agg(F.max(X.severity(z)).alias("severity"))


#: Copies of the packed distribution, so that the points of one pool and range are spread.
SALTS = 8


def _reached(values: Column, v: Column) -> Column:
    """How many entries of a sorted array are at most ``v``, by bisection."""
    mid = lambda x: F.floor((x["lo"] + x["hi"]) / 2).cast("int")
    below = lambda x: (x["lo"] < x["hi"]) & (F.get(values, mid(x)) <= v)
    halve = lambda x, _: F.struct(
        F.when(below(x), mid(x) + 1).otherwise(x["lo"]).alias("lo"), F.when(below(x), x["hi"]).otherwise(mid(x)).alias("hi")
    )
    start = F.struct(F.lit(0).alias("lo"), F.size(values).alias("hi"))
    rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.size(values) + F.lit(1))).cast("int") + 1)
    return F.aggregate(rounds, start, halve, lambda x: x["lo"])


def pooled_ecdf(points: DataFrame, events: DataFrame, pool: str, min_pool: int = MIN_POOL, slices: int = 256) -> DataFrame:
    """``h``, ``n_events`` and ``pool_level`` for every row of ``points(pool, s, ...)``.

    ``h`` is the share of the pool's event severities that ``s`` reaches (ties count). A pool with
    fewer than ``min_pool`` events, or none, is replaced by the national one; an empty distribution
    gives NULL and 0.

    Events are counted once per pool and distinct severity, and these counts are cut into ranges at quantiles of the
    severities. A range is one packed row: its severities, their running counts and what lies below it. Points are
    neither sorted nor gathered by range: each joins the packed row of its pool and range, of which there are copies for skew, and finds its place there by
    bisection. So the tasks follow the points evenly, whatever values or pools they share.
    """
    counts = events.where("severity is not null").groupBy(pool, "severity").agg(F.count("*").alias("k"))
    sized = counts.groupBy(pool).agg(F.sum("k").alias("__n")).where(F.col("__n") >= min_pool).select(pool)
    national = counts.groupBy("severity").agg(F.sum("k").alias("k")).select(F.lit(NATIONAL).alias(pool), "severity", "k")
    steps = counts.join(sized, pool, "left_semi").unionByName(national)
    # One row of edges: its size is the parameter's.
    cuts = F.percentile_approx("severity", [i / slices for i in range(1, slices)], 100 * slices)
    edges = F.broadcast(national.agg(F.coalesce(F.array_distinct(cuts), F.array().cast("array<double>")).alias("__edges")))
    ranges = steps.crossJoin(edges).select(F.col(pool).alias("__pool"), "severity", "k", _reached(F.col("__edges"), F.col("severity")).alias("__range"))
    sorted_steps = F.array_sort(F.collect_list(F.struct("severity", "k")))
    packed = ranges.groupBy("__pool", "__range").agg(sorted_steps.alias("__steps"), F.sum("k").alias("__k"))
    # A pool has at most ``slices`` ranges, whatever its events; every one gets a row, so that a point finds what lies below it.
    every = packed.select("__pool").distinct().crossJoin(edges).select("__pool", F.explode(F.sequence(F.lit(0), F.size("__edges"))).alias("__range"))
    w = Window.partitionBy("__pool")
    running = lambda acc, x: F.array_append(acc, F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + x["k"])
    table = every.join(packed, ["__pool", "__range"], "left").select(
        "__pool",
        "__range",
        F.coalesce("__steps.severity", F.array().cast("array<double>")).alias("__at"),
        F.aggregate(F.coalesce("__steps", F.array().cast(packed.schema["__steps"].dataType)), F.array().cast("array<bigint>"), running).alias("__sum"),
        F.coalesce(F.sum("__k").over(w.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__below"),
        F.sum("__k").over(w).alias("__total"),
    )
    table = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = sized.select(F.col(pool), F.lit(True).alias("__own"))
    level = F.when(F.col("__own"), F.col(pool)).otherwise(F.lit(NATIONAL))
    rows = points.where("s is not null").join(own, pool, "left").withColumn("pool_level", level).drop("__own")
    placed = rows.crossJoin(edges).select(
        *rows.columns,
        _reached(F.col("__edges"), F.col("s")).alias("__range"),
        F.col("pool_level").alias("__pool"),
        F.pmod(F.xxhash64(*points.columns), F.lit(SALTS)).cast("int").alias("__salt"),
    )
    joined = placed.join(table, ["__pool", "__range", "__salt"], "left")
    inside = F.coalesce(F.get("__sum", _reached(F.col("__at"), F.col("s")) - 1), F.lit(0))
    share = F.try_divide((F.col("__below") + inside).cast("double"), F.col("__total").cast("double"))
    return joined.select(*rows.columns, share.alias("h"), F.coalesce("__total", F.lit(0)).alias("n_events"))

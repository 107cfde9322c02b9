"""Table contracts and data-quality expectations: each gives counts, none repairs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geopressure.operators.panel import SIGMA_FLOOR


def expect(df: DataFrame, table: str, **bad: Column) -> DataFrame:
    """``table, check, n_bad, n_rows``: rows for which each named condition holds, in one pass."""
    counts = df.agg(F.count("*").alias("n_rows"), *[F.count_if(c).alias(name) for name, c in bad.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("check"), F.col(name).alias("n_bad")) for name in bad]))
    return counts.select(F.lit(table).alias("table"), pairs.alias("c"), "n_rows").select("table", "c.check", "c.n_bad", "n_rows")


def orphans(a: DataFrame, b: DataFrame, on: str, b_on: str | None = None) -> DataFrame:
    """Rows of ``a`` whose key is not in ``b``."""
    keys = b.select(F.col(b_on or on).alias(on)).distinct()
    return a.join(keys, on, "left_anti")


def expect_no_orphans(a: DataFrame, b: DataFrame, on: str, table: str, check: str, b_on: str | None = None) -> DataFrame:
    keys = b.select(F.col(b_on or on).alias(on)).distinct().withColumn("__known", F.lit(True))
    return expect(a.join(keys, on, "left"), table, **{check: F.col("__known").isNull()})


def expect_one_value(df: DataFrame, c: str, table: str, check: str) -> DataFrame:
    """Distinct values of a column beyond the first: a label that should stand for a single code."""
    one = df.groupBy(c).agg(F.count("*").alias("n")).agg(F.count(c).alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))
    bad = F.greatest(F.col("k") - 1, F.lit(0).cast("long"))
    return one.select(F.lit(table).alias("table"), F.lit(check).alias("check"), bad.alias("n_bad"), "n_rows")


def expect_unique(df: DataFrame, keys: Sequence[str], table: str, check: str) -> DataFrame:
    """Rows beyond the first of each key."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n"))
    one = sizes.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_bad"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))
    return one.select(F.lit(table).alias("table"), F.lit(check).alias("check"), "n_bad", "n_rows")


def expect_some(df: DataFrame, good: Column, table: str, check: str) -> DataFrame:
    """Every row is bad where none is good: an input that was read but attached to nothing."""
    one = df.agg(F.count("*").alias("n_rows"), F.count_if(good).alias("k"))
    bad = F.when(F.col("k") > 0, F.lit(0).cast("long")).otherwise(F.col("n_rows"))
    return one.select(F.lit(table).alias("table"), F.lit(check).alias("check"), bad.alias("n_bad"), "n_rows")


def degenerate(sd: Column | str) -> Column:
    """Whether a deviation is unknown or too small to divide by."""
    c = F.col(sd) if isinstance(sd, str) else sd
    return c.isNull() | (c < SIGMA_FLOOR)


def all_expectations(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def profile(df: DataFrame, keys: Sequence[str], ts: str | None = None, values: Sequence[str] = ()) -> DataFrame:
    """One row: rows, distinct keys, first and last date, and per value its nulls, mean and deviation."""
    out = [F.count("*").alias("n_rows"), *[F.countDistinct(k).alias(f"distinct_{k}") for k in keys]]
    if ts:
        out += [F.min(ts).alias("first"), F.max(ts).alias("last")]
    for v in values:
        out += [F.count_if(F.col(v).isNull()).alias(f"null_{v}"), F.avg(v).alias(f"mean_{v}"), F.stddev_samp(v).alias(f"sd_{v}")]
    return df.agg(*out)


def observed(df: DataFrame, name: str, **bad: Column) -> tuple[DataFrame, object]:
    """``df`` and an Observation that counts while ``df`` is written, at no extra pass."""
    from pyspark.sql import Observation

    watch = Observation(name)
    return df.observe(watch, F.count("*").alias("n_rows"), *[F.count_if(c).alias(k) for k, c in bad.items()]), watch


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """``df`` itself; an explicit error if it is empty."""
    if df.isEmpty():
        raise ValueError(f"{what} has no rows")
    return df

"""Property transactions: one row each, single items only, robust prices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geopressure.functions import exprs as X

PRICE_BOUNDS = (200.0, 15000.0)


def one_row_per_transaction(lines: DataFrame, keys: Sequence[str], value: str, ts: str, wanted: Column, other: Column, size: str) -> DataFrame:
    """Value and date once per transaction, how many wanted and other premises, the wanted surface."""
    return lines.groupBy(*keys).agg(
        F.max(value).alias("value"),
        F.max(F.col(ts).cast("date")).alias("date"),
        F.count_if(wanted).alias("n_wanted"),
        F.count_if(other).alias("n_other"),
        F.sum(F.when(wanted, F.col(size))).alias("surface"),
    )


def single_items(transactions: DataFrame, bounds: tuple[float, float] = PRICE_BOUNDS) -> DataFrame:
    """Transactions of exactly one wanted item and nothing else at a plausible unit price."""
    priced = transactions.where("n_wanted = 1 and n_other = 0 and surface > 0").withColumn("unit_price", F.col("value") / F.col("surface"))
    return priced.where(F.col("unit_price").between(*bounds))


def exact_medians(df: DataFrame, key: str, values: Sequence[str], accuracy: int = 100_000) -> DataFrame:
    """``key`` and the exact median of each column, NULLs ignored, at any number of rows of a key.

    A sketch brackets the middle of every key; its error is at most one in ``accuracy`` ranks, and the
    bracket is four of these wide on each side. A second pass counts what lies below and, per distinct
    value, what lies inside, so partial counts are all that is shuffled and a key's task holds only the
    distinct values next to its median.
    """
    at = [0.5 - 4 / accuracy, 0.5 + 4 / accuracy]
    sketch = [F.struct(F.count(v).alias("n"), F.percentile_approx(v, at, accuracy).alias("b")).alias(v) for v in values]
    brackets = df.groupBy(key).agg(*sketch)
    named = F.explode(F.array(*[F.struct(F.lit(i).alias("__i"), F.col(v).cast("double").alias("__v")) for i, v in enumerate(values)]))
    rows = df.select(key, named.alias("__r")).select(key, "__r.*").where("__v is not null")
    bound = brackets.select(key, F.posexplode(F.array(*[F.col(v) for v in values])).alias("__i", "__s"))
    bound = bound.select(key, "__i", F.col("__s.n").alias("__n"), F.get("__s.b", F.lit(0)).cast("double").alias("__low"), F.get("__s.b", F.lit(1)).cast("double").alias("__high"))
    side = F.when(F.col("__v") < F.col("__low"), -1).when(F.col("__v") > F.col("__high"), 1).otherwise(0)
    placed = rows.join(bound, [key, "__i"]).select(key, "__i", "__n", side.alias("__side"), F.when(side == 0, F.col("__v")).alias("__v"))
    counts = placed.groupBy(key, "__i", "__n", "__side", "__v").agg(F.count("*").alias("__c"))
    inside = F.sort_array(F.collect_list(F.when(F.col("__side") == 0, F.struct(F.col("__v").alias("v"), F.col("__c").alias("c")))))
    below = F.coalesce(F.sum(F.when(F.col("__side") == -1, F.col("__c"))), F.lit(0))
    each = counts.groupBy(key, "__i", "__n").agg(inside.alias("__inside"), below.alias("__below"))

    def at_rank(rank: Column) -> Column:
        none = F.struct(F.col("__below").alias("seen"), F.lit(None).cast("double").alias("v"))
        here = lambda a, x: F.when((a["seen"] <= rank) & (rank < a["seen"] + x["c"]), x["v"]).otherwise(a["v"])
        return F.aggregate("__inside", none, lambda a, x: F.struct((a["seen"] + x["c"]).alias("seen"), here(a, x).alias("v")))["v"]

    middle = (at_rank(F.floor((F.col("__n") - 1) / 2)) + at_rank(F.floor(F.col("__n") / 2))) / 2
    found = each.select(key, "__i", middle.alias("__m"))
    wide = found.groupBy(key).agg(*[F.max(F.when(F.col("__i") == i, F.col("__m"))).alias(v) for i, v in enumerate(values)])
    return brackets.select(key).join(wide, key, "left")


def robust_price(items: DataFrame, key: str, months: int = 12) -> DataFrame:
    """Medians, counts, years and last date per entity; the trailing count ends at the table's last date. Items without an entity are left out."""
    last = items.agg(F.max("date").alias("__last"))
    rows = items.join(F.broadcast(last))
    medians = exact_medians(items, key, ["unit_price", "surface"])
    medians = medians.withColumnsRenamed({"unit_price": "median_price", "surface": "median_surface"})
    rest = rows.groupBy(key).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("date") >= F.add_months("__last", -months)).alias("n_recent"),
        F.min(F.year("date")).alias("first_year"),
        F.max(F.year("date")).alias("last_year"),
        F.max("date").alias("last_date"),
    )
    return medians.join(rest, key)


def trailing_count(df: DataFrame, key: str, ts: str, months: int = 12) -> DataFrame:
    """Rows of each key in the last months of the whole table."""
    last = df.agg(F.max(F.col(ts).cast("date")).alias("__last"))
    rows = df.select(key, F.col(ts).cast("date").alias("d")).join(F.broadcast(last))
    return rows.groupBy(key).agg(F.count_if(F.col("d") >= F.add_months("__last", -months)).alias("n"))


def price_profile(lines: DataFrame, keys: Sequence[str], entity: str, value: str, ts: str, wanted: Column, other: Column, size: str) -> DataFrame:
    """From lines to robust prices per entity; ``keys`` identify a transaction and include the entity."""
    lines = lines.where(X.col(value).isNotNull())
    return robust_price(single_items(one_row_per_transaction(lines, keys, value, ts, wanted, other, size)), entity)

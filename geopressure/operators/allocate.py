"""Group totals down to members, and shares within groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geopressure.functions import exprs as X


def allocate(members: DataFrame, group: str, total: Column | str, weight: Column) -> Column:
    """Part of the group's total by weight: NULL without a total, 0 where the group's weights sum to 0."""
    w = F.coalesce(weight, F.lit(0.0))
    whole = F.sum(w).over(Window.partitionBy(group))
    return F.when(whole > 0, X.col(total) * w / whole).otherwise(F.when(X.col(total).isNotNull(), 0.0))


def share_of(df: DataFrame, group: str, wanted: Column, value: str) -> DataFrame:
    """Share of the wanted rows in each group's total; NULL if no row is wanted or the total is 0."""
    return df.groupBy(group).agg(X.safe_div(F.sum(F.when(wanted, F.col(value))), F.sum(value)).alias("share"))


#: Construction periods counted as vulnerable (fixed values of the source tables).
VULNERABLE_PERIODS = ("<1919", "1919-1945", "1945-1970", "1970-1990")


def downscale(
    members: DataFrame, groups: DataFrame, periods: DataFrame, key: str, group: str, wanted: Sequence[str] = VULNERABLE_PERIODS
) -> DataFrame:
    """Exposed houses of each member and its group's vulnerable share.

    ``members(key, group, houses, share)``, ``groups(group, exposed, suppressed)``,
    ``periods(group, period, houses)``. A member without its group gets NULL houses.
    """
    part = share_of(periods, group, F.col("period").isin(list(wanted)), "houses").withColumnRenamed("share", "vulnerable_share")
    rows = members.join(groups.select(group, "exposed", "suppressed"), group, "left").join(part, group, "left")
    weight = F.coalesce("houses", F.lit(0.0)) * F.coalesce("share", F.lit(0.0))
    return rows.select(
        key,
        group,
        allocate(rows, group, "exposed", weight).alias("n_exposed"),
        "vulnerable_share",
        F.coalesce("suppressed", F.lit(False)).alias("suppressed"),
    )

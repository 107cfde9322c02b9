"""Stations to entities: containment, then key, then radius; and the entity index they give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopressure.functions import exprs as X
from geopressure.operators import geometry as G
from geopressure.operators.panel import weighted_mean


def attach_cascade(
    stations: DataFrame, polygons: DataFrame, entities: DataFrame, station: str, key: str, radius: float, tile: float, block: str | None = None
) -> DataFrame:
    """``station, key, factor, method`` from three disjoint stages.

    ``stations(station, key_hint, x, y)`` go to the polygon that holds them (``inside``), else to the
    entity that ``key_hint`` names (``key``): one entity each. An entity of
    ``entities(key, x, y)`` that hosts no station borrows the nearest within ``radius``, at a factor
    that falls with distance (``radius``).
    """
    inside = G.points_in_polygons(stations, polygons, station, key, tile, block)
    inside = inside.select(station, key, F.lit(1.0).alias("factor"), F.lit("inside").alias("method"))
    rest = stations.join(inside.select(station), station, "left_anti")
    named = rest.join(entities.select(F.col(key).alias("key_hint")), "key_hint", "left_semi")
    named = named.select(station, F.col("key_hint").alias(key), F.lit(1.0).alias("factor"), F.lit("key").alias("method"))
    hosted = inside.unionByName(named)
    lone = entities.join(hosted.select(key), key, "left_anti")
    lent = G.nearest_within(lone, stations, key, station, radius, block)
    return hosted.unionByName(lent.select(station, key, "factor", F.lit("radius").alias("method")))


def entity_index(panel: DataFrame, attached: DataFrame, station: str, key: str, ts: str, years: DataFrame) -> DataFrame:
    """Station scores to entities: means weighted by confidence, the greatest confidence, how many stations.

    A station counts in a month in which its z is known, for both means. ``panel(station, ts, z, nqt)``, ``attached`` as from :func:`attach_cascade`, ``years(station, years)``.
    """
    weight = X.confidence("years", distance=F.col("factor"))
    rows = panel.join(attached.join(years, station), station).withColumn("confidence", weight)
    z = weighted_mean(rows, [key, ts], "z", "confidence").select(key, ts, F.col("value").alias("z"))
    q = weighted_mean(rows.where("z is not null"), [key, ts], "nqt", "confidence").select(key, ts, F.col("value").alias("nqt"))
    used = rows.where(F.col("z").isNotNull() & (F.col("confidence") > 0)).groupBy(key, ts)
    most = used.agg(F.max("confidence").alias("confidence"), F.countDistinct(station).alias("n_stations"))
    return z.join(q, [key, ts], "left").join(most, [key, ts])


def areal_mean(panel: DataFrame, weights: DataFrame, cell: str, key: str, ts: str, value: str) -> DataFrame:
    """Cell panel to entity panel: means weighted by overlap and the number of cells."""
    return weighted_mean(panel.join(weights, cell), [key, ts], value, "weight").withColumnRenamed("value", value)

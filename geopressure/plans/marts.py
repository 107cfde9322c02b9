"""The monthly and the static mart, with optional inputs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopressure.functions import exprs as X
from geopressure.operators import geometry as G
from geopressure.operators.panel import latest_period, pivot_months, quantile_levels


def optional_left_join(df: DataFrame, other: DataFrame | None, on: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """Left join with the named columns, or typed NULLs where there is no such table or column."""
    if other is None:
        return df.withColumns({name: F.lit(None).cast(kind) for name, kind in columns.items()})
    have = [F.col(name).cast(kind).alias(name) if name in other.columns else F.lit(None).cast(kind).alias(name) for name, kind in columns.items()]
    return df.join(other.select(*on, *have), list(on), "left")


def enrich(spine: DataFrame, tables: Sequence[DataFrame | None], on: str) -> DataFrame:
    """A spine left-joined with each table on one key; absent tables are passed over."""
    for table in tables:
        if table is not None:
            spine = spine.join(table, on, "left")
    return spine


def monthly_mart(
    anomaly: DataFrame,
    exposures: DataFrame,
    key: str,
    ts: str,
    groundwater: DataFrame | None = None,
    calibration: DataFrame | None = None,
    gamma: float = X.GAMMA,
    gain: float = X.GAIN,
    store: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Tension, score, level, confidence, class and gated calibration of every entity and month.

    ``anomaly(key, ts, z)``, ``exposures(key, e)``, ``groundwater(key, ts, z_b, nqt, confidence)``,
    ``calibration(key, ts, h, n_events, pool_level)``. An entity without exposure counts as not exposed.
    Level and calibration are NULL where the exposure is not positive; the score is then 0. The scores are read twice, for the
    thresholds and for the levels: ``store`` may write them and return what reads them back, so that they are computed once.
    """
    rows = anomaly.select(key, ts, "z").join(exposures.select(key, "e"), key, "left").withColumn("e", F.coalesce("e", F.lit(0.0)))
    rows = optional_left_join(rows, groundwater, [key, ts], {"z_b": "double", "nqt": "double", "confidence": "double"})
    rows = optional_left_join(rows, calibration, [key, ts], {"h": "double", "n_events": "long", "pool_level": "string"})
    rows = rows.withColumns({"dry": X.dryness("z", gain), "dry_b": X.dryness("z_b", gain)})
    rows = rows.withColumn("w_b", X.blend_weight("dry_b", "confidence"))
    rows = rows.withColumn("t", X.blend("dry", "dry_b", "w_b"))
    rows = rows.withColumn("score", X.pressure_score("e", "t", gamma))
    rows = rows.withColumn("confidence_t", F.col("w_b") / (1 + F.col("w_b")))
    rows = rows.withColumn("groundwater_class", X.index_class("nqt"))
    rows = rows.withColumns({c: F.when(F.col("e") > 0, F.col(c)) for c in ("h", "n_events", "pool_level")})
    out = quantile_levels(store(rows) if store else rows, "score", "e")
    return out.select(
        key, ts, "e", "z", "t", "score", "level_code", "level", "confidence_t", "groundwater_class", "h", "n_events", "pool_level"
    )


def static_mart(
    entities: DataFrame,
    shares: DataFrame,
    stock: DataFrame | None,
    prices: DataFrame | None,
    changed: DataFrame | None,
    orders: DataFrame | None,
    monthly: DataFrame | None,
    key: str,
    ts: str,
) -> DataFrame:
    """One row per entity: exposure, exposed value, flags, order history, and the latest month's state."""
    out = entities.join(shares, key, "left")
    out = optional_left_join(out, stock, [key], {"vulnerable_share": "double", "n_exposed": "double", "suppressed": "boolean"})
    out = optional_left_join(out, prices, [key], {"median_price": "double", "median_surface": "double"})
    out = optional_left_join(out, changed, [key], {"class_before": "string", "class_after": "string", "reclassified": "boolean"})
    out = optional_left_join(out, orders, [key], {"freq": "long", "last": "date", "years": "array<int>"})
    now = None if monthly is None else latest_period(monthly, ts)
    out = optional_left_join(out, now, [key], {ts: "date", "score": "int", "level_code": "int", "level": "string", "t": "double", "h": "double"})
    return out.withColumns(
        {
            "e": X.exposure("share", "vulnerable_share"),
            "exposed_value": X.exposed_value("n_exposed", "median_surface", "median_price"),
            "reclassified": F.coalesce("reclassified", F.lit(False)),
            "suppressed": F.coalesce("suppressed", F.lit(False)),
            "freq": F.coalesce("freq", F.lit(0)),
            "years": F.coalesce("years", F.array().cast("array<int>")),
        }
    )


def reclassified(entities: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Whether and how each entity's class changed."""
    rows = changes.select(key, "class_before", "class_after", "kind", F.lit(True).alias("reclassified"))
    return entities.join(rows, key, "left").withColumn("reclassified", F.coalesce("reclassified", F.lit(False)))


def feature_table(mart: DataFrame, panel: DataFrame, key: str, ts: str, months: Sequence[str], kept: Sequence[str] = ()) -> DataFrame:
    """Map attributes: rounded statics, bins, and one level, tension-bin and score column per month.

    ``kept`` names further columns of the mart to carry.
    """
    rows = panel.withColumns({"n": F.coalesce("level_code", F.lit(0)), "tb": X.tension_bin("t"), "s": F.coalesce("score", F.lit(0))})
    wide = pivot_months(rows, key, ts, {"n": "n", "t": "tb", "s": "s"}, months)
    statics = mart.select(
        key, *kept, F.round("e", 4).alias("e"), X.exposure_bin("e").alias("e_bin"), F.round("exposed_value").alias("exposed_value")
    )
    return statics.join(wide, key, "left")


def map_features(features: DataFrame, polygons: DataFrame, key: str, rings: str = "rings") -> DataFrame:
    """Feature rows with their geometry in degrees; entities without a polygon have no place on the map.

    ``polygons(key, rings)`` are in metres, one row per part; only parts of entities in ``features`` are converted.
    """
    parts = polygons.join(features.select(key).distinct(), key, "left_semi").select(key, G.rings_to_degrees(rings).alias("rings"))
    return features.join(G.multipolygons(parts, key, "rings"), key)

"""Lookups and search over the marts, for any number of keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geopressure.functions import exprs as X
from geopressure.operators import geometry as G
from geopressure.operators.panel import latest_row, latest_value, level_histogram, quantile_thresholds
from geopressure.plans.marts import optional_left_join
from geopressure.sources.io import attach_freshness


def select_tolerant(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The named columns, typed NULL where the table has none."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(kind).alias(c) for c, kind in columns.items()])


def entity_card(static: DataFrame, panel: DataFrame, key: str, ts: str, ids: Sequence | None = None, month: str | None = None) -> DataFrame:
    """Static row with the dynamics of a month, by default each entity's own latest."""
    if ids is not None:
        static, panel = static.where(F.col(key).isin(list(ids))), panel.where(F.col(key).isin(list(ids)))
    now = latest_row(panel, key, ts) if month is None else panel.where(F.col(ts) == F.lit(month).cast("date"))
    return static.join(now, key, "left")


def entity_series(panel: DataFrame, key: str, ts: str, ids: Sequence) -> DataFrame:
    """Series of the given entities in order of date."""
    return panel.where(F.col(key).isin(list(ids))).orderBy(key, ts)


def at_month(panel: DataFrame, ts: str, month: str) -> DataFrame:
    """All entities at one month."""
    return panel.where(F.col(ts) == F.lit(month).cast("date"))


def summary(static: DataFrame, panel: DataFrame, key: str, ts: str) -> DataFrame:
    """One row of counts, totals and the period served."""
    a = static.agg(
        F.count("*").alias("n_entities"),
        F.count_if(F.col("e") > 0).alias("n_exposed"),
        F.sum("exposed_value").alias("total_value"),
        F.count_if("reclassified").alias("n_reclassified"),
    )
    b = panel.agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.countDistinct(ts).alias("n_months"))
    return a.crossJoin(b)


def metadata(static: DataFrame, panel: DataFrame, key: str, ts: str, manifests: DataFrame, sources: Sequence[str]) -> DataFrame:
    """One row: the summary, entities with a known value, freshness by source, and the level thresholds in use."""
    known = static.agg(F.count("exposed_value").alias("n_with_value"))
    cuts = quantile_thresholds(panel.where("e > 0"), "score", X.QUANTILES, X.FALLBACK_THRESHOLDS)
    one = summary(static, panel, key, ts).crossJoin(known).crossJoin(cuts)
    return attach_freshness(one, manifests, sources)


def locate(points: DataFrame, edges: DataFrame, point_key: str, key: str, tile: float, digits: int = 6) -> DataFrame:
    """Entity that holds each point given in degrees (``lon``, ``lat``).

    The projection moves a point by about 1e-9 metres, which would put a point of a border on either side of it, so metres
    are rounded to ``digits``.
    """
    x, y = (F.round(c, digits) for c in X.to_lambert93("lon", "lat"))
    return G.points_in_polygons(points.withColumns({"x": x, "y": y}), edges, point_key, key, tile)


def count_high(panel: DataFrame, ts: str, level: str = "level_code", least: int = 4) -> DataFrame:
    """Entities at a level or above, by month."""
    return level_histogram(panel, ts, level).select(ts, sum(F.col(f"l{i}") for i in range(least, 6)).alias("n_high"))


def search_index(
    entities: DataFrame,
    key: str,
    name: str,
    postcodes: DataFrame | None,
    panel: DataFrame | None,
    ts: str,
    edges: DataFrame | None = None,
    sub_units: Sequence[tuple[str, str, str]] = X.SUB_UNITS,
) -> DataFrame:
    """Folded name, department, bounding box in degrees, sorted distinct postcodes (sub-units rolled up) and
    latest level of each entity.

    The department is read from the key unless ``entities`` has a column ``dept``; the box is NULL without ``edges``.
    Keys that are not codes of municipalities have no ``sub_units``.
    """
    out = entities.withColumn("folded", X.fold(name))
    if "dept" not in entities.columns:
        out = out.withColumn("dept", X.dept_of(F.col(key).cast("string")))
    box = None if edges is None else G.extent_in_degrees(edges, [key])
    out = optional_left_join(out, box, [key], dict.fromkeys(("xmin", "ymin", "xmax", "ymax"), "double"))
    if postcodes is None:
        out = out.withColumn("postcodes", F.array().cast("array<string>"))
    else:
        rolled = postcodes.where("postcode <> ''").select(X.rollup_code(key, sub_units).alias(key), "postcode")
        codes = rolled.groupBy(key).agg(F.sort_array(F.collect_set("postcode")).alias("postcodes"))
        out = out.join(codes, key, "left").withColumn("postcodes", F.coalesce("postcodes", F.array().cast("array<string>")))
    if panel is None:
        return out.withColumn("level", F.lit(0))
    level = latest_value(panel, key, ts, "level_code").select(key, F.col("level_code").alias("level"))
    return out.join(level, key, "left").withColumn("level", F.coalesce("level", F.lit(0)))


def write_search_index(index: DataFrame, key: str, panel: DataFrame, ts: str, path: str, level: str = "level_code") -> None:
    """The index, one folder per department, in ``path/index``; months with their level counts in ``path/levels``.

    Rows are ranged by department and key, so a large department is written by several tasks.
    """
    index.repartitionByRange("dept", key).write.mode("overwrite").partitionBy("dept").parquet(f"{path}/index")
    level_histogram(panel.where(F.col(level) >= 1), ts, level).write.mode("overwrite").parquet(f"{path}/levels")


MAX_ERRORS = 2


def _deletions(word: Column) -> Column:
    """A word of four letters or more and what is left of it without one letter; from eight letters on, without two."""
    without = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    one = without(word)
    two = F.when(F.length(word) >= 8, F.flatten(F.transform(one, without))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(word), one, two))


def _near_words(terms: DataFrame, words: DataFrame, fuzzy: float) -> DataFrame:
    """``term, w, begins``: words that begin with a term, or lie within its edit distance.

    Both are equi-joins of distinct words: on every beginning of a word, and on what deletions leave of
    both sides, which two words within the distance always share.
    """
    heads = F.explode(F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.substring(F.col("w"), F.lit(1), i)))
    begins = words.select("w", heads.alias("term")).join(terms, "term").select("term", "w", F.lit(1).alias("begins"))
    errors = F.least(F.floor(fuzzy * F.length("term")), F.lit(MAX_ERRORS))
    asked = terms.where((errors > 0) & ~F.col("term").rlike("^[0-9]+$")).select("term", F.explode(_deletions(F.col("term"))).alias("left"))
    known = words.where(F.length("w") >= 4).select("w", F.explode(_deletions(F.col("w"))).alias("left"))
    close = known.join(asked, "left").select("term", "w").distinct().where(F.levenshtein("w", "term") <= errors)
    return begins.unionByName(close.withColumn("begins", F.lit(0))).groupBy("term", "w").agg(F.max("begins").alias("begins"))


def search(index: DataFrame, queries: DataFrame, key: str, k: int = 8, fuzzy: float = 0.2) -> DataFrame:
    """Up to ``k`` entities for each row of ``queries(query)``.

    Best first: 1 exact key, 2 exact postcode, 3 by how many of the query's words the entity matches,
    then how many of those as beginnings, then name, then key. A word of the query matches a word of
    the name or a postcode that begins with it, or, unless it is a number, a word within an edit
    distance of ``fuzzy`` times its length, at most ``MAX_ERRORS``.
    """
    asked = queries.select("query", X.fold("query").alias("f"))
    score = [F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_begins")]
    by_key = asked.join(index.select(key, "folded", F.lower(F.col(key).cast("string")).alias("f")), "f")
    by_key = by_key.select("query", key, "folded", F.lit(1).alias("rank"), *score)
    codes = index.select(key, "folded", F.explode("postcodes").alias("f"))
    by_code = asked.join(codes, "f").select("query", key, "folded", F.lit(2).alias("rank"), *score)
    terms = asked.select("query", F.explode(F.split("f", " ")).alias("term")).where("term <> ''").distinct()
    parts = F.explode(F.array_distinct(F.concat(F.split("folded", " "), "postcodes")))
    words = index.select(key, "folded", parts.alias("w")).where("w <> ''")
    near = _near_words(terms.select("term").distinct(), words.select("w").distinct(), fuzzy)
    met = terms.join(near, "term").join(words, "w").groupBy("query", key, "term").agg(F.max("begins").alias("begins"), F.first("folded").alias("folded"))
    by_word = met.groupBy("query", key).agg(F.first("folded").alias("folded"), F.count("*").alias("n_words"), F.sum("begins").alias("n_begins"))
    by_word = by_word.withColumn("rank", F.lit(3))
    every = by_key.unionByName(by_code).unionByName(by_word)
    best = every.groupBy("query", key).agg(
        F.min("rank").alias("rank"), F.first("folded").alias("folded"), F.max("n_words").alias("n_words"), F.max("n_begins").alias("n_begins")
    )
    order = Window.partitionBy("query").orderBy("rank", F.desc("n_words"), F.desc("n_begins"), "folded", key)
    placed = best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return placed.select("query", key, "rank", "n_words", "n_begins", "place")

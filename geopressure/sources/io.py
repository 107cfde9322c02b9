"""Sources and sinks: delimited text in its variants, NDJSON, GeoJSON, WKB, manifests.

Text columns are read as strings with a fixed schema and cast later, so no read infers anything.
"""

from __future__ import annotations

import csv
import struct
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def write_table(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Replace a table; partitioned tables replace only the partitions that ``df`` holds."""
    out = df.write.mode("overwrite")
    if by:
        out = out.partitionBy(*by).option("partitionOverwriteMode", "dynamic")
    out.parquet(path)


def _strings(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def header_of(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> list[str]:
    """Column names of a delimited file, quotes and the first mark removed."""
    first = spark.read.option("encoding", encoding).csv(path, sep=sep, quote='"', escape='"', header=False).limit(1).collect()
    return [str(c).lstrip("﻿#").strip() for c in first[0]] if first else []


def read_delimited(spark: SparkSession, path: str, sep: str = ",", columns: Sequence[str] | None = None, encoding: str = "UTF-8") -> DataFrame:
    """Delimited text with a header, every column a string; gzip and globs as Spark reads them."""
    names = list(columns) if columns else header_of(spark, path, sep, encoding)
    return spark.read.schema(_strings(names)).csv(
        path, sep=sep, header=True, quote='"', escape='"', encoding=encoding, enforceSchema=True, multiLine=False
    )


def _first_lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The first row of each run of one path: rows of a file's first block come in order."""
    last = None
    for frame in frames:
        new = frame["path"] != frame["path"].shift(fill_value=last or "")
        last = frame["path"].iloc[-1] if len(frame) else last
        yield frame.loc[new, ["path", "value"]]


def read_union_by_name(spark: SparkSession, paths: Sequence[str], sep: str = ",") -> DataFrame:
    """Files whose columns differ in order or number, united by name; absent columns are NULL.

    One job reads the first line of every file; files of one header are then read together, in as many
    reads as there are distinct headers.
    """
    lines = spark.read.text(list(paths)).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    heads = lines.where("start = 0").mapInPandas(_first_lines, "path string, value string").collect()
    groups: dict[tuple[str, ...], list[str]] = defaultdict(list)
    for head in sorted(heads):
        names = next(csv.reader([head.value], delimiter=sep))
        groups[tuple(str(c).lstrip("﻿#").strip() for c in names)].append(head.path)
    parts = [
        spark.read.schema(_strings(names)).csv(group, sep=sep, header=True, quote='"', escape='"') for names, group in groups.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_positional(spark: SparkSession, path: str, columns: Sequence[str], sep: str = ";", comment: str = "#") -> DataFrame:
    """Headerless text with comment lines, columns by position."""
    return spark.read.schema(_strings(columns)).csv(path, sep=sep, header=False, comment=comment)


def read_latin1(spark: SparkSession, path: str, columns: Sequence[str], sep: str = ";") -> DataFrame:
    """Latin-1 text whose header line is replaced by forced names."""
    return spark.read.schema(_strings(columns)).csv(path, sep=sep, header=True, encoding="ISO-8859-1", enforceSchema=True)


def read_ndjson(spark: SparkSession, path: str | Sequence[str], schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


FEATURE = "type string, properties map<string, string>, geometry struct<type: string, coordinates: string>"
GEOJSON = f"type string, features array<struct<{FEATURE}>>"


def read_geojson_features(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``feature, part, properties, rings``: one row per polygon of each feature, rings as arrays of points.

    A document with a collection of features is read whole by one task; with ``lines`` every line is a
    feature, as ``write_geojson_lines`` writes them, and large files are split among tasks.
    """
    if lines:
        features = spark.read.schema(FEATURE).json(path).select(F.struct("properties", "geometry").alias("f"))
    else:
        features = spark.read.schema(GEOJSON).json(path, multiLine=True).select(F.explode("features").alias("f"))
    rows = features.select(F.monotonically_increasing_id().alias("feature"), "f.properties", "f.geometry.type", "f.geometry.coordinates")
    single = F.from_json("coordinates", "array<array<array<double>>>")
    many = F.from_json("coordinates", "array<array<array<array<double>>>>")
    polygons = F.when(F.col("type") == "Polygon", F.array(single)).when(F.col("type") == "MultiPolygon", many)
    parts = rows.withColumn("p", polygons).where("p is not null").select("feature", "properties", F.posexplode("p").alias("part", "p"))
    points = lambda ring: F.transform(ring, lambda xy: F.struct(xy[0].alias("x"), xy[1].alias("y")))
    return parts.select("feature", "part", "properties", F.transform("p", points).alias("rings"))


def write_geojson_lines(df: DataFrame, path: str, properties: Sequence[str], geometry: str) -> None:
    """One GeoJSON feature a line; ``geometry`` is a struct of type and coordinates."""
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), F.col(geometry).alias("geometry"))
    df.select(F.to_json(feature).alias("value")).write.mode("overwrite").text(path)


def write_params(df: DataFrame, path: str) -> None:
    """A one-row table of parameters as JSON text."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


# --- WKB -------------------------------------------------------------------------------------

EDGES = "part int, ring int, x1 double, y1 double, x2 double, y2 double"


def parse_wkb(data: bytes) -> list[list[list[tuple[float, float]]]]:
    """Polygons of a WKB Polygon or MultiPolygon, each a list of rings; others give none."""

    def geometry(at: int) -> tuple[list, int]:
        order = "<" if data[at] == 1 else ">"
        kind = struct.unpack_from(order + "I", data, at + 1)[0]
        at += 5
        if kind & 0x20000000:
            at += 4
        kind &= 0xFFFF
        if kind % 1000 == 3:
            size = 8 * (2 + (kind // 1000 in (1, 2)) + 2 * (kind // 1000 == 3))
            (count,) = struct.unpack_from(order + "I", data, at)
            at, rings = at + 4, []
            for _ in range(count):
                (n,) = struct.unpack_from(order + "I", data, at)
                at += 4
                rings.append([struct.unpack_from(order + "dd", data, at + size * i) for i in range(n)])
                at += size * n
            return [rings], at
        if kind % 1000 == 6:
            (count,) = struct.unpack_from(order + "I", data, at)
            at, polygons = at + 4, []
            for _ in range(count):
                got, at = geometry(at)
                polygons += got
            return polygons, at
        return [], len(data)

    return geometry(0)[0] if data else []


def build_wkb(polygons: list[list[list[tuple[float, float]]]]) -> bytes:
    """WKB of one polygon, or of several as a MultiPolygon."""

    def polygon(rings: list) -> bytes:
        body = b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<dd", *p) for p in r) for r in rings)
        return struct.pack("<BII", 1, 3, len(rings)) + body

    if len(polygons) == 1:
        return polygon(polygons[0])
    return struct.pack("<BII", 1, 6, len(polygons)) + b"".join(map(polygon, polygons))


def wkb_to_edges(df: DataFrame, key: str, geom: str) -> DataFrame:
    """Directed edges of every WKB geometry: ``key, part, ring, x1, y1, x2, y2``."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (ident, part, ring, *a, *b)
                for ident, data in zip(pdf[key], pdf[geom], strict=True)
                if data is not None
                for part, rings in enumerate(parse_wkb(bytes(data)))
                for ring, points in enumerate(rings)
                for a, b in zip(points, points[1:], strict=False)
            ]
            yield pd.DataFrame(rows, columns=[key, "part", "ring", "x1", "y1", "x2", "y2"])

    return df.select(key, geom).mapInPandas(run, f"`{key}` {kind}, {EDGES}")


def rings_to_wkb(df: DataFrame, key: str, rings: str) -> DataFrame:
    """WKB polygons of rows of ``array<array<struct<x, y>>>``."""

    @F.pandas_udf("binary")
    def encode(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else build_wkb([[[(p["x"], p["y"]) for p in ring] for ring in v]]))

    return df.select(key, encode(rings).alias("geom_wkb"))


# --- header aliases, editions, manifests -----------------------------------------------------


def resolve_columns(df: DataFrame, aliases: dict[str, Sequence[str]]) -> DataFrame:
    """Columns under their canonical names; an error that names what is missing."""
    have = {c.strip().lower(): c for c in df.columns}
    found = {name: next((have[a.lower()] for a in options if a.lower() in have), None) for name, options in aliases.items()}
    if missing := [f"{name} (one of {', '.join(aliases[name])})" for name, c in found.items() if c is None]:
        raise ValueError(f"missing columns: {'; '.join(missing)}; there are: {', '.join(df.columns)}")
    return df.select(*[F.col(f"`{c}`").alias(name) for name, c in found.items()])


def domain_codes(text: str | None) -> list[str]:
    """Codes of a comma-separated list, trimmed, upper-cased, without repeats; blank means all (none listed)."""
    return list(dict.fromkeys(c.strip().upper() for c in (text or "").split(",") if c.strip()))


def bound_to(df: DataFrame, c: str, codes: Sequence[str]) -> DataFrame:
    """Rows of the listed codes, all rows if none is listed."""
    return df.where(F.col(c).isin(list(codes))) if codes else df


def latest_edition(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row of each key by the given columns, descending."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def dataset_manifest(spark: SparkSession, path: str, version: str | None = None, rows: DataFrame | None = None) -> DataFrame:
    """``name, bytes, sha256, modified, version, fetched, n_rows`` of every file below a path.

    Contents are hashed one file at a time in the tasks, each of at most two gigabytes. ``fetched`` is
    the time of the query, ``version`` what the source calls its edition, ``n_rows`` what ``rows``, a frame that reads these files, got from
    each (0 where it got none; null without such a frame). Files without a byte are not listed.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    counted = None if rows is None else row_counts(rows)
    found = files.select(
        _one_form(F.col("path")).alias("path"),
        name.alias("name"),
        F.col("length").alias("bytes"),
        F.sha2("content", 256).alias("sha256"),
        F.col("modificationTime").alias("modified"),
        F.lit(version).cast("string").alias("version"),
        F.current_timestamp().alias("fetched"),
    )
    if counted is None:
        return found.drop("path").withColumn("n_rows", F.lit(None).cast("long"))
    joined = found.join(counted.drop("name"), "path", "left").drop("path")
    return joined.withColumn("n_rows", F.coalesce("n_rows", F.lit(0)).cast("long"))


def _one_form(path: Column) -> Column:
    """A local path with one slash after its scheme, however it was given."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def row_counts(df: DataFrame) -> DataFrame:
    """``path, name, n_rows`` of each file that a file-based frame reads; files of unlike folders can share a name."""
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    counted = df.groupBy(_one_form(path).alias("path")).agg(F.count("*").alias("n_rows"))
    return counted.withColumn("name", F.element_at(F.split("path", "/"), -1))


def attach_freshness(df: DataFrame, manifests: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Column ``last_updated_<source>`` with the newest fetch date of each source.

    The lookup is one row with a column per named source.
    """
    rows = manifests.agg(*[F.max(F.when(F.col("source") == s, F.col("fetched"))).alias(f"last_updated_{s}") for s in sources])
    return df.crossJoin(F.broadcast(rows))

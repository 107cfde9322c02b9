"""Readers, sinks and streams on files written by the test."""

import datetime as dt
import gzip
import hashlib
import json
import struct

import pytest
from pyspark.sql import functions as F

from geopressure.functions import exprs as X
from geopressure.operators import geometry, panel
from geopressure.plans import catalog
from geopressure.sources import io
from geopressure.streaming import stream


def test_delimited_variants(spark, tmp_path):
    (tmp_path / "a.csv").write_text('code;"name"\n01053;"a;b"\n2A004;\n')
    got = io.read_delimited(spark, str(tmp_path / "a.csv"), ";").collect()
    assert [(r.code, r.name) for r in got] == [("01053", "a;b"), ("2A004", None)]
    (tmp_path / "z").mkdir()
    for n in (1, 2):
        with gzip.open(tmp_path / "z" / f"{n}.csv.gz", "wt") as f:
            f.write(f"k,v\n{n},x\n")
    assert io.read_delimited(spark, str(tmp_path / "z" / "*.csv.gz"), columns=["k", "v"]).count() == 2
    (tmp_path / "grid.txt").write_text("# head\n#more\n1;641374;7106309\n")
    assert io.read_positional(spark, str(tmp_path / "grid.txt"), ["cell", "x", "y"]).first().y == "7106309"
    (tmp_path / "l1.csv").write_bytes("#code;nom\n1;Sète\n".encode("latin-1"))
    assert io.read_latin1(spark, str(tmp_path / "l1.csv"), ["code", "name"]).first().name == "Sète"
    (tmp_path / "b.csv").write_text("name;code;extra\nx;9;1\n")
    both = io.read_union_by_name(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], ";")
    assert {(r.code, r.name, r.extra) for r in both.collect()} == {("01053", "a;b", None), ("2A004", None, None), ("9", "x", "1")}


def test_header_aliases(spark):
    df = spark.createDataFrame([("1", "x")], "id_gaspar string, Code_Commune string")
    out = io.resolve_columns(df, {"order": ["cod_nat_catnat", "id_gaspar"], "code": ["code_commune"]})
    assert out.columns == ["order", "code"]
    with pytest.raises(ValueError, match="start"):
        io.resolve_columns(df, {"start": ["dat_deb"]})


def test_geojson_and_wkb(spark, tmp_path):
    square = [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"NIVEAU": "2"}, "geometry": {"type": "Polygon", "coordinates": square}},
        {"type": "Feature", "properties": {"NIVEAU": "3"}, "geometry": {"type": "MultiPolygon", "coordinates": [square, square]}},
    ]}
    (tmp_path / "f.geojson").write_text(json.dumps(doc, indent=1))
    got = io.read_geojson_features(spark, str(tmp_path / "f.geojson"))
    assert sorted((r.properties["NIVEAU"], r.part) for r in got.collect()) == [("2", 0), ("3", 0), ("3", 1)]
    edges = geometry.rings_to_edges(got, ["feature", "part"], "rings")
    assert {r.area for r in geometry.polygon_area(edges, ["feature", "part"]).collect()} == {4.0}
    wkb = io.rings_to_wkb(got.withColumn("id", F.concat_ws("-", "feature", "part")), "id", "rings")
    back = io.wkb_to_edges(wkb, "id", "geom_wkb")
    assert {r.area for r in geometry.polygon_area(back, ["id"]).collect()} == {4.0}
    big = struct.pack(">BII", 0, 3, 1) + struct.pack(">I", 4) + b"".join(struct.pack(">dd", *p) for p in ((0, 0), (1, 0), (1, 1), (0, 0)))
    assert len(io.parse_wkb(big)[0][0]) == 4 and io.parse_wkb(io.build_wkb(io.parse_wkb(big) * 2)) == io.parse_wkb(big) * 2
    feature = spark.createDataFrame([("a", 1.5)], "k string, e double").withColumn("g", F.struct(F.lit("Point").alias("type"), F.array(F.lit(1.0), F.lit(2.0)).alias("coordinates")))
    io.write_geojson_lines(feature, str(tmp_path / "lines"), ["k", "e"], "g")
    line = json.loads(spark.read.text(str(tmp_path / "lines")).first().value)
    square = F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0))])
    shape = F.struct(F.lit("MultiPolygon").alias("type"), F.array(F.array(square), F.array(square, square)).alias("coordinates"))
    io.write_geojson_lines(feature.withColumn("g", shape), str(tmp_path / "shapes"), ["k"], "g")
    parts = io.read_geojson_features(spark, str(tmp_path / "shapes"), lines=True).collect()
    assert {(p.part, p.properties["k"], len(p.rings), p.rings[0][1].x) for p in parts} == {(0, "a", 1, 1.0), (1, "a", 2, 1.0)}
    assert line == {"type": "Feature", "properties": {"k": "a", "e": 1.5}, "geometry": {"type": "Point", "coordinates": [1.0, 2.0]}}


def test_ndjson_params_manifest_and_freshness(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"s":"a","v":1.5}\n{"s":"b"}\n')
    assert io.read_ndjson(spark, str(tmp_path / "r.json"), "s string, v double").where("v is null").count() == 1
    io.write_params(spark.createDataFrame([(24.0, 0.8)], "q1 double, gamma double"), str(tmp_path / "p"))
    assert json.loads(spark.read.text(str(tmp_path / "p")).first().value) == {"q1": 24.0, "gamma": 0.8}
    m = io.dataset_manifest(spark, str(tmp_path / "r.json")).first()
    data = (tmp_path / "r.json").read_bytes()
    assert (m["name"], m["bytes"], m["sha256"], m["version"]) == ("r.json", len(data), hashlib.sha256(data).hexdigest(), None)
    m = io.dataset_manifest(spark, str(tmp_path / "r.json"), "2024-02").first()
    assert m["version"] == "2024-02" and m["fetched"] is not None
    rows = spark.createDataFrame([("a", dt.date(2024, 1, 1)), ("a", dt.date(2025, 1, 1))], "source string, fetched date")
    out = io.attach_freshness(spark.range(1), rows, ["a", "b"]).first()
    assert out.last_updated_a == dt.date(2025, 1, 1) and out.last_updated_b is None
    assert io.domain_codes(" 31,2a , 31,") == ["31", "2A"] and io.domain_codes(" ") == []


def test_partition_overwrite(spark, tmp_path):
    path = str(tmp_path / "t")
    io.write_table(spark.createDataFrame([(1, "a"), (2, "b")], "m int, v string"), path, ["m"])
    io.write_table(spark.createDataFrame([(2, "c")], "m int, v string"), path, ["m"])
    assert {(r.m, r.v) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "c")}


def readings(spark, tmp_path):
    rows = [("s", dt.datetime(2024, 1, d, h), float(d * h)) for d in (1, 2, 40 - 30) for h in (1, 2, 3)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")
    df.write.parquet(str(tmp_path / "in"))
    return df


def test_streams(spark, tmp_path):
    df = readings(spark, tmp_path)
    source = lambda: stream.read_stream(spark, str(tmp_path / "in"), df.schema)
    stream.run_available(stream.stream_median(source(), "k", "ts", "v", "1 day", "1 hour"), str(tmp_path / "o1"), str(tmp_path / "c1"))
    got = {(r.start.day, r.median, r.n) for r in spark.read.parquet(str(tmp_path / "o1")).collect()}
    assert {(1, 2.0, 3), (2, 4.0, 3)} <= got
    stream.run_available(stream.stream_dedup(source(), ["k"], "ts", "400 days"), str(tmp_path / "o2"), str(tmp_path / "c2"))
    assert spark.read.parquet(str(tmp_path / "o2")).count() == 1
    clim = panel.climatology(df.withColumn("month", panel.month_of("ts")), "k", "month", "v")
    months = source().withColumn("month", panel.month_of("ts"))
    stream.run_available(stream.stream_score(months, clim, "k", "month", "v"), str(tmp_path / "o3"), str(tmp_path / "c3"))
    assert spark.read.parquet(str(tmp_path / "o3")).count() == 9

    def recompute(periods):
        whole = spark.read.parquet(str(tmp_path / "in")).withColumn("month", panel.month_of("ts"))
        return whole.join(periods, "month", "left_semi").groupBy("month").agg(F.sum("v").alias("v"))

    stream.refresh_affected(source(), "ts", recompute, str(tmp_path / "o4"), str(tmp_path / "c4"))
    assert [r.v for r in spark.read.parquet(str(tmp_path / "o4")).collect()] == [78.0]


def test_registered_queries_run(spark, sf_dir):
    names = catalog.queries()
    assert set(catalog.oracle_sql()) <= set(names)
    for name in ("pressure_levels", "attach_cascade", "entity_search", "stream_dedup", "io_roundtrip"):
        assert names[name](spark, sf_dir).count() > 0


def test_safe_cast_of_negative_and_blank(spark):
    r = spark.range(1).select(X.safe_cast(F.lit(" -2.5 "), "int").alias("a"), X.safe_cast(F.lit(""), "double").alias("b")).first()
    assert (r.a, r.b) == (-3, None)

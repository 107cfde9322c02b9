"""Tables with a commit log, and medians of counted state with their late rows."""

import datetime as dt
import statistics
from collections import Counter

import duckdb
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geopressure.operators import checks
from geopressure.plans import catalog
from geopressure.sources import commits, io
from geopressure.streaming import stream

SCHEMA = "month date, v long"
D = dt.date


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    return sorted((r.month, r.v) for r in df.collect())


def test_periods_are_replaced_together(spark, tmp_path):
    base = str(tmp_path / "t")
    jan, feb, mar = D(2020, 1, 1), D(2020, 2, 1), D(2020, 3, 1)
    assert commits.commit(table(spark, [(jan, 1), (feb, 2), (feb, 3)]), base, "month")
    reader = commits.read(spark, base, SCHEMA)
    assert commits.commit(table(spark, [(feb, 9), (mar, 4), (None, 5)]), base, "month", "s", 0)
    # A reader from before still sees the version that it resolved.
    assert rows_of(reader) == [(jan, 1), (feb, 2), (feb, 3)]
    want = [(jan, 1), (feb, 9), (mar, 4)]
    assert rows_of(commits.read(spark, base, SCHEMA).where("month is not null")) == want
    assert rows_of(commits.read(spark, base, SCHEMA, 1)) == [(jan, 1), (feb, 2), (feb, 3)]
    assert not commits.commit(table(spark, [(feb, 77)]), base, "month", "s", 0)
    assert rows_of(commits.read(spark, base, SCHEMA).where("month is not null")) == want
    assert commits.commit(table(spark, [(jan, 8)]), base)
    assert rows_of(commits.read(spark, base, SCHEMA)) == [(jan, 8)]
    assert len(commits.unused(spark, base)) == 2 and len(commits.unused(spark, base, 3)) == 0


def test_a_failed_commit_leaves_the_table(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "t")
    jan = D(2020, 1, 1)
    commits.commit(table(spark, [(jan, 1)]), base, "month")
    with monkeypatch.context() as m:
        m.setattr(commits, "_append", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            commits.commit(table(spark, [(jan, 2)]), base, "month", "s", 3)
    assert rows_of(commits.read(spark, base, SCHEMA)) == [(jan, 1)]
    assert len(commits.unused(spark, base)) == 1
    assert commits.commit(table(spark, [(jan, 2)]), base, "month", "s", 3)
    assert rows_of(commits.read(spark, base, SCHEMA)) == [(jan, 2)]


def test_an_empty_table_and_an_empty_commit(spark, tmp_path):
    base = str(tmp_path / "t")
    assert commits.read(spark, base, SCHEMA).count() == 0
    commits.commit(table(spark, []), base, "month")
    assert commits.read(spark, base, SCHEMA).count() == 0 and len(commits.entries(spark, base)) == 1


def test_a_stream_that_fails_after_its_write_replays_once(spark, tmp_path, monkeypatch):
    base, landed = str(tmp_path / "t"), str(tmp_path / "in")
    events = spark.createDataFrame([(dt.datetime(2020, 1, 5), 4), (dt.datetime(2020, 2, 5), 6)], "ts timestamp, v long")
    events.write.parquet(landed)
    recompute = lambda periods: events.withColumn("month", F.trunc(F.col("ts").cast("date"), "month")).join(periods, "month", "left_semi").groupBy("month").agg(F.sum("v").alias("v"))
    source = lambda: stream.read_stream(spark, landed, events.schema)
    real = commits.commit

    def fails(*a):
        real(*a)
        raise RuntimeError("lost after the commit")

    with monkeypatch.context() as m:
        m.setattr(commits, "commit", fails)
        with pytest.raises(Exception, match="lost after the commit"):
            stream.refresh_committed(source(), "ts", recompute, base, str(tmp_path / "c"))
    stream.refresh_committed(source(), "ts", recompute, base, str(tmp_path / "c"))
    assert len(commits.entries(spark, base)) == 1
    assert rows_of(commits.read(spark, base, SCHEMA)) == [(D(2020, 1, 1), 4), (D(2020, 2, 1), 6)]


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [3.0, 1.0, 1.0, 1.0], [2.0, 2.0, 5.0, 9.0], [5.0, -1.0, 0.0, 0.0, 7.0]])
def test_counted_median(values):
    counts = [(v, values.count(v)) for v in dict.fromkeys(values)]
    assert stream.counted_median(counts) == statistics.median(values)


def test_counted_medians_and_late_rows(spark, tmp_path):
    at = lambda day, hour: dt.datetime(2020, 1, day, hour)
    batches = [
        [(1, at(1, 1), 5.0), (1, at(1, 2), 5.0), (1, at(1, 3), 9.0), (1, at(1, 4), 1.0), (2, at(1, 5), 3.0), (1, at(6, 0), 2.0), (1, at(1, 6), None)],
        [(1, at(1, 7), 100.0), (1, at(1, 8), 100.0), (2, at(6, 1), 4.0), (2, at(6, 2), 8.0), (3, at(9, 0), 1.0)],
    ]
    base = str(tmp_path)
    with stream.keyed_state(spark):
        for rows in batches:
            spark.createDataFrame(rows, "k int, ts timestamp, v double").write.mode("append").parquet(f"{base}/in")
            landed = stream.read_stream(spark, f"{base}/in", spark.createDataFrame([], "k int, ts timestamp, v double").schema)
            out = stream.stream_counted_median(landed, "k", "ts", "v", 86_400, "1 day")
            stream.run_available(out, f"{base}/out", f"{base}/c")
    got = sorted((r.k, r.start, r.value, r.n, r.late) for r in spark.read.parquet(f"{base}/out").collect())
    assert got == [(1, at(1, 0), 5.0, 4, False), (1, at(1, 0), 100.0, 2, True), (1, at(6, 0), 2.0, 1, False), (2, at(1, 0), 3.0, 1, False), (2, at(6, 0), 6.0, 2, False)]


class Calls:
    """A handle of one key's state that counts the messages it would send."""

    def __init__(self):
        self.n, self.held, self.timers = 0, {}, set()

    def getValueState(self, *_):  # noqa: N802
        return self

    getMapState = getValueState  # noqa: N815

    def get(self):
        self.n += 1
        return self.held.get("value")

    def update(self, value):
        self.n += 1
        self.held["value"] = value

    def clear(self):
        self.n += 1
        self.held.clear()

    def containsKey(self, at):  # noqa: N802
        self.n += 1
        return at in self.held

    def getValue(self, at):  # noqa: N802
        self.n += 1
        return self.held[at]

    def updateValue(self, at, value):  # noqa: N802
        self.n += 1
        self.held[at] = value

    def registerTimer(self, at):  # noqa: N802
        self.n += 1
        self.timers.add(at)


class At:
    """The watermark and, of a timer, the time that it was set for."""

    def __init__(self, at):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: at


def test_a_batch_reads_and_writes_a_keys_state_once():
    calls, median = Calls(), stream.CountedMedian(10)
    median.init(calls)
    frames = [pd.DataFrame({"start": [w * 10 for w in range(50) for _ in range(20)], "value": [float(v % 5) for v in range(1000)]}) for _ in range(2)]
    assert list(median.handleInputRows((7,), iter(frames), At(0))) == [] and calls.n <= 3
    (closed,) = list(median.handleExpiredTimer((7,), At(300), At(10)))
    assert calls.n <= 6 and closed.values.tolist() == [[7, w * 10, 2.0, 40, False] for w in range(30)] and 310 in calls.timers


def test_late_rows_leave_the_state_alone():
    calls, median = Calls(), stream.CountedMedian(10)
    median.init(calls)
    frame = pd.DataFrame({"start": [10, 0, 10, 20], "value": [2.0, 1.0, 2.0, 4.0]})
    (late,) = list(median.handleInputRows((7,), iter([frame]), At(30)))
    assert late.values.tolist() == [[7, 0, 1.0, 1, True], [7, 10, 2.0, 2, True], [7, 20, 4.0, 1, True]] and calls.n == 0
    many = pd.DataFrame({"start": [0] * 500 + [40] * 500, "value": [float(i) for i in range(1000)]})
    (late,) = list(median.handleInputRows((7,), iter([many]), At(30)))
    assert len(late) == 500 and late["late"].all() and calls.n <= 3


def test_keys_share_a_buckets_state(spark, tmp_path):
    at = lambda day: dt.datetime(2020, 1, day, 5)
    big = 2**53 + 1
    keys = [*range(big, big + 2000), None]
    first = [(k, at(1), v) for k in keys for v in (1.0, 2.0, 2.0, 7.0, float((k or 0) % 3))] + [(big, at(9), 4.0)]
    base, kind = str(tmp_path), "k long, ts timestamp, v double"
    states = []
    for rows in (first, [(k, at(1), 6.0) for k in keys for _ in range(2)]):
        with stream.keyed_state(spark, 2):
            spark.createDataFrame(rows, kind).write.mode("append").parquet(f"{base}/in")
            landed = stream.read_stream(spark, f"{base}/in", spark.createDataFrame([], kind).schema)
            query = stream.run_available(stream.stream_counted_median(landed, "k", "ts", "v", 86_400, "1 day"), f"{base}/out", f"{base}/c")
            states += [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
    assert spark.conf.get(stream.PARTITIONS) == "4" and 0 < max(states) <= 4 * 257
    got = {(r.k, r.start.day, r.late): (r.value, r.n) for r in spark.read.parquet(f"{base}/out").collect()}
    want = {(k, 1, False): (2.0, 5) for k in keys} | {(k, 1, True): (6.0, 2) for k in keys}
    assert got == want


def test_nan_is_the_largest_value_and_comes_back(spark, tmp_path):
    nan, at = float("nan"), lambda day: dt.datetime(2020, 1, day, 5)
    base, kind = str(tmp_path), "k int, ts timestamp, v double"
    batches = [
        [(1, at(1), 1.0), (1, at(1), 2.0), (1, at(1), nan), (2, at(1), nan), (2, at(1), 1.0), (3, at(1), nan), (3, at(1), None), (9, at(9), 0.0)],
        [(1, at(1), nan), (1, at(1), nan), (1, at(1), None)],
    ]
    for rows in batches:
        with stream.keyed_state(spark):
            spark.createDataFrame(rows, kind).write.mode("append").parquet(f"{base}/in")
            landed = stream.read_stream(spark, f"{base}/in", spark.createDataFrame([], kind).schema)
            stream.run_available(stream.stream_counted_median(landed, "k", "ts", "v", 86_400, "1 day"), f"{base}/out", f"{base}/c")
    got = sorted((r.k, r.late, str(r.value), r.n) for r in spark.read.parquet(f"{base}/out").collect())
    assert got == [(1, False, "2.0", 3), (1, True, "nan", 2), (2, False, "nan", 2), (3, False, "nan", 1)]


@pytest.mark.parametrize("keys", [[3, 1, None], ["b", "a", None], [dt.date(2020, 1, 2), dt.date(2020, 1, 1), None]])
def test_packed_counts_hold_every_row(keys):
    rows = [(i % 5 - 1, keys[i % 3], i % 7 * 10, float(i % 11)) for i in range(stream.AT_ONCE + 5000)]
    table = pa.table(dict(zip(("bucket", "key", "start", "value"), map(list, zip(*rows, strict=True)), strict=True)))
    out = [(b, stream.unpack(p)) for batch in stream.packed_buckets(iter(table.to_batches(10_000))) for b, p in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    assert len(out) == 10 and sorted({b for b, _ in out}) == [-1, 0, 1, 2, 3]
    got = Counter()
    for b, counts in out:
        for r in counts.to_pylist():
            got[b, r["key"], r["start"], r["value"]] += r["n"]
    assert got == Counter(rows)


def test_counted_medians_of_many_windows():
    rows = [(w, k, float(i * i % 9), 1 + i % 4) for w in range(6) for k in ("a", "b", None) for i in range(1 + w * 3)]
    counts = stream.add_counts([pa.table(dict(zip((*stream.COUNTED, "n"), map(list, zip(*rows, strict=True)), strict=True)))])
    got = {(r["start"], r["key"]): (r["value"], r["n"]) for r in stream.counted_medians(counts).to_pylist()}
    every = {}
    for w, k, v, n in rows:
        every.setdefault((w, k), []).extend([v] * n)
    assert got == {at: (statistics.median(vs), len(vs)) for at, vs in every.items()}


@pytest.fixture
def unset(spark):
    """The session without a number of shuffle partitions of its own."""
    held = spark.conf.get(stream.PARTITIONS)
    spark.conf.unset(stream.PARTITIONS)
    yield spark
    spark.conf.set(stream.PARTITIONS, held)


def as_its_sql(spark, sf_dir, name):
    got = catalog.QUERIES[name](spark, sf_dir)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    return Counter(map(tuple, got.collect())) == Counter(want) and len(want) > 0


def test_keyed_state_where_the_session_sets_no_partitions(unset):
    default = unset.conf.get(stream.PARTITIONS)
    for asked, held in ((3, "3"), (10_000, default), (None, default)):
        with stream.keyed_state(unset, asked):
            assert unset.conf.get(stream.PARTITIONS) == held
        assert unset.conf.get(stream.PARTITIONS, None) is None


def test_counted_median_where_the_session_sets_no_partitions(unset, sf_dir):
    assert as_its_sql(unset, sf_dir, "stream_counted_median")


def test_late_output_where_the_session_sets_no_partitions(unset, sf_dir):
    assert as_its_sql(unset, sf_dir, "stream_late_output")


def test_manifest_counts_rows_of_files_that_share_a_name(spark, tmp_path):
    for folder, lines in (("a b", 3), ("c+d", 2), ("e", 0)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "part.csv").write_text("x\n" * lines)
    read = spark.read.schema("v string").csv(str(tmp_path / "*"))
    found = io.dataset_manifest(spark, str(tmp_path), "7", read)
    assert sorted((r.name, r.bytes, r.n_rows, r.version) for r in found.collect()) == [("part.csv", 4, 2, "7"), ("part.csv", 6, 3, "7")]
    assert io.dataset_manifest(spark, str(tmp_path)).where("n_rows is null").count() == 2


def test_an_empty_table_is_an_error(spark):
    with pytest.raises(ValueError, match="panel has no rows"):
        checks.require_rows(spark.range(0), "panel")
    assert checks.require_rows(spark.range(2), "panel").count() == 2

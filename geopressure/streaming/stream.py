"""Incremental refresh as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from geopressure.operators.panel import anomaly_against
from geopressure.sources import commits


def read_stream(spark: SparkSession, path: str, schema: StructType, kind: str = "parquet", max_files: int | None = None) -> DataFrame:
    """Files of a folder, each once (the checkpoint of the query that reads it remembers)."""
    reader = spark.readStream.schema(schema).format(kind)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def event_time(df: DataFrame, ts: str) -> DataFrame:
    """Timestamps without zone become instants, which watermarks need."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def stream_median(df: DataFrame, key: str, ts: str, value: str, width: str, delay: str) -> DataFrame:
    """Exact median and count per key and tumbling window; rows later than ``delay`` are dropped."""
    rows = event_time(df, ts).withWatermark(ts, delay)
    out = rows.groupBy(key, F.window(ts, width).alias("w")).agg(F.median(value).alias("median"), F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), "median", "n")


def stream_dedup(df: DataFrame, keys: Sequence[str], ts: str, delay: str) -> DataFrame:
    """First row of each key within the late horizon."""
    return event_time(df, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def stream_score(df: DataFrame, clim: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Anomalies of arriving values against a stored climatology (stream-static join)."""
    return anomaly_against(df, clim, key, ts, value)


def run_available(df: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what has landed into a Parquet table, then stop."""
    query = df.writeStream.outputMode(mode).format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
    query = query.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def refresh_affected(
    df: DataFrame, ts: str, recompute: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, by: str = "month"
) -> StreamingQuery:
    """For each batch, recompute the periods it touches and replace only their partitions.

    ``recompute`` gets the distinct periods of the batch (column ``by``) and returns rows with that column.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        periods = batch.select(F.trunc(F.col(ts).cast("date"), "month").alias(by)).distinct()
        out = recompute(periods)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(sink)

    query = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def refresh_committed(
    df: DataFrame, ts: str, recompute: Callable[[DataFrame], DataFrame], base: str, checkpoint: str, by: str = "month", source: str = "refresh"
) -> StreamingQuery:
    """As :func:`refresh_affected`, into a table with a commit log.

    A batch is one commit with its epoch: if the stream repeats a batch after a failure the table takes it once, and a reader sees
    the periods of a batch replaced all together or not at all.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        periods = batch.select(F.trunc(F.col(ts).cast("date"), "month").alias(by)).distinct()
        commits.commit(recompute(periods), base, by, source, epoch)

    query = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS = "spark.sql.shuffle.partitions"


@contextmanager
def keyed_state(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """A session whose new streams keep state in the store that single entries of a key can be read from.

    ``partitions`` bounds the session's number of state partitions, each of which costs a store and a worker in every batch; a checkpoint keeps it.
    """
    before = {name: spark.conf.get(name, None) for name in (STATE_STORE, PARTITIONS)}
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    if partitions:
        # Asked without a default: where the session sets none, Spark's own number holds.
        spark.conf.set(PARTITIONS, str(min(partitions, int(spark.conf.get(PARTITIONS)))))
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


COUNTED = ["start", "key", "value"]
#: Rows that a task counts together before they are shuffled.
AT_ONCE = 65_536


def add_counts(parts: Sequence[pa.Table], by: Sequence[str] = COUNTED) -> pa.Table:
    """How often (``n``) each value stands in each window of each key, over all parts, in order."""
    found = pa.concat_tables(parts).group_by(list(by), use_threads=False).aggregate([("n", "sum")])
    return found.select([*by, "n_sum"]).rename_columns([*by, "n"]).sort_by([(c, "ascending") for c in by]).combine_chunks()


def count_rows(rows: pa.Table, by: Sequence[str] = COUNTED) -> pa.Table:
    """The same of rows that are not counted yet."""
    return add_counts([rows.select(list(by)).append_column("n", pa.array(np.ones(len(rows), np.int64)))], by)


def counted_medians(counts: pa.Table) -> pa.Table:
    """Median and number of values of each window and key, from counts in order."""
    start, value, n = (counts[c].to_numpy() for c in ("start", "value", "n"))
    key = pa.concat_arrays(counts["key"].chunks).dictionary_encode("encode").indices.to_numpy()
    first = np.ones(len(n), bool)
    first[1:] = (start[1:] != start[:-1]) | (key[1:] != key[:-1])
    at, passed = np.flatnonzero(first), np.cumsum(n)
    before, total = passed[at] - n[at], np.add.reduceat(n, at)
    low, high = (value[np.searchsorted(passed, before + middle)] for middle in ((total + 1) // 2, total // 2 + 1))
    found = counts.select(["start", "key"]).take(pa.array(at))
    return found.append_column("value", pa.array(np.where(low == high, low, (low + high) / 2))).append_column("n", pa.array(total))


def counted_median(counts: list[tuple[float, int]]) -> float:
    """Median of values given with how often each stands."""
    if not counts:
        return float("nan")
    value, n = zip(*counts, strict=True)
    parts = pa.table({"start": [0] * len(n), "key": [0] * len(n), "value": pa.array(value, pa.float64()), "n": n})
    return counted_medians(add_counts([parts]))["value"][0].as_py()


def pack(counts: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, counts.schema) as out:
        out.write_table(counts)
    return sink.getvalue().to_pybytes()


def unpack(packed: bytes) -> pa.Table:
    return pa.ipc.open_stream(packed).read_all()


def packed_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a ``bucket`` as one row for each bucket, ``AT_ONCE`` rows or the last ones at a time: its counts, packed."""
    waiting: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        if batch is not None:
            waiting.append(batch)
        rows = sum(w.num_rows for w in waiting)
        if rows and (batch is None or rows >= AT_ONCE):
            counts = count_rows(pa.Table.from_batches(waiting), ["bucket", *COUNTED])
            waiting = []
            buckets = counts["bucket"].to_numpy()
            at = np.flatnonzero(np.diff(buckets, prepend=-2))
            plain = counts.select([*COUNTED, "n"])
            packed = [pack(plain.slice(a, b - a)) for a, b in zip(at, [*at[1:], len(buckets)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(buckets[at]), pa.array(packed, pa.binary())], ["bucket", "counts"])


class CountedMedian(StatefulProcessor):
    """State of a group: the counted values of its keys' open windows, packed; a timer stands at the end of the earliest window.

    A group is a bucket of keys, whose rows are packed counts (:func:`packed_buckets`), or one key with rows of its own. Each group costs messages
    between two processes and frames, whatever its rows, so a batch reads and writes its state once and a bucket's keys are handled together.
    """

    def __init__(self, width: int) -> None:
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "counts binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        arrived = add_counts([part for frame in rows for part in self._counts(key, frame)])
        late = self._ended(arrived, timerValues)
        new = arrived.filter(pa.array(~late))
        if len(new):
            held, first = self._held(), new["start"][0].as_py()
            self._hold(add_counts([held, new]) if held else new)
            if not held or first < held["start"][0].as_py():
                self.handle.registerTimer(first + self.width)
        if late.any():
            yield self._rows(arrived.filter(pa.array(late)), True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self._held()
        ended = self._ended(held, timerValues) if held else np.zeros(0, bool)
        if not ended.any():
            return
        left = held.filter(pa.array(~ended))
        if len(left):
            self._hold(left)
            self.handle.registerTimer(left["start"][0].as_py() + self.width)
        else:
            self.open.clear()
        yield self._rows(counted_medians(held.filter(pa.array(ended))), False)

    def _counts(self, key, frame: pd.DataFrame) -> list[pa.Table]:
        if "counts" in frame:
            return [unpack(bytes(packed)) for packed in frame["counts"]]
        return [count_rows(pa.Table.from_pandas(frame.assign(key=key[0]), preserve_index=False).replace_schema_metadata(None))]

    def _ended(self, counts: pa.Table, timerValues) -> np.ndarray:  # noqa: N803
        return counts["start"].to_numpy() + self.width <= timerValues.getCurrentWatermarkInMs()

    def _held(self) -> pa.Table | None:
        state = self.open.get()
        return unpack(bytes(state[0])) if state else None

    def _hold(self, counts: pa.Table) -> None:
        self.open.update((pack(counts),))

    def _rows(self, counts: pa.Table, late: bool) -> pd.DataFrame:
        return counts.select(["key", "start", "value", "n"]).to_pandas(integer_object_nulls=True, date_as_object=True).assign(late=late)

    def close(self) -> None:
        """Nothing is held outside the state."""


def stream_counted_median(df: DataFrame, key: str, ts: str, value: str, seconds: int, delay: str, buckets: int = 256) -> DataFrame:
    """``key, start, value, n, late``: exact medians of closed windows of ``seconds``, and late rows beside them.

    Where ``late`` is false, ``value`` is the median of the window's ``n`` rows, given once, when the watermark has passed its end. Where it is true the row came for a window
    already closed: ``value`` is its value and ``n`` how many such rows came at once. State is one count for each open window and distinct
    value, not for each row. Keys are dealt over ``buckets`` by their hash (null has one of its own), a batch rewrites the buckets that it meets; a checkpoint
    keeps their number. Null values take no part. The session must keep keyed state (:func:`keyed_state`).
    """
    width = seconds * 1000
    rows = event_time(df, ts).withWatermark(ts, delay).where(F.col(value).isNotNull() & F.col(ts).isNotNull())
    start = (F.floor(F.unix_millis(ts) / width) * width).cast("long")
    # The time itself is left out, or rows would be dropped before the operator sees that they are late.
    bucket = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.hash(key), F.lit(buckets)))
    rows = rows.select(bucket.alias("bucket"), F.col(key).alias("key"), start.alias("start"), F.col(value).cast("double").alias("value"))
    kind = rows.schema["key"].dataType.simpleString()
    rows = rows.mapInArrow(packed_buckets, "bucket int, counts binary")
    schema = f"key {kind}, start long, value double, n long, late boolean"
    found = rows.groupBy("bucket").transformWithStateInPandas(CountedMedian(width), schema, "append", "eventtime")
    # A frame has one sign for null and NaN, and no value is null here.
    value_or_nan = F.coalesce("value", F.lit(float("nan"))).alias("value")
    return found.select(F.col("key").alias(key), F.timestamp_millis("start").alias("start"), value_or_nan, "n", "late")

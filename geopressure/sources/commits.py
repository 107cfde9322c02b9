"""Tables replaced by a commit log: new files are staged, and one atomic step makes them the table.

A table is a folder with ``data`` and ``log``. Each commit writes its rows to a folder of its own below ``data`` and then
names it in the next entry of ``log``; an entry is written aside and moved into place, which fails if another commit
took the number first. A reader resolves the log once and then reads only files that are never changed, so it sees one
version, whatever is replaced meanwhile. A commit that names its ``source`` and ``epoch`` is made once, however often it is tried.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Column of the folders below a commit's folder, one for each period; rows keep their own period column.
PERIOD = "__period"


def _path(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def entries(spark: SparkSession, base: str) -> list[dict]:
    """The log in order; its length is the number of commits."""
    fs, folder = _path(spark, f"{base}/log")
    if not fs.exists(folder):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().isdigit())
    found = []
    for name in names:
        stream = fs.open(_path(spark, f"{base}/log/{name}")[1])
        try:
            found.append(json.loads(bytes(stream.readAllBytes()).decode()))
        finally:
            stream.close()
    return found


def _append(spark: SparkSession, base: str, entry: dict) -> bool:
    """Add an entry as the next one; false if its source and epoch are there already."""
    fs, folder = _path(spark, f"{base}/log")
    fs.mkdirs(folder)
    _, aside = _path(spark, f"{base}/log/.{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    while True:
        log = entries(spark, base)
        if entry["source"] is not None and any((e["source"], e["epoch"]) == (entry["source"], entry["epoch"]) for e in log):
            fs.delete(aside, False)
            return False
        _, place = _path(spark, f"{base}/log/{len(log):012d}")
        # A move onto a file that is there fails or moves nothing.
        if not fs.exists(place) and fs.rename(aside, place):
            return True


def commit(df: DataFrame, base: str, by: str | None = None, source: str | None = None, epoch: int | None = None) -> bool:
    """Make ``df`` the table, or with ``by`` the table's rows of the periods that ``df`` holds; false if the epoch was committed before.

    What fails before the entry is written leaves the table as it was. The periods of a commit go through the driver: their number is that of folders written.
    """
    spark = df.sparkSession
    if source is not None and any((e["source"], e["epoch"]) == (source, epoch) for e in entries(spark, base)):
        return False
    folder = f"data/{uuid.uuid4().hex}"
    period = F.coalesce(F.col(by).cast("string"), F.lit("")) if by else F.lit("all")
    df.withColumn(PERIOD, F.sha2(period, 256)).write.partitionBy(PERIOD).parquet(f"{base}/{folder}")
    fs, written = _path(spark, f"{base}/{folder}")
    periods = [s.getPath().getName().partition("=")[2] for s in fs.listStatus(written) if s.isDirectory()]
    return _append(spark, base, {"source": source, "epoch": epoch, "folder": folder, "periods": periods, "whole": by is None})


def read(spark: SparkSession, base: str, schema: T.StructType | str, version: int | None = None) -> DataFrame:
    """The table after its last commit, or after the first ``version`` ones."""
    current: dict[str, str] = {}
    for entry in entries(spark, base)[:version]:
        if entry["whole"]:
            current.clear()
        current.update({p: f"{base}/{entry['folder']}/{PERIOD}={p}" for p in entry["periods"]})
    if not current:
        return spark.createDataFrame([], schema)
    # Each path is its own base, so the folders' column stays out.
    return spark.read.schema(schema).parquet(*sorted(current.values()))


def unused(spark: SparkSession, base: str, keep: int = 1) -> Sequence[str]:
    """Folders that none of the last ``keep`` versions reads: replaced ones, and those of attempts that failed.

    They may be deleted once no reader of an older version is left.
    """
    log = entries(spark, base)
    used: set[str] = set()
    for version in range(max(len(log) - keep + 1, 0), len(log) + 1):
        current: dict[str, str] = {}
        for entry in log[:version]:
            if entry["whole"]:
                current.clear()
            current.update(dict.fromkeys(entry["periods"], entry["folder"]))
        used |= set(current.values())
    fs, data = _path(spark, f"{base}/data")
    every = [f"data/{s.getPath().getName()}" for s in fs.listStatus(data)] if fs.exists(data) else []
    return sorted(f"{base}/{f}" for f in every if f not in used)

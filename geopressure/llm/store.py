"""Working tables in the shared folder of the cluster.

Iterative operators cut their lineage by writing a Parquet table below ``spark.checkpoint.dir``,
which driver and executors share; an executor that is lost takes nothing of it away.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: The folder of local sessions that name none: made once, on first use.
_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder of its own; on a cluster that is an
    error, because executors cannot read the driver's disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="spark-"))
        base = _OWN[0]
    return base.rstrip("/")


class Scratch:
    """The working tables of one run of an operator."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.made = 0
        self.held: dict[int, tuple[DataFrame, str]] = {}

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df`` as a table and return the frame that reads it."""
        self.made += 1
        path = f"{self.base}/{self.made}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that no later step reads."""
        for table in tables:
            if table is not None and (found := self.held.pop(id(table), None)) is not None:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(found[1])
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors become integer weights per dimension (the terms). The vectors of a partition are packed into
blocks; a query block meets every block of vectors. Within such a pair a dense array holds one score
per query and vector, the dimensions are taken one at a time, and each query with a non-zero weight
there scatters weight times the dimension's posting column into its row of scores. The best ``k`` of
every row are selected from the block, and the selections of all blocks are merged.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geopressure.llm.store import Scratch

#: Rows of a block of vectors and of a block of queries: 8 bytes times their product is the scores.
BLOCK = 4096
QUERY_BLOCK = 1024
#: Bytes of packed queries up to which they are sent to every executor; beyond, blocks meet by a shuffle.
MAX_BROADCAST = 32 << 20

PACKED = "width int, ids binary, weights binary"
BEST = "query_id long, vec_id long, score long"


def _pack(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Blocks of vectors as dense integer matrices, one row for each width and block."""
    held: dict[int, tuple[list, list]] = {}

    def emit(width: int, ids: list, vectors: list) -> pa.RecordBatch:
        matrix = np.floor(np.array(vectors, np.float64).reshape(len(ids), width) * 256).astype(np.int64)
        values = [[width], [np.array(ids, np.int64).tobytes()], [matrix.tobytes()]]
        kinds = [pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["width", "ids", "weights"])

    for batch in batches:
        for ident, vector in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
            if ident is None or vector is None or any(x is None for x in vector) or not np.isfinite(vector).all():
                continue
            ids, vectors = held.setdefault(len(vector), ([], []))
            ids.append(ident)
            vectors.append(vector)
            if len(ids) >= rows:
                yield emit(len(vector), *held.pop(len(vector)))
    for width, (ids, vectors) in held.items():
        yield emit(width, ids, vectors)


def accumulate(queries: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Scores of every query against every vector of a block, one term at a time."""
    scores = np.zeros((len(queries), len(block)), np.int64)
    for term in range(queries.shape[1]):
        weights, posting = queries[:, term], block[:, term]
        rows, at = np.flatnonzero(weights), np.flatnonzero(posting)
        if len(at) == len(posting):
            for r in rows:
                scores[r] += weights[r] * posting
        elif len(at):
            for r in rows:
                scores[r, at] += weights[r] * posting[at]
    return scores


def _score(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            qid, vid = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
            q = np.frombuffer(row["q_weights"], np.int64).reshape(len(qid), row["width"])
            v = np.frombuffer(row["weights"], np.int64).reshape(len(vid), row["width"])
            out: list[list] = [[], [], []]
            for at in range(0, len(qid), 256):
                scores = accumulate(q[at : at + 256], v)
                for ident, line in zip(qid[at : at + 256], scores, strict=True):
                    others = np.flatnonzero(vid != ident)
                    line = line[others]
                    if len(line) > k:
                        least = np.partition(line, len(line) - k)[len(line) - k]
                        near = np.flatnonzero(line >= least)
                        others, line = others[near], line[near]
                    best = np.lexsort((vid[others], -line))[:k]
                    out[0] += [ident] * len(best)
                    out[1] += vid[others[best]].tolist()
                    out[2] += line[best].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["query_id", "vec_id", "score"])


def _valid(df: DataFrame) -> DataFrame:
    """Rows with an id and a vector of finite components."""
    value = lambda x: x.cast("double")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(value(x)) & (F.abs(value(x)) < float("inf")))
    return df.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` vectors of highest integer inner product.

    ``vectors(vec_id, embedding, ...)`` and ``queries`` of the same form; components become
    ``floor(256 * x)``. A query's own row (the same vec_id) is no candidate; ties go to the smaller
    vec_id. Vectors that are null or hold a null or non-finite component, and rows without vec_id,
    take no part; vectors meet only those of the same width. Repeated vectors are candidates one by
    one; of a query id with several valid vectors the least one asks. Other columns are ignored.
    """
    pack = lambda df, n: df.mapInArrow(functools.partial(_pack, rows=n), PACKED)
    unique = _valid(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    q = pack(unique, QUERY_BLOCK).withColumnsRenamed({"ids": "q_ids", "weights": "q_weights"})
    v = pack(_valid(vectors), BLOCK)
    scratch = Scratch(vectors.sparkSession, "top-k")
    q = scratch.save(q).withColumnRenamed("width", "q_width")
    size = q.agg(F.sum(F.length("q_weights"))).first()[0] or 0
    if size <= MAX_BROADCAST:
        blocks = v.crossJoin(F.broadcast(q)).where("width = q_width").drop("q_width")
    else:
        # A grid: vector blocks dealt over its columns and copied to all rows, query blocks the other way.
        height = -(-size // MAX_BROADCAST)
        width = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        deal = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
        copy = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        across = v.withColumn("column", deal("ids", width)).withColumn("line", copy(height))
        down = q.withColumnRenamed("q_width", "width").withColumn("line", deal("q_ids", height)).withColumn("column", copy(width))
        blocks = across.join(down, ["width", "line", "column"]).drop("line", "column")
    found = blocks.mapInArrow(functools.partial(_score, k=k), BEST)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )

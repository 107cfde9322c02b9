"""A sparse document-term matrix in shards, with one dictionary for the whole corpus.

Each task cuts its documents into shards of bounded size and writes a shard as compressed sparse rows:
``ends`` (where each document's entries end), ``terms`` (column of each entry, numbered inside the
shard) and ``counts``. The words of all shards are then encoded once, globally: every distinct word gets
a dense number, and each shard gets ``columns``, the number of each of its own columns. What is shuffled for the
dictionary is one row for each shard and distinct word of it, never one for each word of a text.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geopressure.llm.store import Scratch
from geopressure.llm.tasks import whole

#: Bytes of text at which a shard is closed, and documents of one. A single longer document is a shard of its own.
BYTES, ROWS = 8 << 20, 1 << 14
#: Bytes of a word that are compared as numbers; longer words, and those that end in NUL, are looked up one by one.
WIDE = 16
#: Words that are looked at at once.
PART = 1 << 17

Measure = Callable[[bytes], tuple]
#: A table for ``bytes.translate`` that leaves every byte of a word and turns all others into a blank.
BLANK_WORDS = bytes(32 if i in (32, *range(9, 14)) else i for i in range(256))


class TermMatrix(NamedTuple):
    """``dictionary(term, term_id, df, total)``, ``local`` and ``shards``.

    ``local(shard, rows, filled, ends, terms, counts, letters, bounds)`` are the shards as they were cut, each with its own words (see :func:`shard_words`);
    ``filled`` is how many of a shard's rows have any entry. ``shards`` has the dictionary's numbers of these words, ``columns``, in their place.
    All but ``rows`` and ``columns`` are packed, so that a shard passes through Spark as a few blocks of bytes.
    """

    dictionary: DataFrame
    local: DataFrame
    shards: DataFrame


class Entries(NamedTuple):
    """Compressed sparse rows of some texts, and the words of their columns."""

    ends: np.ndarray
    terms: np.ndarray
    counts: np.ndarray
    words: pa.Array


def _keys(raw: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Two numbers for each word that differ between any two words: its bytes, or a number given to a longer one or one that ends in NUL."""
    window = np.lib.stride_tricks.sliding_window_view(np.append(raw, np.zeros(WIDE, np.uint8)), WIDE)
    keys = np.empty((len(starts), 2), np.uint64)
    for at in range(0, len(starts), PART):
        held = window[starts[at : at + PART]]
        held[np.arange(WIDE) >= np.minimum(lens[at : at + PART], WIDE)[:, None]] = 0
        keys[at : at + PART] = held.view(np.uint64)
    given: dict[bytes, int] = {}
    # A word that ends in NUL has the padded bytes of a shorter one.
    for i in np.flatnonzero((lens > WIDE) | (raw[starts + lens - 1] == 0)).tolist():
        word = raw[starts[i] : starts[i] + lens[i]].tobytes()
        # No word has a blank, so no short word begins with eight of them.
        keys[i] = 0x2020202020202020, given.setdefault(word, len(given))
    return keys


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each distinct key, for every row, and a row of each number."""
    mixed = (keys[:, 0] * np.uint64(0x9E3779B97F4A7C15)) ^ (keys[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed ^= mixed >> np.uint64(31)
    order = np.argsort(mixed, kind="stable")
    mixed = mixed[order]
    new = np.ones(len(keys), bool)
    np.not_equal(mixed[1:], mixed[:-1], out=new[1:])
    del mixed
    order = order.astype(np.int32 if len(keys) < 1 << 31 else np.int64)
    for at in range(1, len(keys), PART):
        last = min(at + PART, len(keys))
        unlike = (keys[order[at:last]] != keys[order[at - 1 : last - 1]]).any(axis=1)
        if (unlike & ~new[at:last]).any():
            # Two keys share a mixed value; order by the keys themselves.
            order = np.lexsort((keys[:, 1], keys[:, 0]))
            new[1:] = (keys[order[1:]] != keys[order[:-1]]).any(axis=1)
            break
    number = np.empty(len(keys), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    return number, order[new]


def entries(texts: list[bytes], table: bytes) -> Entries:
    """The rows of texts whose words are the runs that ``table`` leaves between blanks."""
    raw = np.frombuffer(b" ".join(texts).translate(table) + b" ", np.uint8)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    gap = np.ones(len(raw) + 1, bool)
    np.equal(raw, 32, out=gap[1:])
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    del gap
    starts, lens = edges[0::2].copy(), np.diff(edges)[0::2].astype(np.int32)
    del edges
    if not len(starts):
        return Entries(np.zeros(len(texts) + 1, np.int64), np.empty(0, np.int32), np.empty(0, np.int32), pa.array([], pa.binary()))
    number, holder = _numbered(_keys(raw, starts, lens))
    at = np.concatenate(([0], np.cumsum(lens[holder], dtype=np.int64)))
    letters = raw[np.repeat(starts[holder] - at[:-1], lens[holder]) + np.arange(at[-1])]
    words = pa.Array.from_buffers(pa.binary(), len(holder), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(letters)])
    cells = np.searchsorted(bounds, starts, side="right") << 32
    del starts, lens
    cells |= number
    del number
    cells.sort()
    first = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
    counts = np.diff(first, append=len(cells)).astype(np.int32)
    cells = cells[first]
    ends = np.searchsorted(cells >> 32, np.arange(len(texts) + 1))
    return Entries(ends, (cells & 0xFFFFFFFF).astype(np.int32), counts, words)


def _cut(batches: Iterator[pa.RecordBatch], table: bytes, measure: Measure | None, kinds: list[pa.DataType], schema: pa.Schema):
    task, made = TaskContext.get().partitionId(), 0
    row_type = schema.field("rows").type.value_type
    names = [row_type.field(i).name for i in range(row_type.num_fields)]
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    for batch in batches:
        texts = batch.column("text")
        kept = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "text"]
        at = 0
        while at < batch.num_rows:
            begin, held, size = at, [], 0
            while at < batch.num_rows and at - begin < ROWS and (at == begin or size < BYTES):
                held.append((texts[at].as_py() or "").encode("utf-8", "surrogatepass"))
                size += len(held[-1])
                at += 1
            found = entries(held, table)
            measured = [measure(raw) for raw in held] if measure else []
            own = [c.slice(begin, at - begin).cast(row_type.field(i).type) for i, c in enumerate(kept)]
            own += [pa.array([m[i] for m in measured], kind) for i, kind in enumerate(kinds)]
            binary = [pa.array([x.tobytes()], pa.binary()) for x in (found.ends.astype(np.int64), found.terms, found.counts)]
            filled = int(np.count_nonzero(np.diff(found.ends)))
            _, bounds, letters = found.words.buffers()
            binary += [pa.array([x.to_pybytes() if x else b""], pa.binary()) for x in (letters, bounds)]
            columns = [pa.array([task << 32 | made], pa.int64()), one(pa.StructArray.from_arrays(own, names)), pa.array([filled], pa.int64()), *binary]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "rows", "filled", "ends", "terms", "counts", "letters", "bounds"])
            made += 1


def shard_words(letters: bytes, bounds: bytes) -> pa.Array:
    """The words of a shard in order of their columns."""
    return pa.Array.from_buffers(pa.binary(), max(len(bounds) // 4 - 1, 0), [None, pa.py_buffer(bounds or bytes(4)), pa.py_buffer(letters)])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``shard, k, term, df, total`` of every column of every shard."""
    for batch in batches:
        for i in range(batch.num_rows):
            terms, counts = (np.frombuffer(batch.column(c)[i].as_py(), np.int32) for c in ("terms", "counts"))
            words = shard_words(batch.column("letters")[i].as_py(), batch.column("bounds")[i].as_py())
            df = np.bincount(terms, minlength=len(words))
            total = np.bincount(terms, weights=counts, minlength=len(words)).astype(np.int64)
            for at in range(0, len(words), PART // 4):
                part = slice(at, min(at + PART // 4, len(words)))
                k = np.arange(part.start, part.stop, dtype=np.int32)
                shard = pa.array(np.full(len(k), batch.column("shard")[i].as_py()), pa.int64())
                columns = [shard, pa.array(k), words[part], pa.array(df[part].astype(np.int64)), pa.array(total[part])]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "k", "term", "df", "total"])


def cut(
    docs: DataFrame,
    keep: Sequence[str] = ("doc_id",),
    table: bytes = BLANK_WORDS,
    measure: Measure | None = None,
    measures: str = "",
) -> DataFrame:
    """The shards of ``docs(text, ...)`` with columns numbered inside each, and the words of these (``local`` of :func:`build`), without a dictionary."""
    from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
    from pyspark.sql.types import StructType

    spark = docs.sparkSession
    extra = spark.createDataFrame([], measures).schema if measures else StructType()
    fields = [*docs.select(*keep).schema.fields, *extra.fields]
    struct = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in fields)
    ddl = f"shard long, rows array<struct<{struct}>>, filled long, ends binary, terms binary, counts binary, letters binary, bounds binary"
    schema = to_arrow_schema(spark.createDataFrame([], ddl).schema)
    kinds = [to_arrow_type(f.dataType) for f in extra.fields]
    task = functools.partial(whole(_cut), table=table, measure=measure, kinds=kinds, schema=schema)
    return docs.select(*keep, "text").mapInArrow(task, ddl)


def _dictionary(words: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct words numbered from 0 without gaps, by an offset for each partition of the written table."""
    found = words.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    found = scratch.save(found.withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    # One row for each partition of the aggregate: their number does not depend on the corpus.
    sizes = found.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    offsets = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    placed = found.withColumn("part", part).join(F.broadcast(offsets), "part")
    number = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1)
    return placed.select("term", number.alias("term_id"), "df", "total")


def build(
    docs: DataFrame,
    keep: Sequence[str] = ("doc_id",),
    table: bytes = BLANK_WORDS,
    measure: Measure | None = None,
    measures: str = "",
) -> TermMatrix:
    """The matrix of ``docs(text, ...)``: a row for each row, a column for each distinct word.

    Words are the runs between blanks once ``table`` has translated a text's UTF-8 bytes. ``keep`` are the columns that a shard's ``rows``
    carry along (one at least), followed by what ``measure`` gives for the text's bytes, with the names and types of ``measures``.
    A null text counts as empty and has no entries; repeated rows are rows of their own; texts of any
    length are read whole; an empty table gives no shards.
    """
    scratch = Scratch(docs.sparkSession, "terms")
    local = scratch.save(cut(docs, keep, table, measure, measures))
    words = local.select("shard", "terms", "counts", "letters", "bounds").mapInArrow(whole(_words), "shard long, k int, term binary, df long, total long")
    dictionary = _dictionary(words.select("term", "df", "total"), scratch)
    named = words.select("shard", "k", "term").join(dictionary.select("term", "term_id"), "term")
    # A shard's words are bounded by its entries.
    columns = named.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("k", "term_id"))).alias("columns"))
    shards = local.drop("letters", "bounds").join(columns, "shard", "left").withColumn("columns", F.coalesce("columns.term_id", F.array().cast("array<long>")))
    return TermMatrix(dictionary, local, shards)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            ends = np.frombuffer(batch.column("ends")[i].as_py(), np.int64)
            counts = np.frombuffer(batch.column("counts")[i].as_py(), np.int32)
            before = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
            rows = batch.column("rows")[i].values
            columns = [*rows.flatten(), pa.array(before[ends[1:]] - before[ends[:-1]]), pa.array(np.diff(ends))]
            yield pa.RecordBatch.from_arrays(columns, [*[f.name for f in rows.type], "n_terms", "n_distinct"])


def row_sums(shards: DataFrame) -> DataFrame:
    """The rows' own columns, with ``n_terms`` (sum of the row) and ``n_distinct`` (entries that are not zero).

    Sums do not depend on how columns are numbered, so the shards are taken as they were cut (``rows, ends, counts``).
    """
    fields = shards.schema["rows"].dataType.elementType.fields
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_terms long, n_distinct long"
    return shards.select("rows", "ends", "counts").mapInArrow(_sums, ddl)

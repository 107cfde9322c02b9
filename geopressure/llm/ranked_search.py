"""Ranked lexical search by the Best Position Algorithm over document-partitioned impact lists.

The index is a sharded document-term matrix with one dictionary (:mod:`geopressure.llm.term_matrix`), so document frequencies and
lengths are those of the whole corpus while every list is bounded by its shard. A shard and a block of
queries meet in one task. There each query term has a list of its documents in order of falling impact. The
lists are read in parallel; a document met for the first time is looked up directly in every other list,
which gives its whole score and marks its position in each. A list's best position is the end of its
run of seen positions from the top, so no unseen document can have more than the impact that follows it. The sum of these over the
lists, with the terms' weights, is the threshold: reading stops once it lies strictly below the k-th best
score, so that ties are never cut. The best of all shards are merged.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geopressure.llm import term_matrix
from geopressure.llm.store import Scratch
from geopressure.llm.tasks import whole

#: Terms are runs of digits, letters and all characters beyond ASCII; A to Z are lower-cased.
TERMS = bytes(i + 32 if 65 <= i <= 90 else i if i > 127 or chr(i).isalnum() else 32 for i in range(256))
#: Positions that are read from every list in the first round; each further round reads twice as many.
STEP = 16
#: Queries of a block, and bytes of packed queries up to which they are sent to every executor; beyond, blocks meet by a shuffle.
QUERIES, MAX_BROADCAST = 1024, 32 << 20

PACKED = "items binary, bounds binary, asked array<binary>, lists binary, weights binary"


class Index(NamedTuple):
    """Shards with their own words, the dictionary, the documents that hold a term, and all terms with repeats."""

    shards: DataFrame
    dictionary: DataFrame
    documents: int
    terms: int


def build_index(docs: DataFrame) -> Index:
    """Index ``docs(doc_id, text, ...)``: every row is a document; a null or empty text holds no term."""
    built = term_matrix.build(docs.select("doc_id", "text"), ["doc_id"], TERMS)
    n = built.local.agg(F.sum("filled")).first()[0] or 0
    shards = built.local.select("shard", "rows", "ends", "terms", "counts", "letters", F.col("bounds").alias("word_bounds"))
    return Index(shards, built.dictionary, n, built.dictionary.agg(F.sum("total")).first()[0] or 0)


class Lists:
    """Impact lists of the asked terms in one shard.

    Entries stand twice: in order of list and falling impact for reading, and of list and document for direct access.
    """

    def __init__(self, asked: pa.Array, words: pa.Array, ends: np.ndarray, terms: np.ndarray, counts: np.ndarray, documents: int, total: int) -> None:
        number = pc.fill_null(pc.index_in(words, value_set=asked), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        before = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
        length = before[ends[1:]] - before[ends[:-1]]
        if len(length) and int(length.max()) * 75 * documents < 1 << 63:
            m = 25 + 75 * length * documents // max(total, 1)
        else:
            m = np.array([25 + 75 * int(x) * documents // max(total, 1) for x in length], np.int64)
        owner = np.repeat(np.arange(len(length)), np.diff(ends))
        of = number[terms]
        kept = np.flatnonzero(of >= 0)
        kept = kept[np.argsort(of[kept], kind="stable")]
        of, self.doc, tf = of[kept], owner[kept], counts[kept].astype(np.int64)
        self.key = of << 32 | self.doc
        self.impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[self.doc])
        self.first = np.searchsorted(of, np.arange(len(asked) + 1))
        by_impact = np.lexsort((-self.impact, of))
        self.read_doc, self.read_impact = self.doc[by_impact], self.impact[by_impact]
        self.place = np.empty(len(by_impact), np.int64)
        self.place[by_impact] = np.arange(len(by_impact))
        self.seen = np.zeros(len(by_impact), bool)
        self.met = np.zeros(len(length), bool)

    def direct(self, lists: np.ndarray, weights: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Whole scores of documents, and their positions in all lists marked as seen."""
        wanted = (lists[:, None] << 32) | docs[None, :]
        at = np.searchsorted(self.key, wanted)
        at[at == len(self.key)] = 0
        held = self.key[at] == wanted
        self.seen[self.place[at[held]]] = True
        return (np.where(held, self.impact[at], 0) * weights[:, None]).sum(axis=0)

    def best(self, lists: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that can be among the ``k`` best of a query, ties included, and their scores."""
        some = (self.first[lists + 1] > self.first[lists]) & (weights > 0)
        lists, weights = lists[some], weights[some]
        low, high = self.first[lists], self.first[lists + 1]
        best = low.copy()
        docs, scores, depth, step = [], [], 0, STEP
        top = np.empty(0, np.int64)
        while len(lists):
            parts = [self.read_doc[a + depth : min(a + depth + step, b)] for a, b in zip(low, high, strict=True) if a + depth < b]
            if not parts:
                break
            new = np.concatenate(parts)
            new = np.unique(new[~self.met[new]])
            self.met[new] = True
            if len(new):
                docs.append(new)
                scores.append(self.direct(lists, weights, new))
                top = np.concatenate((top, scores[-1]))
                if len(top) > k:
                    top = np.partition(top, len(top) - k)[-k:]
            depth, step = depth + step, step * 2
            bound = 0
            for j, (at, end) in enumerate(zip(best.tolist(), high.tolist(), strict=True)):
                # The read positions are all seen; others follow where direct accesses have filled the gap.
                at = max(at, min(int(low[j]) + depth, end))
                while at < end:
                    rest = self.seen[at : min(at + 256, end)]
                    run = int(np.argmin(rest))
                    if not rest[run]:
                        at += run
                        break
                    at += len(rest)
                best[j] = at
                bound += int(weights[j]) * int(self.read_impact[at]) if at < end else 0
            if len(top) == k and bound < top.min():
                break
        if not docs:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        found, score = np.concatenate(docs), np.concatenate(scores)
        self.met[found] = False
        for a, b in zip(low, high, strict=True):
            self.seen[a:b] = False
        keep = score > 0
        if keep.sum() > k:
            keep &= score >= np.partition(score, len(score) - k)[len(score) - k]
        return found[keep], score[keep]


def _search(batches: Iterator[pa.RecordBatch], k: int, documents: int, total: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            ints = lambda name, kind=np.int64: np.frombuffer(batch.column(name)[i].as_py(), kind)  # noqa: E731, B023
            items, bounds, lists, weights = ints("items"), ints("bounds"), ints("lists"), ints("weights")
            asked = batch.column("asked")[i].values
            words = term_matrix.shard_words(batch.column("letters")[i].as_py(), batch.column("word_bounds")[i].as_py())
            held = Lists(asked, words, ints("ends"), ints("terms", np.int32), ints("counts", np.int32), documents, total)
            ids = batch.column("rows")[i].values.field("doc_id")
            out: list[list] = [[], [], []]
            for q, item in enumerate(items.tolist()):
                own = slice(bounds[q], bounds[q + 1])
                docs, scores = held.best(lists[own], weights[own], k)
                names = ids.take(pa.array(docs)).to_pylist()
                rows = sorted(zip((-scores).tolist(), [(x is None, x or 0) for x in names], names, strict=True), key=lambda r: r[:2])[:k]
                out[0] += [item] * len(rows)
                out[1] += [name for _, _, name in rows]
                out[2] += [-score for score, _, _ in rows]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["item", "doc_id", "score"])


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
        found = term_matrix.entries(texts, TERMS)
        owner = np.repeat(np.arange(len(texts)), np.diff(found.ends))
        columns = [batch.column("item").take(pa.array(owner)), found.words.take(pa.array(found.terms)), pa.array(found.counts.astype(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, ["item", "term", "repeats"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, QUERIES):
            part = batch.slice(at, QUERIES)
            rows = part.column("terms").to_pylist()
            bounds, flat, number = np.cumsum([0, *map(len, rows)]), [x for row in rows for x in row], {}
            lists = [number.setdefault(x["term"], len(number)) for x in flat]
            items, bounds, lists, weights = (
                pa.array([np.array(x, np.int64).tobytes()], pa.binary()) for x in (part.column("item").to_numpy(), bounds, lists, [x["weight"] for x in flat])
            )
            asked = pa.array([list(number)], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([items, bounds, asked, lists, weights], ["items", "bounds", "asked", "lists", "weights"])


def search(index: Index, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents of highest score above 0 for each item.

    ``items(item_id, text, ...)``; rows that repeat with id and text are one item, one id with two texts is two. A term's weight is
    ``floor(1000 * ln((2 N + 2) / (2 df + 1)))``; a document adds ``weight * ((1000000000 tf) div (1000 tf + 8 m))`` for each occurrence of the
    term in the item, where ``m = 25 + (75 n N) div L``. Equal scores go by ascending doc_id, those without one last.
    Repeated documents rank one by one. An item without a known term gives no rows. Texts are read whole; other columns are ignored.
    """
    spark = items.sparkSession
    scratch = Scratch(spark, "ranked-search")
    named = scratch.save(items.select("item_id", "text").distinct().withColumn("item", F.monotonically_increasing_id()))
    terms = named.select("item", "text").mapInArrow(_item_terms, "item long, term binary, repeats long")
    ratio = F.lit(2.0 * index.documents + 2) / (2 * F.col("df") + 1)
    known = index.dictionary.join(terms, "term").withColumn("weight", F.floor(1000 * F.log(ratio)) * F.col("repeats"))
    queries = known.where("weight > 0").groupBy("item").agg(F.collect_list(F.struct("term", "weight")).alias("terms"))
    # As few blocks as hold the queries: every block meets every shard.
    blocks = max(1, -(-named.count() // QUERIES))
    packed = scratch.save(queries.repartition(blocks).mapInArrow(_pack, PACKED))
    letters = F.aggregate("asked", F.lit(0), lambda n, term: n + F.length(term) + 8)
    size = packed.agg(F.sum(letters + F.length("lists") * 2)).first()[0] or 0
    shards = index.shards
    if size <= MAX_BROADCAST:
        met = shards.crossJoin(F.broadcast(packed))
    else:
        # A grid: shards dealt over its columns and copied to all rows, blocks of queries the other way.
        height, width = -(-size // MAX_BROADCAST), int(spark.conf.get("spark.sql.shuffle.partitions"))
        deal = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
        copy = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        across = shards.withColumn("column", deal("shard", width)).withColumn("line", copy(height))
        down = packed.withColumn("line", deal("items", height)).withColumn("column", copy(width))
        met = across.join(down, ["line", "column"]).drop("line", "column")
    run = functools.partial(whole(_search), k=k, documents=index.documents, total=index.terms)
    found = met.mapInArrow(run, "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(named.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")

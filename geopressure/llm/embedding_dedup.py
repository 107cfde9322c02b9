"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

A rotation of the centred principal components is learned on a bounded sample so that the signs of the rotated
components are balanced bits close to the components themselves (iterative quantisation); several starts give several
rotations, hence codes of as many bits as are asked for. Codes are cut into substrings of equal width, one hash table
for each: vectors that agree on a whole substring meet in its bucket. Their full codes are compared by Hamming distance, and what is near is
reranked with the original vectors.

* Equal vectors are one class, so exact copies never meet as pairs; a class counts with its number of rows.
* A pair is counted in the first table where it meets, which both codes tell, so no pair is written and nothing
  has to be made distinct: a bucket gives, for each member, how many it is linked with there and one edge to the least member of its group.
* A bucket of more than ``LOCAL`` members is dealt as pairs of chunks; no task holds more.
* Only members with a near code in a bucket are joined with their vectors.

The width of a substring follows the number of classes, so that buckets of unlike vectors stay small at any size; the number of tables is the
least that finds ``recall`` of simulated pairs at exactly the threshold (pairs that are more alike are found more often).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geopressure.llm.near_dedup import Groups, _runs, merge_components
from geopressure.llm.store import Scratch
from geopressure.llm.tasks import whole

#: Members of a bucket that one task compares.
LOCAL = 4096
#: Unlike vectors that meet in a bucket on average, tables at most (narrower substrings take their place), and rounds of the rotation.
MEET, TABLES, ROUNDS = 24, 96, 20


class Model(NamedTuple):
    """What codes are made with, for vectors of one width: ``sign((x / |x| - mean) @ turn)``."""

    mean: np.ndarray
    turn: np.ndarray


class Plan(NamedTuple):
    """Models by vector width, bits of a substring, tables, and Hamming distance up to which codes are near."""

    models: dict[int, Model]
    width: int
    tables: int
    reach: int


def learn_rotation(unit: np.ndarray, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """Iterative quantisation: a rotation that brings the rows of ``unit`` (centred, on principal components) closest to their signs."""
    dims = unit.shape[1]
    turn, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    for _ in range(rounds):
        signs = np.where(unit @ turn > 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(signs.T @ unit)
        turn = (left @ right).T
    return turn


def fit(sample: np.ndarray, bits: int) -> Model:
    """A model of at least ``bits`` bits from rows of unit length; directions without variance keep the random start."""
    mean = sample.mean(axis=0)
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    starts = range(-(-bits // sample.shape[1]))
    return Model(mean, np.hstack([axes @ learn_rotation(centred @ axes, seed) for seed in starts]))


def code_bits(model: Model, unit: np.ndarray, bits: int) -> np.ndarray:
    """Bits of rows of unit length, one byte for each."""
    return ((unit - model.mean) @ model.turn[:, :bits] > 0).astype(np.uint8)


def substrings(bits: np.ndarray, width: int, tables: int) -> np.ndarray:
    """The number that each substring of the codes spells."""
    powers = np.int64(1) << np.arange(width, dtype=np.int64)
    return bits[:, : width * tables].reshape(len(bits), tables, width).astype(np.int64) @ powers


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of unit length; they are scaled first, so that no square over- or underflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def make_plan(samples: dict[int, np.ndarray], classes: int, threshold: float, recall: float) -> Plan:
    """Models of all widths in the sample, and one layout of tables that suits the most frequent width."""
    width = max(1, min(30, int(np.ceil(np.log2(max(classes, 2) / MEET)))))
    main = max(samples, key=lambda d: len(samples[d]))
    x = _unit(samples[main])
    rng = np.random.default_rng(5)
    probes = x[rng.integers(0, len(x), 4096)]
    noise = rng.standard_normal(probes.shape)
    noise -= (noise * probes).sum(axis=1, keepdims=True) * probes
    # In one dimension nothing is orthogonal: the pair is the vector itself.
    off = noise / np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-300)
    pairs = _unit(threshold * probes + (1 - threshold**2) ** 0.5 * off)
    while True:
        # As many tables as independent bits would need, and half as many again.
        missed = 1 - (1 - np.arccos(threshold) / np.pi) ** width
        tables = min(TABLES, int(1.5 * np.log(1 - recall) / np.log(missed)) + 2)
        model = fit(x, width * tables)
        a, b = (code_bits(model, v, width * tables) for v in (probes, pairs))
        met = (substrings(a, width, tables) == substrings(b, width, tables)).cumsum(axis=1) > 0
        enough = np.flatnonzero(met.mean(axis=0) >= recall)
        if len(enough) or width == 1:
            break
        width -= 1
    tables = int(enough[0]) + 1 if len(enough) else tables
    far = (a != b)[:, : width * tables].sum(axis=1)
    reach = int(far.mean() + 5 * far.std()) + 1
    models = {d: model if d == main else fit(_unit(s), width * tables) for d, s in samples.items()}
    return Plan(models, width, tables, reach)


def _model(plan: Plan, dims: int) -> Model:
    """The model of a width; one that the sample does not have gets random rotations."""
    if dims not in plan.models:
        turns = [learn_rotation(np.zeros((1, dims)), seed, 0) for seed in range(-(-plan.width * plan.tables // dims))]
        plan.models[dims] = Model(np.zeros(dims), np.hstack(turns))
    return plan.models[dims]


def _code(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """``cls, code, buckets``: the packed code and the bucket in each table."""
    for batch in batches:
        cls, vectors = batch.column("cls").to_numpy(), batch.column("embedding")
        lens = np.diff(vectors.offsets.to_numpy())
        flat, at = vectors.values.to_numpy(), vectors.offsets.to_numpy()
        for dims in np.unique(lens).tolist():
            rows = np.flatnonzero(lens == dims)
            x = _unit(flat[at[rows][:, None] + np.arange(dims)])
            bits = code_bits(_model(plan, dims), x, plan.width * plan.tables)
            numbers = substrings(bits, plan.width, plan.tables)
            # Widths differ in the high bits: vectors of unlike width never meet.
            numbers |= (np.arange(plan.tables, dtype=np.int64) << 30) | np.int64(dims) << 40
            packed = np.packbits(bits, axis=1)
            codes = pa.array([row.tobytes() for row in packed], pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * plan.tables), pa.array(numbers.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(cls[rows]), codes, lists], ["cls", "code", "buckets"])


class Bucket:
    """The members of one run of nodes as arrays."""

    def __init__(self, batch: pa.RecordBatch, width: int, tables: int) -> None:
        raw = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        self.numbers = substrings(np.unpackbits(raw, axis=1), width, tables)
        self.words = np.pad(raw, ((0, 0), (0, -raw.shape[1] % 8))).view(np.uint64)
        self.cls, self.table, self.part = (batch.column(c).to_numpy() for c in ("cls", "table", "part"))
        self.mixed = batch.column("mixed").to_numpy(zero_copy_only=False)
        node = batch.column("node").to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        self.spans = list(zip(starts.tolist(), [*starts[1:].tolist(), len(node)], strict=True))

    def near(self, low: int, high: int, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a node, in blocks, whose codes are near and that meet in no earlier table."""
        for at in range(low, high - 1, 256):
            rows, rest = np.arange(at, min(at + 256, high)), np.arange(at, high)
            off = np.zeros((len(rows), len(rest)), np.uint16)
            for k in range(self.words.shape[1]):
                off += np.bitwise_count(self.words[rows, k][:, None] ^ self.words[rest, k][None, :])
            found = (off <= reach) & (rest[None, :] > rows[:, None])
            if self.mixed[low]:
                found &= self.part[rows][:, None] != self.part[rest][None, :]
            i, j = np.nonzero(found)
            i, j = rows[i], rest[j]
            if (t := self.table[low]) and len(i):
                new = np.concatenate(
                    [~(self.numbers[i[k : k + 65536], :t] == self.numbers[j[k : k + 65536], :t]).any(axis=1) for k in range(0, len(i), 65536)]
                )
                i, j = i[new], j[new]
            if len(i):
                yield i, j


def _members(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """The members of each node that have a near code there."""
    for batch in _runs(batches, "node"):
        bucket = Bucket(batch, plan.width, plan.tables)
        kept = np.zeros(batch.num_rows, bool)
        for low, high in bucket.spans:
            if high - low > 1:
                for i, j in bucket.near(low, high, plan.reach):
                    kept[i] = kept[j] = True
        if kept.any():
            yield batch.filter(pa.array(kept)).select(["node", "table", "mixed", "part", "cls"])


def _links(batches: Iterator[pa.RecordBatch], plan: Plan, threshold: float) -> Iterator[pa.RecordBatch]:
    """For each linked member of a node ``cls``, the rows that it is ``linked`` with there, and the ``least`` class of its group."""
    for batch in _runs(batches, "node"):
        bucket = Bucket(batch, plan.width, plan.tables)
        size = batch.column("n").to_numpy()
        flat, at = batch.column("embedding").values.to_numpy(), batch.column("embedding").offsets.to_numpy()
        out: list[list[np.ndarray]] = [[], [], []]
        for low, high in bucket.spans:
            if high - low < 2:
                continue
            x = flat[at[low] : at[high]].reshape(high - low, -1)
            # Scaling by a power of two is exact and keeps squares in range.
            x = x * np.exp2(-np.ceil(np.log2(np.abs(x).max(axis=1, keepdims=True))))
            norm = np.sqrt((x * x).sum(axis=1))
            linked, groups = np.zeros(high - low, np.int64), Groups(high - low)
            for i, j in bucket.near(low, high, plan.reach):
                for k in range(0, len(i), 1 << 16):
                    a, b = i[k : k + (1 << 16)] - low, j[k : k + (1 << 16)] - low
                    close = np.einsum("ij,ij->i", x[a], x[b]) >= threshold * (norm[a] * norm[b])
                    a, b = a[close], b[close]
                    np.add.at(linked, a, size[b + low])
                    np.add.at(linked, b, size[a + low])
                    order = np.argsort(a, kind="stable")
                    for part in np.split(order, np.flatnonzero(np.diff(a[order])) + 1):
                        if len(part):
                            groups.join(np.append(b[part], a[part[0]]))
            named = np.flatnonzero(linked)
            if len(named):
                ids = bucket.cls[low:high]
                least = np.full(high - low, np.iinfo(np.int64).max)
                np.minimum.at(least, groups.label, ids)
                for column, values in zip(out, (ids[named], linked[named], least[groups.label[named]]), strict=True):
                    column.append(values)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["cls", "linked", "least"])


def _valid(vector: str) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _deal(rows: DataFrame, large: DataFrame) -> DataFrame:
    """Members of buckets as nodes; a large bucket becomes a node for each chunk and for each two chunks."""
    sized = rows.join(large, "bucket", "left").withColumn("k", F.coalesce(F.ceil(F.col("size") / (LOCAL // 2)), F.lit(1)).cast("int"))
    mine = F.pmod(F.xxhash64("cls"), F.col("k")).cast("int")
    others = F.when(F.col("k") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("k") - 1))
    copies = sized.withColumn("part", mine).withColumn("other", F.explode(others))
    # A node of two chunks compares only across them.
    pair = F.least("part", "other") * F.col("k") + F.greatest("part", "other")
    node = F.when(F.col("k") == 1, F.col("bucket")).otherwise(F.xxhash64("bucket", pair))
    table = F.shiftright("bucket", 30).bitwiseAND(1023).cast("int")
    mixed = (F.col("part") != F.col("other")).alias("mixed")
    return copies.select(node.alias("node"), table.alias("table"), mixed, "part", "cls", "code")


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.995, sample: int = 4096) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors(vec_id, embedding, ...)``.

    Links are pairs of rows that the tables bring together and whose cosine, in double precision, is ``threshold`` or more; ``recall`` is the share of pairs at
    exactly the threshold that the tables bring together. At most about ``sample`` distinct vectors, chosen by hash, are fitted on; all
    are indexed. A vector that is null, empty, zero, or holds a null or a component that is not finite is linked with nothing; vectors of unlike width are not linked.
    Rows that repeat are rows of their own and linked with each other; a row without vec_id takes part in links, and is kept only if
    nothing with an id is in its component. Other columns are ignored. An empty table gives no rows.
    """
    scratch = Scratch(vectors.sparkSession, "embeddings")
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.withColumn("valid", _valid("embedding"))
    key = [F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(7), "embedding").alias("h2")]
    some = rows.where("valid").select("vec_id", "embedding", *key)
    none = rows.where("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    classes = some.groupBy("h1", "h2").agg(F.first("embedding").alias("embedding"), F.min("vec_id").alias("vec_id"), F.count("*").alias("n"))
    classes = scratch.save(classes.withColumn("cls", F.monotonically_increasing_id()))
    total = classes.count()
    if not total:
        return none.withColumn("kept", F.lit(True))
    chosen = classes.where(F.pmod(F.col("h1"), F.lit(-(-total // sample))) == 0).select("embedding").limit(2 * sample)
    by_width: dict[int, list] = {}
    for row in (chosen if not chosen.isEmpty() else classes.select("embedding").limit(sample)).toPandas()["embedding"]:
        by_width.setdefault(len(row), []).append(row)
    plan = make_plan({d: np.array(v, np.float64) for d, v in by_width.items()}, total, threshold, recall)
    codes = scratch.save(classes.select("cls", "embedding").mapInArrow(functools.partial(whole(_code), plan=plan), "cls long, code binary, buckets array<long>"))
    placed = codes.select("cls", "code", F.explode("buckets").alias("bucket"))
    large = scratch.save(placed.groupBy("bucket").agg(F.count("*").alias("size")).where(F.col("size") > LOCAL))
    met = _deal(placed, large).repartition("node").sortWithinPartitions("node")
    members = met.mapInArrow(functools.partial(whole(_members), plan=plan), "node long, table int, mixed boolean, part int, cls long")
    members = scratch.save(members)
    full = members.join(codes.select("cls", "code"), "cls").join(classes.select("cls", "embedding", "n"), "cls")
    ready = full.repartition("node").sortWithinPartitions("node")
    run = functools.partial(whole(_links), plan=plan, threshold=threshold)
    found = scratch.save(ready.mapInArrow(run, "cls long, linked long, least long"))
    comps = merge_components(found.select(F.col("cls").alias("a"), F.col("least").alias("b")), scratch)
    linked = found.groupBy("cls").agg(F.sum("linked").alias("linked"))
    heads = comps.join(classes.select("cls", "vec_id"), "cls").groupBy("comp").agg(F.min("vec_id").alias("head"))
    named = comps.join(heads, "comp").select("cls", "head")
    result = classes.join(linked, "cls", "left").join(named, "cls", "left").select(
        "h1", "h2",
        (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("head", "vec_id").alias("component_id"),
    )
    out = some.select("vec_id", "h1", "h2").join(result, ["h1", "h2"]).select("vec_id", "n_links", "component_id").unionByName(none)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

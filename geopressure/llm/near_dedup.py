"""MinHash near-duplicate detection by a chosen-path similarity join.

Every document becomes the set of its distinct word shingles. Equal sets are collapsed into one
class first, so exact copies never meet as pairs. Each class carries ``TREE_COORDS`` minwise values
for each tree, under hash functions of that tree alone, and two bits of ``COORDS`` values as a sketch.

* A class enters, in each of ``trees`` independent trees, the two nodes named by its minwise values
  (tokens) at the coordinates of the root. One shuffle brings the members of a node together.
* A node of at most ``local`` members is finished inside its task: it branches further, by the minwise
  tokens at two coordinates that the node chooses, as long as that saves comparisons; small nodes are
  compared exhaustively on sketches and set sizes.
* A larger node never meets in one task. Its members are dealt over chunks, each with the node's few
  pivots, so that a large group of near copies becomes one component through its pivots. Once all but a
  few members are known to be connected, those few are compared with every chunk of the rest; until
  then the members branch into child nodes by their tokens and the next round handles these. At
  ``max_depth`` what is left is compared chunk by chunk with every other chunk of its node: texts that
  so many tokens did not tell apart are so alike that more branches cost more than comparing.

What a node hands on is not pairs but lists: the members that near sketches join, one row for each
list, and equal lists of different nodes and trees once. The full shingle sets of a list meet in one
task, bounded by ``ELEMENTS`` shingles (longer lists are dealt as pairs of blocks), where links are
confirmed exactly on the full sets. A list gives at most one edge for each member, whatever its number
of links, so nothing grows with the square of a group but arithmetic on a bounded block. The edges are
merged into components.

A tree loses a pair of similarity 0.8 at the root with probability 0.04, all eight together about seven
times in 1e12; each level that a node branches inside its tree keeps a pair with probability 0.96 or
more. The sketch filter misses about three in a million at 0.8. ``tests/llm`` measures recall.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geopressure.llm.keys import only_keys, without_keys
from geopressure.llm.store import Scratch
from geopressure.llm.tasks import lean

COORDS = 128
#: Minwise values of each tree, drawn for it alone.
TREE_COORDS = 32
BRANCHES = 2
#: Members of a node that one task compares, and members up to which it does not branch.
LOCAL, LEAF = 4096, 64
PIVOTS = 6
#: Shingles of a list that one task holds to confirm its links.
ELEMENTS = 1 << 20
#: Words of the sketch: the first bit of all values in two, then the second bit.
SKETCH = ("s1", "s2", "s3", "s4")
#: Slots of the id filter that is broadcast: a proven bound on its rows, whatever the corpus.
FILTER_SLOTS = 1 << 20
#: Bytes of a text that are hashed at once, and shingles of which minwise values are taken at once.
SEGMENT = 1 << 20
CHUNK = 1024

#: Odd base of the words' polynomial hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class WordHash:
    """64-bit hashes of the words of a text, for whole arrays of bytes at a time.

    A word is hashed as a polynomial in ``BASE`` over its lower-cased bytes, taken as a difference of
    running sums, so no word is looked at on its own.
    """

    def __init__(self) -> None:
        self.lower = np.arange(256, dtype=np.uint64)
        self.lower[65:91] += np.uint64(32)
        self.lower += np.uint64(1)
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            powers = np.full((2, n), 1, np.uint64)
            powers[0, 1:], powers[1, 1:] = BASE, INVERSE
            self.up, self.down = np.multiply.accumulate(powers, axis=1)

    def _words(self, raw: np.ndarray) -> np.ndarray:
        gap = np.ones(len(raw) + 2, bool)
        gap[1:-1] = self.space[raw]
        edges = np.flatnonzero(gap[1:] != gap[:-1])
        starts, ends = edges[0::2], edges[1::2]
        self._grow(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.lower[raw] * self.up[: len(raw)], out=sums[1:])
        return (sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        parts, at = [], 0
        while len(raw) - at > SEGMENT:
            stop = at + SEGMENT
            while stop < len(raw) and not self.space[raw[stop]]:
                stop += 1
            parts.append(self._words(raw[at:stop]))
            at = stop
        parts.append(self._words(raw[at:]))
        return np.concatenate(parts) if len(parts) > 1 else parts[0]


def shingle_set(text: str | None, words: WordHash, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text; empty without words."""
    h = words(text)
    if not len(h):
        return np.empty(0, np.uint64)
    n = max(1, len(h) - width + 1)
    x = np.full(n, min(len(h), width), np.uint64)
    # With fewer words than a shingle has, the whole sequence is the one shingle.
    for k in range(min(width, len(h))):
        x = (x ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    x.sort()
    return x[np.concatenate(([True], x[1:] != x[:-1]))]


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return (
        rng.integers(0, 1 << 32, n, np.uint32) | np.uint32(1),
        rng.integers(0, 1 << 32, n, np.uint32),
    )


def minwise(grams: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minwise values of a set under all hash functions."""
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    folded = (grams >> np.uint64(32)).astype(np.uint32) ^ grams.astype(np.uint32)
    for at in range(0, len(folded), CHUNK):
        v = a[:, None] * folded[at : at + CHUNK]
        v += b[:, None]
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        np.minimum(low, v.min(axis=1), out=low)
    return low


@lean
def _features(batches: Iterator[pa.RecordBatch], width: int, trees: int, with_sets: bool) -> Iterator[pa.RecordBatch]:
    words = WordHash()
    first = [t * TREE_COORDS + j for t in range(trees) for j in range(BRANCHES)]
    a, b = _coefficients(max(COORDS, trees * TREE_COORDS))
    for batch in batches:
        n, cls, lows, sets = [], [], [], []
        for text in batch.column("text").to_pylist():
            grams = shingle_set(text, words, width)
            n.append(len(grams))
            cls.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest())
            if with_sets:
                sets.append(grams.view(np.int64))
            else:
                lows.append(minwise(grams, a, b))
        cols = [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(cls, pa.binary())]
        names = ["doc_id", "n_shingles", "cls"]
        if with_sets:
            flat = pa.array(np.concatenate(sets)) if sets else pa.array([], pa.int64())
            cols.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]).astype(np.int32)), flat))
            names.append("grams")
        else:
            low = np.array(lows, np.uint32).reshape(-1, len(a))
            mixed = low[:, :COORDS] * np.uint32(0x85EBCA6B)
            for bit in (31, 30):
                words_of = np.packbits(mixed >> np.uint32(bit) & np.uint32(1), axis=1, bitorder="little").view(np.int64)
                cols += [pa.array(words_of[:, 0]), pa.array(words_of[:, 1])]
            cols.append(pa.array([r.tobytes() for r in low[:, first]], pa.binary()))
            cols.append(pa.array([r.tobytes() for r in (low[:, : trees * TREE_COORDS] >> np.uint32(16)).astype(np.uint16)], pa.binary()))
            names += [*SKETCH, "roots", "sig"]
        yield pa.RecordBatch.from_arrays(cols, names)


def features(docs: DataFrame, width: int, trees: int, with_sets: bool = False) -> DataFrame:
    """Per document its set size and class key, and either its full set or its minwise values.

    ``roots`` holds each tree's first values in full (they name the root's children); ``sig`` holds half
    of every value of every tree, enough to tell apart the members of a node.
    """
    schema = "doc_id long, n_shingles long, cls binary, " + (
        "grams array<long>" if with_sets else "s1 long, s2 long, s3 long, s4 long, roots binary, sig binary"
    )
    return docs.select("doc_id", "text").mapInArrow(
        functools.partial(_features, width=width, trees=trees, with_sets=with_sets), schema
    )


def sketch_reach(threshold: float) -> int:
    """Differing sketch positions up to which a pair is a candidate: mean plus 4.8 deviations."""
    p = (1 - threshold) * 0.75
    return int(COORDS * p + 4.8 * (COORDS * p * (1 - p)) ** 0.5 + 0.999)


def merge_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``(cls, comp)`` of every class in ``links(a, b)``, comp the least class key it reaches.

    Alternates large-star and small-star steps until every edge leads straight to a root; the number
    of rounds grows with the logarithm of the longest chain. Hot roots are left to the skew handling
    of adaptive joins.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    edges = scratch.save(edges)
    while True:
        ends = F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up"))))
        seen = edges.select(ends.alias("e")).groupBy("e.x").agg(F.sum("e.up").alias("ups"), F.min("e.up").alias("low"))
        if seen.where("ups > 1 or (ups = 1 and low = 0)").isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
            .select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        )
        before, edges = edges, scratch.save(small.where("u > v").distinct())
        scratch.drop(before)
    roots = edges.select(F.col("v").alias("cls"), F.col("v").alias("comp")).distinct()
    out = scratch.save(edges.select(F.col("u").alias("cls"), F.col("v").alias("comp")).unionByName(roots))
    scratch.drop(edges)
    return out


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Batches sorted by ``key``, cut so that no value of it is split between two."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(key)
        last = column[-1]
        same = pc.equal(column, last).to_numpy(zero_copy_only=False)
        cut = int(np.argmax(same))
        if cut == 0 and (not kept or kept[0].column(key)[-1] == last):
            kept.append(batch)
            continue
        # What was kept is one value of the key; it goes on into this batch, or ended before it.
        yield pa.Table.from_batches([*kept, batch.slice(0, cut)]).combine_chunks().to_batches()[0]
        kept = [batch.slice(cut)]
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]


class Groups:
    """Disjoint sets of the positions 0 to n - 1, each named by its least member."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def join(self, members: np.ndarray) -> None:
        names = np.unique(self.label[members])
        if len(names) > 1:
            self.label[np.isin(self.label, names)] = names[0]

    def sets(self) -> list[np.ndarray]:
        """Sets of two or more."""
        order = np.argsort(self.label, kind="stable")
        starts = np.flatnonzero(np.diff(self.label[order], prepend=-1))
        return [part for part in np.split(order, starts[1:]) if len(part) > 1]


class Members:
    """Members of nodes as arrays: sketches, set sizes, whether they are of the known top component, and tokens."""

    def __init__(self, batch: pa.RecordBatch, reach: int, num: int, den: int) -> None:
        self.sketch = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in SKETCH], axis=1)
        self.size = batch.column("n").to_numpy()
        self.top = batch.column("top").to_numpy(zero_copy_only=False)
        self.batch, self.reach, self.num, self.den = batch, reach, num, den

    def tokens(self, lo: int, hi: int) -> np.ndarray:
        raw = b"".join(self.batch.column("sig").slice(lo, hi - lo).to_pylist())
        return np.frombuffer(raw, np.uint16).reshape(hi - lo, -1)

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether positions may be linked: sketches within reach, sizes that allow it, not both of the top."""
        x, y = self.sketch[a], self.sketch[b]
        off = np.bitwise_count((x[..., 0] ^ y[..., 0]) | (x[..., 2] ^ y[..., 2])).astype(np.int16)
        off += np.bitwise_count((x[..., 1] ^ y[..., 1]) | (x[..., 3] ^ y[..., 3]))
        small, large = np.minimum(self.size[a], self.size[b]), np.maximum(self.size[a], self.size[b])
        return (off <= self.reach) & (small * self.den >= large * self.num) & ~(self.top[a] & self.top[b])


def _branch(members: Members, at: np.ndarray, tokens: np.ndarray, salt: int, groups: Groups) -> None:
    """Join the near members ``at`` of one node: by its children where these are cheaper, else exhaustively."""
    m = len(at)
    if m > LEAF:
        children = []
        for j in range(BRANCHES):
            values = tokens[at, (salt * (j + 1) + 7 * j) % TREE_COORDS]
            order = np.argsort(values, kind="stable")
            children += np.split(at[order], np.flatnonzero(np.diff(values[order])) + 1)
        if sum(len(c) ** 2 for c in children) * 2 < m * m:
            for k, child in enumerate(children):
                if len(child) > 1:
                    _branch(members, child, tokens, (salt * 0x9E3779B1 + k + 1) % (1 << 61), groups)
            return
    for lo in range(0, m - 1, 256):
        rows = at[lo : lo + 256]
        rest = at[lo:]
        found = members.near(rows[:, None], rest[None, :])
        for i, row in enumerate(found):
            row[: i + 1] = False
            if row.any():
                groups.join(np.append(rest[row], rows[i]))


def _lists(batches: Iterator[pa.RecordBatch], reach: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Lists of classes that near sketches join inside a node: ``gid`` (a digest of the list), ``members``."""
    for batch in _runs(batches, "node"):
        members = Members(batch, reach, num, den)
        node = batch.column("node").to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        lens = np.diff(np.append(starts, len(node)))
        groups = Groups(len(node))
        sets: list[np.ndarray] = []
        # Nodes of equal small size are compared together, larger ones each on their own.
        for m in np.unique(lens[(lens > 1) & (lens <= LEAF)]):
            i, j = np.triu_indices(m, 1)
            of_size = starts[lens == m]
            for lo in range(0, len(of_size), max(1, 500_000 // len(i))):
                base = of_size[lo : lo + max(1, 500_000 // len(i)), None]
                a, b = (base + i).ravel(), (base + j).ravel()
                found = members.near(a, b)
                near: dict[int, list[tuple[int, int]]] = {}
                heads = np.repeat(base[:, 0], len(i))[found]
                for head, x, y in zip(heads.tolist(), a[found].tolist(), b[found].tolist(), strict=True):
                    near.setdefault(head, []).append((x - head, y - head))
                for head, pairs in near.items():
                    part = Groups(int(m))
                    for pair in pairs:
                        part.join(np.array(pair))
                    sets += [head + s for s in part.sets()]
        for start, m in zip(starts[lens > LEAF].tolist(), lens[lens > LEAF].tolist(), strict=True):
            part = Groups(m)
            tokens = members.tokens(start, start + m)
            one = Members(batch.slice(start, m), reach, num, den)
            _branch(one, np.arange(m), tokens, int(node[start]) % (1 << 61), part)
            sets += [start + s for s in part.sets()]
        gids, lists = [], []
        for found in sets:
            # A list of more shingles than a task holds is dealt as all pairs of its blocks.
            block = (np.cumsum(members.size[found]) - 1) // (ELEMENTS // 2)
            parts = [found[block == k] for k in np.unique(block)]
            if len(parts) > 1:
                parts = [np.append(x, y) for k, x in enumerate(parts) for y in parts[:k]]
            for part in parts:
                keys = sorted(batch.column("cls").take(pa.array(part)).to_pylist())
                gids.append(hashlib.blake2b(b"".join(keys), digest_size=16).digest())
                lists.append(keys)
        if gids:
            yield pa.RecordBatch.from_arrays([pa.array(gids, pa.binary()), pa.array(lists, pa.list_(pa.binary()))], ["gid", "members"])


def link_sets(sets: list[np.ndarray], num: int, den: int) -> Groups:
    """The sets of a list joined by den * intersection >= num * union, exactly.

    The sets that hold the most common shingles are compared with all others first; after that only
    those outside the largest component are, in blocks of rows. Intersections with shingles that many
    sets hold are a matrix product, with the others a count of postings.
    """
    m = len(sets)
    groups = Groups(m)
    size = np.array([len(s) for s in sets], np.int64)
    if m == 2:
        inter = len(np.intersect1d(*sets, assume_unique=True))
        if inter * den >= (size.sum() - inter) * num:
            groups.join(np.arange(2))
        return groups
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    starts = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    held = np.diff(np.append(starts, len(flat)))
    column, count = np.repeat(np.arange(len(starts)), held), np.repeat(held, held)
    common = count > max(8, m // 8)
    wide = np.flatnonzero(held > max(8, m // 8))
    dense = np.zeros((m, len(wide)), np.float32)
    dense[owner[common], np.searchsorted(wide, column[common])] = 1
    rare = np.flatnonzero((count > 1) & ~common)
    rare = rare[np.argsort(owner[rare], kind="stable")]
    first = np.searchsorted(owner[rare], np.arange(m + 1))

    def absorb(rows: np.ndarray) -> None:
        inter = (dense[rows] @ dense.T).astype(np.int64)
        for i, row in enumerate(rows):
            of = rare[first[row] : first[row + 1]]
            if len(of):
                n = count[of]
                skip = np.repeat(starts[column[of]] - np.cumsum(n) + n, n)
                inter[i] += np.bincount(owner[skip + np.arange(n.sum())], minlength=m)
        linked = inter * den >= (size[rows][:, None] + size[None, :] - inter) * num
        for i, row in enumerate(rows):
            linked[i, row] = True
            groups.join(np.flatnonzero(linked[i]))

    shared = np.bincount(owner, weights=count, minlength=m)
    lead = np.argsort(-shared, kind="stable")[:32]
    absorb(lead)
    top = np.bincount(groups.label).argmax()
    rest = np.setdiff1d(np.flatnonzero(groups.label != top), lead)
    for lo in range(0, len(rest), 128):
        absorb(rest[lo : lo + 128])
    return groups


def _linked(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Edges ``(a, b)`` from every member of a list to the least class that it is connected with there."""
    for batch in _runs(batches, "gid"):
        gids = batch.column("gid").to_pylist()
        keys = batch.column("cls").to_pylist()
        grams = batch.column("grams")
        edges, at = [], 0
        while at < len(gids):
            end = at + 1
            while end < len(gids) and gids[end] == gids[at]:
                end += 1
            if end - at > 1:
                sets = [grams[i].values.to_numpy().view(np.uint64) for i in range(at, end)]
                for found in link_sets(sets, num, den).sets():
                    names = sorted(keys[at + i] for i in found)
                    edges += [(name, names[0]) for name in names[1:]]
            at = end
        if edges:
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.binary()) for k in (0, 1)], ["a", "b"])


def _confirm(docs: DataFrame, classes: DataFrame, lists: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Edges ``(a, b)`` between the classes of each list that are linked on their full sets."""
    asked = lists.select("gid", F.explode("members").alias("cls"))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_SLOTS))
    slots = classes.select("cls", "doc_id").join(asked.select("cls").distinct(), "cls", "left_semi")
    slots = slots.select(slot.alias("slot")).distinct()
    few = docs.select("doc_id", "text").withColumn("slot", slot).join(F.broadcast(slots), "slot", "left_semi")
    sets = features(few, width, 0, with_sets=True).dropDuplicates(["cls"]).select("cls", "grams")
    met = asked.join(sets, "cls").repartition("gid").sortWithinPartitions("gid")
    return met.mapInArrow(functools.partial(_linked, num=num, den=den), "a binary, b binary")


DEALT = ("node", "cls", "n", *SKETCH, "sig", "top")


def _chunks(rows: DataFrame, chunks: Column) -> DataFrame:
    """Members of large nodes in chunks of their node, each chunk a node of its own to be compared in."""
    dealt = rows.select(*DEALT, F.explode(chunks).alias("chunk"))
    return dealt.withColumn("node", F.xxhash64("node", "chunk")).drop("chunk")


def _place(key: str, k: Column) -> Column:
    return F.pmod(F.xxhash64(key), k).cast("int")


def _count(n: Column, local: int) -> Column:
    """Chunks of half of ``local`` members each: two of them, or one and as many others, meet in a task."""
    return F.greatest(F.ceil(n / (local // 2)), F.lit(1)).cast("int")


def _deal(large: DataFrame, local: int, last: bool) -> DataFrame:
    """Every member of a node of ``size`` members in one chunk and a few pivots in all, or each two chunks together.

    Pivots are the members whose hash falls below a bound that ``PIVOTS`` of them pass on average.
    """
    k = _count(F.col("size"), local)
    mine, all_of = _place("cls", k), F.sequence(F.lit(0), k - 1)
    if last:
        chunks = F.transform(all_of, lambda j: F.least(j, mine) * k + F.greatest(j, mine))
    else:
        pivot = F.pmod(F.xxhash64(F.lit(1), "cls"), F.col("size")) < PIVOTS
        chunks = F.when(pivot, all_of).otherwise(F.array(mine))
    return _chunks(large.withColumn("top", F.lit(False)), chunks)


def _finish(rest: DataFrame, local: int) -> DataFrame:
    """Nodes with at most a chunk of ``others`` outside their top component: these meet every chunk of it."""
    k = _count(F.col("size") - F.col("others"), local)
    return _chunks(rest, F.when(F.col("top"), F.array(_place("cls", k))).otherwise(F.sequence(F.lit(0), k - 1)))


def _open_nodes(large: DataFrame, comps: DataFrame) -> DataFrame:
    """Members of nodes that are not of one component, with ``others`` and whether they are of the largest one."""
    named = large.join(comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    parts = named.groupBy("node", "comp").agg(F.count("*").alias("k"))
    most = F.max(F.struct("k", "comp"))
    parts = parts.groupBy("node").agg((F.sum("k") - most.getField("k")).alias("others"), most.getField("comp").alias("lead"))
    return named.join(parts.where("others > 0"), "node").withColumn("top", F.col("comp") == F.col("lead"))


def near_duplicates(
    docs: DataFrame,
    threshold: float = 0.8,
    width: int = 2,
    trees: int = 8,
    local: int = LOCAL,
    max_depth: int = 6,
) -> DataFrame:
    """Near-duplicate component of each row of ``docs(doc_id, text, ...)``.

    Returns ``doc_id, n_shingles, component_id, kept``: the size of the row's shingle set, the
    smallest doc_id it reaches over links of Jaccard similarity ``threshold`` or more (itself
    included), and whether that is its own. Other columns of ``docs`` are ignored, whatever their
    names. A null or empty text has an empty set and is linked with nothing, not even another empty
    one. Repeated rows stay rows; rows of one doc_id and different texts are separate documents. A
    row without doc_id takes part in links and is kept only if nothing with an id is in its
    component. Texts of any length are hashed whole, a mebibyte at a time. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    num, den = round(threshold * 100), 100
    reach = sketch_reach(threshold)
    wide = scratch.save(features(docs, width, trees))
    classes = scratch.save(
        wide.where("n_shingles > 0")
        .groupBy("cls")
        .agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n"), *[F.first(c).alias(c) for c in (*SKETCH, "roots", "sig")])
    )
    feats = scratch.save(wide.select("doc_id", "n_shingles", "cls"))
    scratch.drop(wide)
    keys = [
        F.struct(F.xxhash64(F.lit(c), F.substring("roots", 4 * c + 1, 4)).alias("node"), F.lit(c // BRANCHES).alias("tree"))
        for c in range(trees * BRANCHES)
    ]
    held = ["cls", "n", *SKETCH]
    rows = classes.select(*held, "sig", F.explode(F.array(*keys)).alias("root")).select(
        "root.node", *held, F.substring(F.col("sig"), F.col("root.tree") * (2 * TREE_COORDS) + 1, F.lit(2 * TREE_COORDS)).alias("sig")
    )
    finish = links = None
    for depth in range(max_depth + 1):
        sizes = scratch.save(rows.groupBy("node").agg(F.count("*").alias("size")).where(F.col("size") > local))
        done, last = sizes.isEmpty(), depth == max_depth
        asked = rows.withColumn("top", F.lit(False)).select(*DEALT)
        if not done:
            large = scratch.save(rows.join(sizes, "node"))
            asked = asked.join(sizes, "node", "left_anti").unionByName(_deal(large, local, last))
        if finish is not None:
            asked = asked.unionByName(finish)
        met = asked.repartition("node").sortWithinPartitions("node")
        lists = met.mapInArrow(functools.partial(_lists, reach=reach, num=num, den=den), "gid binary, members array<binary>")
        lists = scratch.save(lists.dropDuplicates(["gid"]))
        found = scratch.save(_confirm(docs, classes, lists, width, num, den))
        scratch.drop(lists)
        links = found if links is None else links.unionByName(found)
        if done or last:
            break
        comps = merge_components(links, scratch)
        rest = scratch.save(_open_nodes(large, comps))
        scratch.drop(comps, large, sizes)
        finish = _finish(rest.where(F.col("others") <= local // 2), local)
        at = lambda j: F.pmod(F.xxhash64("node", F.lit(j)), F.lit(TREE_COORDS)).cast("int")
        child = [F.xxhash64("node", F.lit(j), F.substring(F.col("sig"), at(j) * 2 + 1, F.lit(2))) for j in range(BRANCHES)]
        rows = rest.where(F.col("others") > local // 2).select(F.explode(F.array(*child)).alias("node"), *held, "sig")
    return _labelled(feats, classes, merge_components(links, scratch))


def _labelled(feats: DataFrame, classes: DataFrame, comps: DataFrame) -> DataFrame:
    """Rows of ``feats`` with the least document id of their component."""
    roots = classes.select("cls", "doc_id")
    linked = comps.join(roots, "cls")
    heads = linked.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    linked = linked.select("cls", "comp").join(heads, "comp").select("cls", "component_id")
    ids = roots.join(linked, "cls", "left").select("cls", F.coalesce("component_id", "doc_id").alias("component_id"))
    some = feats.where("n_shingles > 0").select("doc_id", "n_shingles", "cls").join(ids, "cls", "left")
    none = feats.where("n_shingles = 0").select("doc_id", "n_shingles", "cls", F.col("doc_id").alias("component_id"))
    return some.unionByName(none).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def keep_one(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those that ``found`` does not keep: one of each component stays.

    Rows with an empty text are each their own component and stay. Of rows that repeat with id and
    text, one stays.
    """
    scratch = Scratch(docs.sparkSession, "keep-one")
    ids = found.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    ids = scratch.save(ids.where("not kept or n > 1"))
    rest = without_keys(docs, ids.select("doc_id"), "doc_id")
    twice = only_keys(docs, ids.where("kept").select("doc_id"), "doc_id")
    return rest.unionByName(twice.dropDuplicates(["doc_id", "text"]))

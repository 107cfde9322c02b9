"""Byte-level BPE encoding and decoding.

A text is cut by the tokenizer's pattern and every match is encoded on its own. The merges of a match
run over a segment tree on byte positions: a leaf holds the merge rank of the live symbol that starts
there with its right neighbour, an inner node the leftmost least rank below it. The root names the
next merge, and a merge updates at most three leaves, each in logarithmic time, so a match of ``n``
bytes costs ``O(n log n)`` however long it is.

The trees of a batch's new matches stand side by side in one array per width, and a step merges once
in every tree that is not done; a match longer than the widest array has a tree of its own.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from geopressure.llm.tasks import lean

#: Encoded words, and matches inside them, that a task keeps: so many new ones, and as many older ones.
WORDS, MATCHES = 150_000, 50_000
NONE = 1 << 62
#: Widths of the trees that stand side by side.
WIDTHS = (8, 16, 32, 64)


def load_ranks(path: str) -> bytes:
    """The rank file's content, to be handed to :func:`encode` and :func:`decode`."""
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The token ids of one match."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    leaves = 1 << (n - 1).bit_length()
    tree = [NONE] * (2 * leaves)
    for i in range(n - 1):
        if (rank := ranks.get(piece[i : i + 2])) is not None:
            tree[leaves + i] = rank << 32 | i
    for k in range(leaves - 1, 0, -1):
        x, y = tree[2 * k], tree[2 * k + 1]
        tree[k] = x if x < y else y
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        k = leaves + i
        tree[k] = value
        k >>= 1
        while k:
            x, y = tree[2 * k], tree[2 * k + 1]
            x = x if x < y else y
            if tree[k] == x:
                break
            tree[k] = x
            k >>= 1

    def pair(i: int) -> int:
        j = after[i]
        if j >= n:
            return NONE
        rank = ranks.get(piece[i : after[j]])
        return NONE if rank is None else rank << 32 | i

    while (best := tree[1]) < NONE:
        i = best & 0xFFFFFFFF
        gone = after[i]
        after[i] = after[gone]
        if after[i] < n:
            before[after[i]] = i
        put(gone, NONE)
        put(i, pair(i))
        if (left := before[i]) >= 0:
            put(left, pair(left))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Forest:
    """Merges many matches at once, one segment tree each, by steps over whole arrays."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.first = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], NONE)
        self.merged = np.append(np.fromiter(pairs.values(), np.int64, len(pairs))[order], 0)

    def _leaf(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leaf values of pairs of symbols at positions; NONE where a symbol is missing or no merge is."""
        key = left << 32 | right
        found = np.searchsorted(self.keys, key)
        hit = (self.keys[found] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.merged[found] << 8 | at, NONE)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Packed 32-bit ids of every piece."""
        out: list[bytes] = [b""] * len(pieces)
        groups: dict[int, list[int]] = {w: [] for w in WIDTHS}
        for i, piece in enumerate(pieces):
            if (whole := self.ranks.get(piece)) is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(piece) > WIDTHS[-1]:
                out[i] = np.array(merge(piece, self.ranks), np.int32).tobytes()
            else:
                groups[next(w for w in WIDTHS if len(piece) <= w)].append(i)
        for width, members in groups.items():
            if members:
                for i, ids in zip(members, self._side_by_side([pieces[i] for i in members], width), strict=True):
                    out[i] = ids
        return out

    def _side_by_side(self, pieces: list[bytes], width: int) -> list[bytes]:
        count, span = len(pieces), 2 * width
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(count, width)
        size = np.fromiter(map(len, pieces), np.int64, count)
        place = np.arange(width)
        # One column more stands for what lies before the first and after the last symbol.
        symbol = np.full((count, width + 1), -1, np.int64)
        symbol[:, :width] = np.where(place < size[:, None], self.first[raw], -1)
        after = np.minimum(np.tile(np.arange(1, width + 2), (count, 1)), size[:, None])
        after[after == size[:, None]] = width
        before = np.tile(np.arange(-1, width), (count, 1))
        before[:, 0] = width
        tree = np.full((count, span), NONE, np.int64)
        right = np.take_along_axis(symbol, after[:, :width], 1)
        tree[:, width:] = self._leaf(symbol[:, :width], right, place)
        level = width
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        symbols, afters, befores, nodes = symbol.ravel(), after.ravel(), before.ravel(), tree.ravel()
        alive = np.flatnonzero(tree[:, 1] < NONE)
        while len(alive):
            row, base = alive * (width + 1), alive * span
            root = nodes[base + 1]
            i, made = root & 0xFF, root >> 8
            gone = afters[row + i]
            follows = afters[row + gone]
            leads = befores[row + i]
            symbols[row + i], symbols[row + gone] = made, -1
            afters[row + i] = follows
            befores[row + follows] = i
            nodes[base + width + i] = self._leaf(made, symbols[row + follows], i)
            nodes[base + width + gone] = NONE
            # Before the first symbol stands the spare column, whose leaf would be out of the tree: rewrite i's.
            has = leads < width
            lead_leaf = self._leaf(symbols[row + leads], made, leads)
            nodes[(base + width + leads)[has]] = lead_leaf[has]
            paths = [(width + x) >> 1 for x in (i, gone, np.where(has, leads, i))]
            while paths[0][0]:
                for node in paths:
                    at = base + 2 * node
                    nodes[base + node] = np.minimum(nodes[at], nodes[at + 1])
                paths = [node >> 1 for node in paths]
            alive = alive[nodes[base + 1] < NONE]
        kept = symbol[:, :width] >= 0
        flat = symbol[:, :width][kept].astype(np.int32).tobytes()
        ends = 4 * np.cumsum(kept.sum(axis=1))
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


class Recent:
    """A mapping of bounded size: the newest entries, and the generation before them."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, keys: set[str]) -> set[str]:
        """The keys that are not known; those of the older generation are taken over."""
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        rest = keys - self.new.keys()
        for key in rest & self.old.keys():
            self.new[key] = self.old[key]
        return rest - self.old.keys()


class Encoder:
    """Encodes whole texts into packed 32-bit ids; remembers what it has encoded lately."""

    def __init__(self, data: bytes, pattern: str) -> None:
        self.forest = Forest(parse_ranks(data))
        # The pattern's \s is Unicode's White_Space; Python's has four control characters more.
        spaces = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.cut = regex.compile(spaces).findall
        # A text may be cut before each blank unless a blank lies inside or at the end of white space.
        self.tangled = regex.compile(r"\p{White_Space} (?=\p{White_Space})|\p{White_Space} $").search
        self.letters = r" ?\p{L}+" in pattern
        self.matches, self.words = Recent(MATCHES), Recent(WORDS)

    def _learn(self, matches: set[str]) -> None:
        new = list(self.matches.missing(matches))
        self.matches.new.update(zip(new, self.forest.merge([m.encode() for m in new]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of every text."""
        parts = [None if self.tangled(text) else text.split(" ") for text in texts]
        known: set[str] = set()
        for some in parts:
            if some:
                known.update(some[1:])
        new = self.words.missing(known)
        # Letters after a blank are one match under the pattern's first general branch.
        plain = self.letters
        cuts = {word: [" " + word] if plain and word.isalpha() else self.cut(" " + word) for word in new}
        heads = [self.cut(text if some is None else some[0]) for text, some in zip(texts, parts, strict=True)]
        self._learn({m for cut in cuts.values() for m in cut}.union(*heads))
        match = self.matches.new.__getitem__
        for word, cut in cuts.items():
            self.words.new[word] = b"".join(map(match, cut))
        word = self.words.new.__getitem__
        return [
            b"".join([*map(match, head), *(map(word, some[1:]) if some else ())]) for head, some in zip(heads, parts, strict=True)
        ]


class Decoder:
    """Turns token ids back into bytes."""

    def __init__(self, data: bytes) -> None:
        ranks = parse_ranks(data)
        self.tokens = np.empty(max(ranks.values()) + 1, object)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def decode(self, ids: pa.ListArray) -> pa.Array:
        flat, offsets = ids.flatten().to_numpy(), np.cumsum([0, *ids.value_lengths().fill_null(0).to_pylist()])
        return pa.array([b"".join(self.tokens[flat[a:b]]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())


@lean
def _encode(batches: Iterator[pa.RecordBatch], data, pattern: str, back: bool) -> Iterator[pa.RecordBatch]:
    encoder, decoder = Encoder(data.value, pattern), Decoder(data.value) if back else None
    for batch in batches:
        packed = encoder.encode([text or "" for text in batch.column("text").to_pylist()])
        offsets = np.cumsum([0, *(len(x) // 4 for x in packed)]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))
        columns = {"doc_id": batch.column("doc_id").cast(pa.int64()), "ids": ids}
        if decoder is not None:
            columns["decoded"] = decoder.decode(ids)
        yield pa.RecordBatch.from_pydict(columns)


@lean
def _decode(batches: Iterator[pa.RecordBatch], data) -> Iterator[pa.RecordBatch]:
    decoder = Decoder(data.value)
    for batch in batches:
        ids = batch.column("ids")
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, decoder.decode(ids)], ["doc_id", "ids", "decoded"])


def encode(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """``doc_id, ids array<int>``: the token ids of every whole text, without special tokens.

    ``ranks`` is the content of a rank file (see :func:`load_ranks`), sent to each executor once. A
    null or empty text has no ids; rows that repeat or lack an id stay as they are; other columns of
    ``docs`` are ignored.
    """
    data = docs.sparkSession.sparkContext.broadcast(ranks)
    return docs.select("doc_id", "text").mapInArrow(
        functools.partial(_encode, data=data, pattern=pattern, back=False), "doc_id long, ids array<int>"
    )


def round_trip(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """``doc_id, ids, decoded`` of every whole text: as :func:`encode`, then :func:`decode`, in one task each."""
    data = docs.sparkSession.sparkContext.broadcast(ranks)
    run = functools.partial(_encode, data=data, pattern=pattern, back=True)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def decode(encoded: DataFrame, ranks: bytes) -> DataFrame:
    """``doc_id, ids, decoded binary``: the bytes that the ids stand for (null ids: none)."""
    data = encoded.sparkSession.sparkContext.broadcast(ranks)
    return encoded.select("doc_id", "ids").mapInArrow(
        functools.partial(_decode, data=data), "doc_id long, ids array<int>, decoded binary"
    )

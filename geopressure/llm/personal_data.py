"""Personal data by a skip-chain conditional random field over base patterns.

Four patterns give the base spans. The field's nodes are the base spans of a document and its other
tokens that hold a digit or an at sign (and the beginnings of number runs too long to be a phone); its labels are the four kinds and "none". Edges join
consecutive nodes (the chain) and, over any distance, nodes that repeat or resemble one another: the
same letters and digits, or the same last seven digits (the skips). Node weights look at a token's
shape and at the word before it, edge weights at pairs of labels; all are fitted by pseudo-likelihood
on a bounded sample that the base patterns label. Loopy message passing with the base spans held at
their kind then gives every other token its label in the light of the whole document, and a token
whose label is one of the kinds with enough certainty is added. Base spans always stay.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopressure.llm.store import Scratch
from geopressure.llm.tasks import lean

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)
LABELS = NONE + 1
#: Least certainty of an added span, and rounds of message passing.
CERTAIN, ROUNDS, DAMPING = 0.9, 12, 0.3
CUES = 32
N_FEATURES = 15 + CUES
SKIP_DIGITS = 7

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A later start in a run of digits matches only if the first one does, so only that is tried.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARK = re.compile(r"[0-9@]\S*")
NUMBER = re.compile(r"[^\x20]+")
NOT_DIGIT = re.compile(r"[^0-9]")


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of the local part, an at sign and a dotted domain."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            out.append((start, match.end()))
            free = match.end()
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base patterns, in order of start, then kind."""
    out = []
    if "@" in text:
        out += [(s, 0, e) for s, e in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


class Node:
    """A candidate: where it is, its features, its skip keys, and its base kind or NONE."""

    __slots__ = ("base", "end", "features", "keys", "start")

    def __init__(self, text: str, start: int, end: int, base: int, before: str) -> None:
        self.start, self.end, self.base = start, end, base
        token = text[start:end]
        digits = NOT_DIGIT.sub("", token)
        n = len(digits)
        letters = sum(ch.isalpha() for ch in token)
        features = [
            1.0,
            float("@" in token),
            float("+" in token),
            float(token.count(".") == 3),
            float(token.count(".") in (1, 2)),
            float(bool(set(token) & set("()"))),
            float("-" in token),
            float(7 <= n <= 8),
            float(9 <= n <= 15),
            float(12 <= n <= 19),
            float(n > 19),
            float(letters > 0),
            min(n, 20) / 20,
            float(12 <= n <= 19 and not letters and not luhn(digits)),
            float(bool(IP.fullmatch(token)) and base == NONE),
        ]
        cue = [0.0] * CUES
        if before:
            cue[zlib.crc32(before.lower().encode("utf-8", "surrogatepass")) % CUES] = 1.0
        self.features = np.array(features + cue, np.float32)
        plain = "".join(ch for ch in token.lower() if ch.isalnum() or ch == "@")
        self.keys = [plain] if len(plain) >= 4 else []
        if n >= SKIP_DIGITS and not letters:
            self.keys.append("#" + digits[-SKIP_DIGITS:])


def nodes(text: str, base: list[tuple[int, int, int]]) -> list[Node]:
    """The field's nodes in order: base spans, and other marked tokens that overlap none."""
    spans, reach, taken = [], -1, []
    for start, kind, end in base:
        if start >= reach:
            spans.append((start, end, kind))
            taken.append([start, end])
        reach = max(reach, end)
        taken[-1][1] = reach
    # A run of numbers after a plus sign that is no base span begins with what may be one.
    heads = {}
    for m in PHONE.finditer(text) if "+" in text else ():
        n = 0
        for part in NUMBER.finditer(text, m.start(), m.end()):
            n += sum(ch.isdigit() for ch in part[0])
            if n >= 9:
                if n <= 15 and part.end() < m.end():
                    heads[m.start()] = part.end()
                break
    k, free = 0, 0
    for m in MARK.finditer(text):
        start = m.start()
        if start < free:
            continue
        while start > free and not text[start - 1].isspace():
            start -= 1
        end = max(m.end(), heads.get(start, 0))
        free = end
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if k < len(taken) and taken[k][0] < end:
            continue
        trimmed = text[start:end].strip(".,;:!?\"'<>[]{}|")
        if trimmed:
            start = text.index(trimmed, start)
            spans.append((start, start + len(trimmed), NONE))
    spans.sort()
    out = []
    for start, end, kind in spans:
        before = text[max(0, start - 24) : start].split()
        out.append(Node(text, start, end, kind, before[-1].strip(":=") if before else ""))
    return out


def edges(found: list[Node]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges between neighbours, skip edges to the last node with the same key."""
    chain = [(i, i + 1) for i in range(len(found) - 1)]
    last: dict[str, int] = {}
    skips = set()
    for i, node in enumerate(found):
        for key in node.keys:
            if key in last:
                skips.add((last[key], i))
            last[key] = i
    return chain, sorted(skips)


class Weights:
    """Weights of node features, of chain pairs and of skip pairs of labels."""

    def __init__(self, node: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> None:
        self.node, self.chain, self.skip = node, chain, skip


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(found: list[Node], weights: Weights) -> np.ndarray:
    """Label probabilities of every node by loopy sum-product message passing."""
    local = np.array([n.features for n in found], float) @ weights.node
    for i, node in enumerate(found):
        if node.base != NONE:
            local[i] = -40.0
            local[i, node.base] = 0.0
    chain, skips = edges(found)
    links = [(a, b, weights.chain) for a, b in chain] + [(a, b, weights.skip) for a, b in skips]
    if not links:
        return np.exp(local - _log_sum(local, 1)[:, None])
    a = np.array([x for x, _, _ in links] + [y for _, y, _ in links])
    b = np.array([y for _, y, _ in links] + [x for x, _, _ in links])
    pair = np.array([w for _, _, w in links] + [w.T for _, _, w in links])
    back = np.concatenate([np.arange(len(links), 2 * len(links)), np.arange(len(links))])
    message = np.zeros((len(a), LABELS))
    for _ in range(ROUNDS):
        total = local.copy()
        np.add.at(total, b, message)
        sent = (total[a] - message[back])[:, :, None] + pair
        new = _log_sum(sent, 1)
        new -= _log_sum(new, 1)[:, None]
        change = np.abs(new - message).max()
        message = (1 - DAMPING) * new + DAMPING * message
        if change < 1e-4:
            break
    total = local.copy()
    np.add.at(total, b, message)
    return np.exp(total - _log_sum(total, 1)[:, None])


def spans(text: str, weights: Weights) -> list[tuple[int, int, int, bool]]:
    """``(start, kind, end, base)`` of all spans, in order of start, then kind."""
    base = base_spans(text)
    out = [(s, k, e, True) for s, k, e in base]
    found = nodes(text, base)
    if any(n.base == NONE for n in found):
        p = marginals(found, weights)
        for node, row in zip(found, p, strict=True):
            k = int(row.argmax())
            if node.base == NONE and k != NONE and row[k] >= CERTAIN:
                out.append((node.start, k, node.end, False))
    out.sort()
    return out


def _bare(token: str, kind: int) -> str | None:
    """A base span as it is repeated without the marks that the patterns ask for; None where it has none."""
    if kind == KINDS.index("phone"):
        return "-".join(re.findall("[0-9]+", token)[1:]) or None
    if kind == KINDS.index("card"):
        # One digit is off, so that the check sum fails.
        return str((int(token[0]) + 1) % 10) + token[1:]
    return token.split(".")[0] if kind == KINDS.index("email") and "@" in token.split(".")[0] else None


def _training_rows(text: str) -> list[tuple[list[float], int, list[float], list[float]]]:
    """Per node: features, label, and counts of the neighbours' labels along chain and skip edges.

    The base patterns never label what they cannot match, so every base span also gives its bare form,
    skip-linked to it, with its label: from these the field learns what a repeat is worth. Bare phones and addresses
    count without the link too; a bare card does not, for it looks like any other long number.
    """
    found = nodes(text, base_spans(text))
    chain, skips = edges(found)
    beside = [[[0.0] * LABELS for _ in range(2)] for _ in found]
    for k, links in enumerate((chain, skips)):
        for a, b in links:
            beside[a][k][found[b].base] += 1
            beside[b][k][found[a].base] += 1
    # A node linked with a base span is left out if it is none: it may be a repeat, so its label is not known.
    known = [n.base != NONE or not any(x[1][:NONE]) for n, x in zip(found, beside, strict=True)]
    rows = [(n.features.tolist(), n.base, *x) for n, x, sure in zip(found, beside, known, strict=True) if sure]
    for node in found:
        if node.base != NONE and (bare := _bare(text[node.start : node.end], node.base)):
            features = Node(bare, 0, len(bare), NONE, "").features.tolist()
            link = [float(k == node.base) for k in range(LABELS)]
            rows.append((features, node.base, [0.0] * LABELS, link))
            if node.base != KINDS.index("card"):
                rows.append((features, node.base, [0.0] * LABELS, [0.0] * LABELS))
    return rows


@lean
def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [r for text in batch.column("text").to_pylist() for r in _training_rows(text or "")]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[1] for r in rows], pa.int32()), pa.array([r[0] + r[2] + r[3] for r in rows], pa.list_(pa.float64()))],
            ["label", "x"],
        )


def pseudo_likelihood(x: np.ndarray, label: np.ndarray, steps: int = 300, penalty: float = 0.02, times: np.ndarray | None = None) -> Weights:
    """Fit all weights by gradient steps on the sum of each node's likelihood given its neighbours, row ``i`` counted ``times[i]`` times.

    A skip joins nodes that look alike, so its weights start from a preference for equal labels, which
    the penalty pulls towards: a sample with few skips keeps it.
    """
    w = np.zeros((x.shape[1], LABELS))
    prior = np.zeros_like(w)
    prior[-LABELS:] = 3.0 * np.eye(LABELS) - 0.5
    prior[-1] = 0.0
    w += prior
    target = np.eye(LABELS)[label]
    scale = np.maximum(1.0, np.abs(x).max(axis=0)) if len(x) else 1.0
    z = x / scale
    times = np.ones(len(x)) if times is None else times
    share = np.maximum((times[:, None] * target).sum(axis=0), 1.0)
    weight = (times / np.sqrt(share)[label])[:, None]
    weight = weight / weight.sum() if len(x) else weight
    speed = np.zeros_like(w)
    for _ in range(steps if len(x) else 0):
        logits = z @ (w * (scale[:, None] if len(x) else 1.0))
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        slope = x.T @ (weight * (p - target)) + penalty * (w - prior) * 0.05
        speed = 0.9 * speed - 1.0 * slope / np.maximum(1.0, scale[:, None])
        w += speed
    chain, skip = w[N_FEATURES : N_FEATURES + LABELS], w[N_FEATURES + LABELS :]
    return Weights(w[:N_FEATURES], (chain + chain.T) / 2, (skip + skip.T) / 2)


def fit(docs: DataFrame, max_docs: int = 4000, max_nodes: int = 50_000) -> Weights:
    """Fit on at most ``max_docs`` documents of least hash, labelled by the base patterns.

    Equal nodes of these are counted in Spark and come as one row; of the distinct ones a share by hash, about ``max_nodes`` if there are more, reaches the
    driver, so texts of any length send a bounded amount there.
    """
    ids = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id")).limit(max_docs)
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    nodes_ = sample.select("text").mapInArrow(_sampled, "label int, x array<double>").groupBy("label", "x").agg(F.count("*").alias("times"))
    nodes_ = Scratch(docs.sparkSession, "field").save(nodes_)
    share = F.pmod(F.xxhash64("label", "x"), F.lit(max(1, -(-nodes_.count() // max_nodes)))) == 0
    rows = nodes_.where(share).collect()
    rows = sorted((r.label, tuple(r.x), r.times) for r in rows)
    x = np.array([r[1] for r in rows], float).reshape(-1, N_FEATURES + 2 * LABELS)
    return pseudo_likelihood(x, np.array([r[0] for r in rows], int), times=np.array([r[2] for r in rows], float))


SPAN = pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32()), ("base", pa.bool_())])


@lean
def _found(batches: Iterator[pa.RecordBatch], weights: Weights) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [
            [{"start": s, "kind": KINDS[k], "end": e, "base": b} for s, k, e, b in spans(text.as_py() or "", weights)]
            for text in batch.column("text")
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array(rows, pa.list_(SPAN))], ["doc_id", "spans"]
        )


def find(docs: DataFrame, weights: Weights) -> DataFrame:
    """``doc_id, spans`` of every whole text of ``docs(doc_id, text, ...)``.

    ``spans`` is an array of ``(start, kind, end, base)`` in code points, end exclusive, ordered by
    start, then kind as in ``KINDS``; ``base`` tells base spans from added ones. A null or empty text
    has none; a text of any length is read whole, in time linear in it, and held with its nodes; rows that repeat or lack an id stay; other columns are ignored.
    """
    schema = "doc_id long, spans array<struct<start:int,kind:string,end:int,base:boolean>>"
    return docs.select("doc_id", "text").mapInArrow(functools.partial(_found, weights=weights), schema)


def mask(text: str, found: list[tuple[int, int, int, bool]]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping ones become one."""
    out, at = [], 0
    for start, kind, end, _ in found:
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind]}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


@lean
def _masked(batches: Iterator[pa.RecordBatch], weights: Weights) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.names.index("text")
        texts = []
        for value in batch.column("text"):
            text = value.as_py()
            texts.append(mask(text, found) if text and (found := spans(text, weights)) else text)
        columns = list(batch.columns)
        columns[at] = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names)


def redact(docs: DataFrame, weights: Weights) -> DataFrame:
    """``docs`` with its personal data masked; ``n_chars``, where it is a column, follows the text."""
    out = docs.mapInArrow(functools.partial(_masked, weights=weights), docs.schema)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        changed = F.when(F.col("n_chars").isNotNull(), F.length("text").cast(kind))
        out = out.withColumn("n_chars", changed)
    return out

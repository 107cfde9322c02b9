"""Quality classification by co-training of two views.

The content view looks at a text's characters, words and lines; the metadata view at what is known
of it besides (language, source, length and how it is laid out in lines). Each view trains its own
classifier on the labelled sample. In every round each classifier labels the unlabelled rows that it
is surest of, in the balance of the labelled ones, and hands them to the other. The views are calibrated
and combined by a regression on their logits of labelled rows, each row's logits taken from
classifiers that did not see it.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopressure.llm.keys import fresh
from geopressure.llm.logistic import Logistic
from geopressure.llm.tasks import lean
from geopressure.llm.toxicity import held_out

#: Bounds of what is learned from: labelled rows and unlabelled rows, those of least hash.
MAX_LABELLED, MAX_UNLABELLED = 12_000, 6_000
ROUNDS, FOLDS, PENALTY = 4, 4, 0.05
#: Pseudo-labels handed over by each view in each round, and how sure it must be.
HANDED, SURE = 400, 0.97
#: Slots for languages and sources in the metadata view.
SLOTS = 16

N_CONTENT = 22


def content_view(text: str) -> list[float]:
    """Shares of character kinds, repetition of words and lines, and word lengths of a whole text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = len(raw)
    if not n:
        return [0.0] * N_CONTENT
    c = np.bincount(raw, minlength=256)
    words = text.split()
    m = max(1, len(words))
    lines = [line for line in text.split("\n") if line.strip()]
    upper, lower, digits = c[65:91].sum(), c[97:123].sum(), c[48:58].sum()
    marks = c[33:48].sum() + c[58:65].sum() + c[91:97].sum() + c[123:127].sum()
    odd = c[[35, 36, 37, 38, 42, 94, 126, 64]].sum()
    stops = c[46] + c[63]
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    distinct = len(set(words))
    fresh = len(set(zip(words, words[1:], strict=False))) / max(1, len(words) - 1) if len(words) > 1 else 1.0
    letters = max(1, int(upper + lower))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    return [
        upper / letters,
        digits / n,
        marks / m,
        odd / m,
        c[33] / m,
        c[124] / m,
        stops / m,
        c[44] / m,
        c[10] / m,
        same / m,
        distinct / m**0.8,
        1 - len(set(lines)) / max(1, len(lines)),
        float(lengths.mean()),
        float(lengths.std()),
        float(lengths.max() > 40),
        np.log1p(m / max(1, len(lines))),
        (c[128:].sum()) / n,
        max(0.0, 0.4 - distinct / m),
        float(upper / letters > 0.5),
        float(same > 0.08 * m),
        fresh,
        float(fresh < 0.6),
    ]


def metadata_view(text: str, lang: str | None, source: str | None) -> list[float]:
    """What is known of a document without reading it: language, source and length."""
    slots = [0.0] * (2 * SLOTS)
    slots[zlib.crc32((lang or "").encode()) % SLOTS] = 1.0
    slots[SLOTS + zlib.crc32((source or "").encode()) % SLOTS] = 1.0
    n = np.log1p(len(text))
    return [*slots, n, (n - 7) ** 2, float(len(text) < 60)]


@lean
def _viewed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        content = [content_view(r["text"] or "") for r in rows]
        meta = [metadata_view(r["text"] or "", r["lang"], r["source"]) for r in rows]
        kind = pa.list_(pa.float64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("label"), pa.array(content, kind), pa.array(meta, kind)], ["label", "content", "meta"]
        )


class Model(NamedTuple):
    """The two views' classifiers and the regression that combines their logits."""

    content: Logistic
    meta: Logistic
    combined: Logistic

    def probability(self, content: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.content.logit(content), self.meta.logit(meta)
        return self.content.probability(content), self.meta.probability(meta), self.combined.probability(np.stack([a, b], 1))


def co_train(content: np.ndarray, meta: np.ndarray, labels: np.ndarray, handed_over: int = HANDED) -> Model:
    """Train on rows of both views; ``labels`` are 0, 1 or -1 (unlabelled).

    One labelled row in ``FOLDS`` is kept out of the exchange; the regression that combines the views
    is fitted on the logits that the co-trained classifiers give these rows.
    """
    labelled = np.flatnonzero(labels >= 0)
    views = (content, meta)
    aside = np.arange(len(labelled)) % FOLDS == 0
    known, unseen = labelled[~aside], labelled[aside]
    truth = labels[known].astype(float)
    own = [dict(zip(known.tolist(), labels[known].tolist(), strict=True)) for _ in range(2)]
    pool = set(np.flatnonzero(labels < 0).tolist())
    share = truth.mean() if len(known) else 0.5

    def classifier(k: int) -> Logistic:
        at = np.fromiter(own[k], np.int64, len(own[k]))
        return Logistic(views[k][at], np.fromiter(own[k].values(), float, len(at)), PENALTY)

    models = [classifier(0), classifier(1)]
    for _ in range(ROUNDS):
        rest = np.array(sorted(pool), np.int64)
        if not len(rest) or not len(known):
            break
        handed = 0
        for k in (0, 1):
            p = models[k].probability(views[k][rest])
            for label, sure, most in ((1, p, round(handed_over * share)), (0, 1 - p, round(handed_over * (1 - share)))):
                for i in np.argsort(-sure, kind="stable")[:most]:
                    if sure[i] >= SURE and int(rest[i]) in pool:
                        own[1 - k][int(rest[i])] = label
                        pool.discard(int(rest[i]))
                        handed += 1
        if not handed:
            break
        models = [classifier(0), classifier(1)]
    logits = np.stack([models[k].logit(views[k][unseen]) for k in (0, 1)], axis=1).reshape(-1, 2)
    return Model(models[0], models[1], Logistic(logits, labels[unseen].astype(float), penalty=0.1))


def fit(
    docs: DataFrame, labels: DataFrame, labelled: int = MAX_LABELLED, unlabelled: int = MAX_UNLABELLED, handed_over: int = HANDED
) -> Model:
    """Learn from ``docs(doc_id, text, lang, source)`` and ``labels(doc_id, quality)``.

    Uses at most ``labelled`` and ``unlabelled`` rows of least hash, and hands at most ``handed_over``
    pseudo-labels from view to view in a round: more rows cost driver memory (60 numbers each) and
    bring more of the corpus's variety into the exchange; every document is scored whatever they are.
    Rows that are held out (see :func:`geopressure.llm.toxicity.held_out`) or lack an id or a text are
    not used. A doc_id with several labels counts as bad if one of them is.
    """
    order = F.xxhash64("doc_id")
    marked = labels.select("doc_id", F.col("quality").cast("int").alias("label")).where("label in (0, 1)")
    marked = marked.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"))
    marked = marked.orderBy(order).limit(labelled)
    docs = docs.select("doc_id", "text", "lang", "source")
    ids = docs.select("doc_id").where("doc_id is not null and text is not null").where(~held_out(F.col("doc_id")))
    others = ids.join(labels.select("doc_id"), "doc_id", "left_anti").distinct().orderBy(order).limit(unlabelled)
    chosen = marked.unionByName(others.withColumn("label", F.lit(-1)))
    # Bounded by the two parameters: rows of two numbers.
    sample = docs.where("text is not null").join(F.broadcast(chosen), "doc_id")
    rows = (
        sample.select("label", "text", "lang", "source")
        .mapInArrow(_viewed, "label int, content array<double>, meta array<double>")
        .collect()
    )
    if not rows:
        rows = [{"label": -1, "content": content_view(""), "meta": metadata_view("", None, None)}]
    rows = sorted(((r["label"], tuple(r["content"]), tuple(r["meta"])) for r in rows), key=lambda r: zlib.crc32(repr(r).encode()))
    columns = [np.array([r[k] for r in rows], float) for k in range(3)]
    return co_train(columns[1], columns[2], columns[0].astype(int), handed_over)


SCORES = ("content_score", "metadata_score", "score")


@lean
def _scored(batches: Iterator[pa.RecordBatch], model: Model, kept: list[str], prefix: str = "") -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.select(["text", "lang", "source"]).to_pylist()
        content = np.array([content_view(r["text"] or "") for r in rows]).reshape(-1, N_CONTENT)
        meta = np.array([metadata_view(r["text"] or "", r["lang"], r["source"]) for r in rows]).reshape(len(rows), -1)
        if rows:
            scores = [pa.array(s, pa.float64()) for s in model.probability(content, meta)]
        else:
            scores = [pa.array([], pa.float64())] * 3
        yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, *scores], [*kept, *(prefix + n for n in SCORES)])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, content_score, metadata_score, score, keep`` of every row of ``docs``.

    Scores are calibrated probabilities of good quality; ``keep`` is score >= 0.5. Null texts count as
    empty, null languages and sources as empty names. Texts of any length are read whole. Rows that repeat or lack an id stay; columns
    besides doc_id, text, lang and source are ignored.
    """
    rows = docs.select("doc_id", "text", "lang", "source")
    schema = "doc_id long, content_score double, metadata_score double, score double"
    run = functools.partial(_scored, model=model, kept=["doc_id"])
    scored = rows.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, schema)
    return scored.withColumn("keep", F.col("score") >= 0.5)


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, all columns as they were, whatever their names.

    Null and empty texts are scored as empty ones; rows that repeat are kept or dropped alike.
    """
    names = docs.columns
    rows = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    prefix = fresh(names)
    schema += "".join(f", `{prefix}{n}` double" for n in SCORES)
    scored = rows.mapInArrow(functools.partial(_scored, model=model, kept=names, prefix=prefix), schema)
    return scored.where(F.col(f"{prefix}score") >= 0.5).select(*[f"`{n}`" for n in names])

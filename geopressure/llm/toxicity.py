"""Toxicity by a lexicon trie intersected with Levenshtein automata, scored in context windows.

The lexicon is learned: word beginnings and whole words that toxic training texts hold far more often
than clean ones. It is kept as a trie. Every distinct word of a batch drives a nondeterministic
Levenshtein automaton (one bit per position and error count) along the trie's branches, all words in
step, so misspelled terms are found without listing variants. Around each match a window of words tells quotation from
abuse: a match between quotation marks or after a word of saying counts apart from a direct one. The
window sums of a text feed a logistic regression.
"""

from __future__ import annotations

import bisect
import functools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geopressure.llm.logistic import Logistic
from geopressure.llm.tasks import lean

#: Bounds of the sample that is learned from: rows of each class, the least hashes of doc_id.
MAX_TOXIC, MAX_CLEAN = 2500, 5000
#: Lengths of word beginnings that may become terms.
STEMS = range(3, 9)
#: A term is this much likelier in toxic texts, and the chance that any word is so by luck is below DOUBT.
ODDS, DOUBT = 12.0, 0.05
#: Words and word beginnings at least this long are also found with one error.
FUZZY = 5
#: Words on either side that make a match's context.
WINDOW = 8
CACHE = 300_000
#: Words that drive their automata together, and the longest whole word that may be a term.
CHUNK, LONGEST = 20_000, 40

WORD = re.compile(r"[^\W\d_]+")
MARK = re.compile("[\"“”«»„‘]")
SAYING = frozenset("said says wrote called calling quote quoted word term dijo escribió dit écrit mot sagte schrieb wort".split())
N_FEATURES = 9


class Lexicon:
    """Terms with weights in a trie; a term ending in ``$`` must match a whole word."""

    def __init__(self, terms: dict[str, float]) -> None:
        self.names = list(terms)
        self.weights = np.array(list(terms.values()), float)
        self.root: dict = {}
        for k, term in enumerate(self.names):
            node = self.root
            for ch in term.rstrip("$"):
                node = node.setdefault(ch, {})
            node["whole" if term.endswith("$") else "stem"] = k
        self.letters = sorted({ch for term in terms for ch in term.rstrip("$")})
        #: Letters of a word that a match can touch: those of the longest term and one inserted.
        self.reach = max((len(t.rstrip("$")) for t in terms), default=0) + 1
        # Words that match, and tokens that hold none: the newest CACHE of these and the generation before.
        self.hits: dict[str, tuple[str, float, int]] = {}
        self.marked: set[str] = set()
        self.clean: set[str] = set()
        self.older: set[str] = set()

    def learn(self, texts: list[str]) -> None:
        """Look up every word of lower-cased texts that was not seen lately, all at once."""
        new: set[str] = set()
        for text in texts:
            new.update(text.split())
        if len(self.clean) >= CACHE:
            self.older, self.clean = self.clean, set()
        if len(self.marked) >= CACHE:
            self.marked, self.hits = set(), {}
        new -= self.clean
        new -= self.marked
        again = new & self.older
        self.clean |= again
        new -= again
        words_of = {token: WORD.findall(token) for token in new}
        words = sorted({w for words in words_of.values() for w in words if len(w) >= 3 and w not in self.hits})
        for at in range(0, len(words), CHUNK):
            self.hits.update(self.search(words[at : at + CHUNK]))
        for token, words in words_of.items():
            (self.clean if self.hits.keys().isdisjoint(words) else self.marked).add(token)

    def holds(self, text: str) -> bool:
        """Whether a lower-cased text whose words were looked up holds a match."""
        return not self.marked.isdisjoint(text.split())

    def search(self, words: list[str]) -> dict[str, tuple[str, float, int]]:
        """The best term of every word that has one: its name, weight and errors (0 or 1).

        All words drive their automata along the trie together. Bit i of ``zero`` and ``one`` says
        that the first i letters of a word are read with no and with at most one error; a branch is
        left by the words whose bits are all gone.
        """
        if not words or not self.names:
            return {}
        n = self.reach
        codes = np.array([w[:n] for w in words], dtype=f"<U{n}").view(np.uint32).reshape(len(words), n)
        place = np.left_shift(np.uint64(1), np.arange(n, dtype=np.uint64))
        masks = {ch: ((codes == ord(ch)) * place).sum(axis=1, dtype=np.uint64) for ch in self.letters}
        length = np.array([len(w) for w in words])
        end = np.where(length <= n, np.left_shift(np.uint64(1), np.minimum(length, n).astype(np.uint64)), np.uint64(0))
        best = np.full((2, len(words)), -1)
        worth = np.full((2, len(words)), -np.inf)

        def note(term: int, errors: int, at: np.ndarray) -> None:
            better = at[worth[errors, at] < self.weights[term]]
            worth[errors, better] = self.weights[term]
            best[errors, better] = term

        one_bit = np.uint64(1)
        start = np.ones(len(words), np.uint64)
        stack = [(self.root, np.arange(len(words)), start, start * np.uint64(3), 0)]
        while stack:
            node, at, zero, one, depth = stack.pop()
            for kind, term in ((k, node[k]) for k in ("stem", "whole") if k in node):
                ends = end[at] if kind == "whole" else ~np.uint64(0)
                note(term, 0, at[(zero & ends) != 0])
                if depth >= FUZZY:
                    note(term, 1, at[((zero | one) & ends) != 0])
            for ch, child in node.items():
                if len(ch) != 1:
                    continue
                mask = masks[ch][at]
                z = (zero & mask) << one_bit
                o = ((one & mask) << one_bit) | (zero << one_bit) | zero | (z << one_bit)
                o &= (end[at] << one_bit) - one_bit | np.where(length[at] > n, ~np.uint64(0), np.uint64(0))
                left = (z | o) != 0
                if left.any():
                    stack.append((child, at[left], z[left], o[left], depth + 1))
        out = {}
        for i in np.flatnonzero((best >= 0).any(axis=0)).tolist():
            errors = 0 if best[0, i] >= 0 else 1
            term = int(best[errors, i])
            out[words[i]] = (self.names[term], float(self.weights[term]), errors)
        return out


def features(text: str, lexicon: Lexicon) -> list[float]:
    """Window sums of a text whose words were looked up: direct and quoted matches, exact and misspelled, how dense."""
    low = text.lower()
    if not lexicon.holds(low):
        return [0.0] * N_FEATURES
    places = list(WORD.finditer(low))
    words = [m[0] for m in places]
    hits = [(i, got) for i, word in enumerate(words) if (got := lexicon.hits.get(word)) is not None]
    # Words between two marks are quoted; a last mark without partner quotes nothing.
    marks = [m.start() for m in MARK.finditer(low)]
    quoted = {i for i, _ in hits if (k := bisect.bisect(marks, places[i].start())) % 2 and k < len(marks)}
    direct = aside = misspelled = misspelled_aside = top = 0.0
    terms, positions = set(), []
    for i, (term, weight, errors) in hits:
        said = i in quoted or not SAYING.isdisjoint(words[max(0, i - WINDOW) : i])
        if errors:
            misspelled += 0 if said else weight
            misspelled_aside += weight if said else 0
        elif said:
            aside += weight
        else:
            direct += weight
            terms.add(term)
            top = max(top, weight)
            positions.append(i)
    dense = 0
    for a in range(len(positions)):
        b = a
        while b < len(positions) and positions[b] - positions[a] <= 12 * WINDOW and b - a < 8:
            b += 1
        dense = max(dense, b - a)
    return [
        math.log1p(direct),
        min(direct, 20.0),
        top,
        math.log1p(aside),
        math.log1p(misspelled),
        math.log1p(misspelled_aside),
        float(min(len(terms), 6)),
        float(dense),
        1000.0 * direct / (len(words) + 20),
    ]


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            words = set(WORD.findall((text or "").lower()))
            found = {w[:k] for w in words for k in STEMS if len(w) >= k} | {w + "$" for w in words if len(w) >= 3}
            counts[label].update(found)
    for label, got in counts.items():
        items = list(got.items())
        for at in range(0, len(items), 50_000):
            part = items[at : at + 50_000]
            columns = [pa.array([t for t, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())]
            zero = pa.array([0] * len(part), pa.int64())
            toxic, clean = (columns[1], zero) if label else (zero, columns[1])
            yield pa.RecordBatch.from_arrays([columns[0], toxic, clean], ["term", "toxic", "clean"])


def learn_lexicon(sample: DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Terms and log-odds weights from ``sample(text, label)``.

    A term is held by toxic texts at ``ODDS`` times the odds of clean ones or more, by one in 400 toxic
    texts or more, and by so many that none of the words counted is expected to be so by chance: the
    number of words times the Chernoff bound of its split between the classes stays below ``DOUBT``.
    There is no other limit on terms; the sample bounds them.
    """
    counts = sample.mapInArrow(_terms, "term string, toxic long, clean long").groupBy("term")
    counts = counts.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).persist()
    n_terms = counts.count()
    odds = F.log(((F.col("toxic") + 0.5) / (n_toxic + 1)) / ((F.col("clean") + 0.5) / (n_clean + 1)))
    base = max(n_toxic, 1) / max(n_toxic + n_clean, 2)
    seen = F.col("toxic") + F.col("clean")
    split = F.col("toxic") * F.log(F.col("toxic") / seen / base) + F.when(
        F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / seen / (1 - base))
    ).otherwise(0.0)
    ranked = counts.where((F.col("toxic") >= max(3, n_toxic // 400)) & (F.length("term") <= LONGEST))
    ranked = ranked.withColumn("odds", odds).where((F.col("odds") >= math.log(ODDS)) & (split >= math.log(max(n_terms, 1) / DOUBT)))
    rows = ranked.orderBy(F.desc(F.col("odds") * F.col("toxic")), F.desc(F.length("term")), "term").collect()
    counts.unpersist()
    kept: dict[str, float] = {}
    for row in rows:
        plain = row.term.rstrip("$")
        if not any(plain.startswith(t.rstrip("$")) or t.startswith(plain) for t in kept):
            kept[row.term] = round(float(row.odds), 6)
    return kept


def _rows(batch: pa.RecordBatch, lexicon: Lexicon) -> list[list[float]]:
    """The features of a batch's texts, a slice at a time so that few lower-cased texts are held."""
    out = []
    for at in range(0, batch.num_rows, 256):
        texts = [t or "" for t in batch.column("text").slice(at, 256).to_pylist()]
        lexicon.learn([t.lower() for t in texts])
        out += [features(t, lexicon) for t in texts]
    return out


@lean
def _featured(batches: Iterator[pa.RecordBatch], terms: dict[str, float]) -> Iterator[pa.RecordBatch]:
    lexicon = Lexicon(terms)
    for batch in batches:
        rows = _rows(batch, lexicon)
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(rows, pa.list_(pa.float64()))], ["label", "x"])


@lean
def _scored(batches: Iterator[pa.RecordBatch], terms: dict[str, float], model: Logistic) -> Iterator[pa.RecordBatch]:
    lexicon = Lexicon(terms)
    for batch in batches:
        x = np.array(_rows(batch, lexicon)).reshape(-1, N_FEATURES)
        score = pa.array(model.probability(x), pa.float64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), score], ["doc_id", "held_out", "score"]
        )


def held_out(doc_id: Column) -> Column:
    """Whether a document is never learned from: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


class Model:
    """A learned lexicon and the regression over its window sums."""

    def __init__(self, terms: dict[str, float], regression: Logistic) -> None:
        self.terms, self.regression = terms, regression


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``, rows that are not held out.

    At most ``MAX_TOXIC`` and ``MAX_CLEAN`` rows of either class, those of least hash, are used; rows
    with a null id, text or label are not. A doc_id with several labels counts as toxic if one of them is.
    """
    marked = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where("label in (0, 1)")
    marked = marked.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    order = F.xxhash64("doc_id")
    chosen = None
    for label, most in ((1, MAX_TOXIC), (0, MAX_CLEAN)):
        part = marked.where(F.col("label") == label).orderBy(order).limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    # Bounded by MAX_TOXIC + MAX_CLEAN rows of two numbers.
    sample = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").drop("doc_id")
    sample = sample.dropDuplicates(["text"]).persist()
    sizes = {row.label: row["count"] for row in sample.groupBy("label").count().collect()}
    terms = learn_lexicon(sample, sizes.get(1, 0), sizes.get(0, 0))
    rows = sample.mapInArrow(functools.partial(_featured, terms=terms), "label int, x array<double>").collect()
    sample.unpersist()
    x = np.array([row.x for row in rows]).reshape(-1, N_FEATURES)
    return Model(terms, Logistic(x, np.array([float(row.label) for row in rows])))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text of ``docs(doc_id, text, ...)``.

    Texts of any length are read whole, in time linear in their words.
    Null and empty texts get the score of a text without any term. Rows that repeat or lack an id
    stay (without an id: held out); other columns are ignored and never inputs.
    """
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    scored = rows.mapInArrow(
        functools.partial(_scored, terms=model.terms, model=model.regression), "doc_id long, held_out boolean, score double"
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

"""Count-only Viterbi segmentation under a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary's matches by their end, and dynamic programming
carries for each position the best score and the piece count of the path that has it. Ties follow
the tokenizer: a path replaces another only if its score is higher, and paths reach a position in
order of where their last piece begins. A character that no single-character piece begins at has an
unknown edge, ten below the least score; with byte fallback it counts its UTF-8 bytes.

Blanks become ``SPACE`` and one is put in front. No piece holds a ``SPACE`` after another character
(checked when the vocabulary is read), so no path crosses from a word to the blanks after it, and the
words of a text can be counted on their own; with the integral scores of the vocabulary the sums are
exact and the counts equal those of the whole text.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
UNKNOWN = 10.0
CACHE = 300_000


def load_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a vocabulary file, without its control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [
        (model.id_to_piece(i), model.get_score(i))
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
    for piece, _ in pieces:
        if SPACE in piece.lstrip(SPACE):
            raise ValueError(f"piece {piece!r} has a blank inside; words cannot be counted on their own")
    return pieces


class Counter:
    """Counts the pieces of texts; remembers the words it has counted lately."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool) -> None:
        self.matches = ahocorasick.Automaton()
        for piece, score in pieces:
            self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        self.single = {piece for piece, _ in pieces if len(piece) == 1}
        self.unknown = min((score for _, score in pieces), default=0.0) - UNKNOWN
        self.bytes = byte_fallback
        # Counts of words by recency: the newest CACHE, and the generation before them.
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall

    def viterbi(self, text: str) -> int:
        n = len(text)
        best: list[float | None] = [None] * (n + 1)
        count = [0] * (n + 1)
        best[0] = 0.0
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, match in self.matches.iter(text):
            ends[end + 1].append(match)
        single = self.single
        for end in range(1, n + 1):
            top, pieces = None, 0
            for length, score in ends[end]:
                start = end - length
                if (before := best[start]) is not None and (top is None or before + score > top):
                    top, pieces = before + score, count[start] + 1
            if (ch := text[end - 1]) not in single and (top is None or best[end - 1] + self.unknown > top):
                top = best[end - 1] + self.unknown
                pieces = count[end - 1] + (len(ch.encode("utf-8", "surrogatepass")) if self.bytes else 1)
            best[end], count[end] = top, pieces
        return count[n]

    def _word(self, word: str) -> int:
        got = self.older.get(word)
        if got is None:
            got = self.viterbi(word)
        if len(word) <= 64:
            if len(self.known) >= CACHE:
                self.older, self.known = self.known, {}
            self.known[word] = got
        return got

    def count(self, text: str) -> int:
        if not text:
            return 0
        known, total = self.known.get, 0
        for word in self.words(SPACE + text.replace(" ", SPACE)):
            got = known(word)
            total += self._word(word) if got is None else got
        return total


def _count(batches: Iterator[pa.RecordBatch], pieces, byte_fallback: bool) -> Iterator[pa.RecordBatch]:
    counter = Counter(pieces.value, byte_fallback)
    for batch in batches:
        counts = [counter.count(text.as_py() or "") for text in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"]
        )


def token_counts(docs: DataFrame, pieces: list[tuple[str, float]], byte_fallback: bool = True) -> DataFrame:
    """``doc_id, n_tokens``: how many pieces the best segmentation of every whole text has.

    ``pieces`` is a vocabulary of bounded size (see :func:`load_pieces`), sent to each executor once.
    A null or empty text counts 0; rows that repeat or lack an id stay; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(pieces)
    return docs.select("doc_id", "text").mapInArrow(
        functools.partial(_count, pieces=sent, byte_fallback=byte_fallback), "doc_id long, n_tokens long"
    )

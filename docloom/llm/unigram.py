"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists the vocabulary pieces that end at each
character; the dynamic programme keeps the best score and the number of pieces,
never the pieces. Of equal scores the piece that begins first stays, as the
tokenizer does it, since later begins must be strictly better. A character that
no piece of its own covers costs the least score less 10 and counts as many
tokens as it has UTF-8 bytes (byte fallback).

No piece of the vocabulary has a word mark after another character, so the best
path of a text is the sum of the best paths of its words, and each distinct word
is worked out once per task; scores are whole numbers, so the sums are exact.

Defined cases: a null or empty text has 0 tokens and score 0; texts of any
length are counted whole, and words of more than CACHE_LENGTH characters are not
remembered; rows with null ids and repeated rows are counted like any other; an
empty table gives an empty result; only the id and the text are read, whatever
other columns are called.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.llm.common import map_arrow
from docloom.llm.arrowtext import column

MARK = "▁"
CACHE_WORDS, CACHE_LENGTH = 150_000, 64  # words that are remembered, of how many characters at most
_WORD = re.compile(f"{MARK}+[^{MARK}]*")


class Unigram:
    """pieces: (piece, score) without control, unknown and byte pieces."""

    def __init__(self, pieces: list[tuple[str, float]], penalty: float = 10.0):
        self.scores = dict(pieces)
        self.unknown = min(self.scores.values()) - penalty
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.scores):
            raise ValueError("a piece with a word mark inside: texts can't be cut at words")
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self._young: dict[str, tuple[float, int]] = {}
        self._old: dict[str, tuple[float, int]] = {}

    def _matches(self, word: str) -> Iterable[list[tuple[int, float]]]:
        """For each place the pieces that end there; those of long words are not held together."""
        found = self.automaton.iter(word)
        if len(word) <= CACHE_LENGTH:
            ends: list[list[tuple[int, float]]] = [[] for _ in word]
            for end, match in found:
                ends[end].append(match)
            return ends
        return self._one_by_one(found, len(word))

    @staticmethod
    def _one_by_one(found, n: int) -> Iterator[list[tuple[int, float]]]:
        end, match = next(found, (n, None))
        for at in range(n):
            here = []
            while end == at:
                here.append(match)
                end, match = next(found, (n, None))
            yield here

    def word(self, word: str) -> tuple[float, int]:
        """Best score and number of tokens of a text, without looking anything up."""
        n = len(word)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        for end, here in enumerate(self._matches(word)):
            top, pieces, single = None, 0, False
            for size, score in sorted(here, reverse=True):
                single = single or size == 1
                value = best[end + 1 - size] + score
                if top is None or value > top:
                    top, pieces = value, count[end + 1 - size] + 1
            if not single:
                value = best[end] + self.unknown
                if top is None or value > top:
                    top, pieces = value, count[end] + len(word[end].encode("utf-8", "surrogatepass"))
            best[end + 1], count[end + 1] = top, pieces
        return best[n], count[n]

    def cached(self, word: str) -> tuple[float, int]:
        if len(word) > CACHE_LENGTH:
            return self.word(word)
        found = self._young.get(word)
        if found is None:
            found = self._old.get(word) or self.word(word)
            if len(self._young) >= CACHE_WORDS:
                self._old, self._young = self._young, {}
            self._young[word] = found
        return found

    def count(self, text: str | None) -> tuple[int, float]:
        """(tokens, score) of a whole text."""
        if not text:
            return 0, 0.0
        young, total, tokens = self._young, 0.0, 0
        for word in _WORD.findall(MARK + text.replace(" ", MARK)):
            found = young.get(word)
            if found is None:
                found = self.cached(word)
                young = self._young
            total += found[0]
            tokens += found[1]
        return tokens, total


@lru_cache(maxsize=4)
def load(path: str) -> Unigram:
    """The pieces and scores of a SentencePiece file; its byte pieces serve the fallback."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return Unigram([(model.id_to_piece(i), float(model.get_score(i))) for i in ids])


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, score. path: the vocabulary file on each executor."""

    def run(batches):
        model = load(path)
        for batch in batches:
            found = [model.count(x) for x in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "n_tokens", "score"],
            )

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, score double")

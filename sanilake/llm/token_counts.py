"""Token counts of a unigram vocabulary by a count-only Viterbi search.

An Aho-Corasick automaton names every vocabulary piece that ends at each
character.  Along the characters, dynamic programming carries the best score of
a split up to there and how many pieces it has; the split itself isn't kept.

Ties and unknown characters go as in the tokenizers library's Unigram model:
of splits with equal scores the one whose last piece begins first wins, a
character without a piece of its own costs the lowest score less 10, and a run
of unknown characters is one piece.  Words (runs without white space) are
split on their own, each with U+2581 before it, and remembered up to CACHED.
"""

from __future__ import annotations

import functools
from math import inf

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sanilake.llm import textvec
from sanilake.llm.texts import add_columns

CACHED = 400_000
MARK = "▁"
UNKNOWN_PENALTY = 10.0


class CountViterbi:
    """Best score and number of pieces of words, from (piece, score) pairs."""

    def __init__(self, vocabulary: list[tuple[str, float]]) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), float(score)))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.unknown = min([s for _, s in vocabulary], default=0.0) - UNKNOWN_PENALTY
        self.place: dict[bytes, int] = {}
        self.scores: list[float] = []
        self.counts: list[int] = []

    def split(self, word: str) -> tuple[float, int]:
        n, at = len(word), 0
        best, count, open_unknown = [0.0], [0], [False]
        top, pieces, lone, unknown = -inf, 0, False, self.unknown
        matches = self.automaton.iter(word) if len(self.automaton) else ()
        for last, (size, score) in [*matches, (n, (0, 0.0))]:
            while at < last:  # all matches that end before this character are in
                if not lone and best[at] + unknown > top:
                    top, pieces = best[at] + unknown, count[at] + (not open_unknown[at])
                    open_unknown.append(True)
                else:
                    open_unknown.append(False)
                best.append(top)
                count.append(pieces)
                at, top, pieces, lone = at + 1, -inf, 0, False
            if size == 1:
                lone = True
            if size and best[last + 1 - size] + score > top:  # those that begin first come first
                top, pieces = best[last + 1 - size] + score, count[last + 1 - size] + 1
        return best[n], count[n]

    def of(self, word: bytes) -> int:
        """Where the results of a word stand."""
        at = self.place.get(word)
        if at is None:
            at = self.place[word] = len(self.scores)
            score, count = self.split(MARK + word.decode(errors="replace"))
            self.scores.append(score)
            self.counts.append(count)
        return at

    def text(self, raw: bytes) -> tuple[int, float]:
        if len(self.place) > CACHED:
            self.place, self.scores, self.counts = {}, [], []
        get = self.place.get
        at = [k if (k := get(w)) is not None else self.of(w) for w in raw.split()]
        counts, scores = self.counts, self.scores
        return sum([counts[k] for k in at]), sum([scores[k] for k in at])


def piece_scores(path: str) -> list[tuple[str, float]]:
    """Pieces of a sentencepiece model with their scores; control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    keep = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return [(model.id_to_piece(i), model.get_score(i)) for i in keep]


@functools.lru_cache(maxsize=2)
def load(path: str) -> CountViterbi:
    return CountViterbi(piece_scores(path))


def token_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds n_tokens and best_score.  Null and empty texts: 0 and 0.0.  Repeated rows count alike."""

    def compute(s: textvec.Slice) -> list:
        model, raw = load(path), s.data.tobytes()
        found = [model.text(raw[a:b]) for a, b in zip(s.offsets[:-1].tolist(), s.offsets[1:].tolist(), strict=True)]
        return [np.array([x[0] for x in found], np.int64), np.array([x[1] for x in found], float)]

    return add_columns(docs, text, T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("best_score", T.DoubleType())]), compute)

"""Token counts by a count-only Viterbi search.

For a unigram vocabulary (pieces with scores) the best segmentation is the one
of greatest total score.  Only its number of pieces is wanted, so each node of
the search holds a score, a count and whether an unknown piece ends there, and
no path is kept.  An Aho-Corasick automaton enumerates the vocabulary matches.

Tie rules are those of the tokenizers library's unigram model: nodes are
reached in order of the matches' starts and a later match replaces an earlier
one only with a greater score; a character without a match of its own is an
unknown piece of the least score minus 10; neighbouring unknown pieces are one.

A space becomes U+2581 and one more is put in front.  When no piece has that
sign after another character, the best segmentation of a text is that of its
words one after the other, so words are counted once and remembered.

Cases: a null or empty text has no tokens; rows are independent of each other.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .shared import batch, documents, lean, memory

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED, LONGEST_REMEMBERED = 600_000, 64


def pieces(path: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a sentencepiece file with their scores."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]


class Counter:
    def __init__(self, vocabulary: list[tuple[str, float]]):
        self._automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self._automaton.add_word(piece, (len(piece), score))
        self._automaton.make_automaton()
        self._unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self._words = all(SPACE not in p.lstrip(SPACE) for p, _ in vocabulary) and any(p == SPACE for p, _ in vocabulary)
        self._segments = regex.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self._known: dict[str, tuple[int, int]] = {}

    def viterbi(self, text: str) -> tuple[int, int]:
        """Pieces and unknown pieces of the best segmentation of ``text`` as it is."""
        n = len(text)
        starts: list[list] = [[] for _ in range(n)]
        for end, (size, score) in self._automaton.iter(text):
            starts[end - size + 1].append((end + 1, score))
        best: list = [None] * (n + 1)  # score, pieces, unknown pieces, whether the last is unknown
        best[0] = (0.0, 0, 0, False)
        for at in range(n):
            here, count, unknown, last = best[at]
            best[at] = None
            single = False
            for end, score in starts[at]:
                node = best[end]
                if node is None or here + score > node[0]:
                    best[end] = (here + score, count + 1, unknown, False)
                single = single or end == at + 1
            starts[at] = ()
            if not single:
                node = best[at + 1]
                if node is None or here + self._unknown > node[0]:
                    best[at + 1] = (here + self._unknown, count + (not last), unknown + (not last), True)
        return best[n][1], best[n][2]

    def count(self, text: str | None) -> tuple[int, int]:
        if not text:
            return 0, 0
        if not self._words:
            return self.viterbi(SPACE + text.replace(" ", SPACE))
        words = text.split(" ")
        if "" in words or SPACE in text:
            words = [w[1:] if w[0] == SPACE else w for w in self._segments(SPACE + text.replace(" ", SPACE))]
        known = self._known
        if len(known) > REMEMBERED:
            known.clear()
        total = unknown = 0
        for w in words:
            found = known.get(w)
            if found is None:
                found = self.viterbi(SPACE + w)
                if len(w) <= LONGEST_REMEMBERED:
                    known[w] = found
            total += found[0]
            unknown += found[1]
        return total, unknown


_COUNTERS = memory("counts")
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_unknown", pa.int64())])


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, n_unknown of each whole text."""

    def run(batches):
        if path not in _COUNTERS:
            _COUNTERS[path] = Counter(pieces(path))
        count = _COUNTERS[path].count
        for b in batches:
            found = [count(t.as_py()) for t in b.column(1)]
            yield batch(_RESULT, b.column(0), [x for x, _ in found], [x for _, x in found])

    return documents(docs).selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(lean(run, "counts"), "doc_id long, n_tokens long, n_unknown long")

"""Token counts by a unigram vocabulary: best segmentation, pieces only counted."""

from __future__ import annotations

from functools import cache

import ahocorasick
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame

from .shared import hold, map_slices

#: Fixed values of the tokenizers library's unigram model: the penalty of an
#: unknown character below the lowest score, and the mark of a word start.
UNKNOWN_PENALTY = 10.0
MARK = "▁"
#: Counts of words kept by a worker, and the length up to which it does; it starts anew when
#: they are so many, so it keeps some 120 MB at most.
MEMORY, KEPT_LENGTH = 500_000, 100


def unigram_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a piece file; an unknown piece is number 0."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class PieceCounter:
    """Counts the pieces of the best segmentation of a word.

    The automaton gives every piece that ends at a position; the position keeps
    its best score, the longest piece winning a tie, because a later start must
    beat an earlier one. A character that no piece of one character covers is
    unknown. Runs of unknown characters count their bytes if the vocabulary has
    a piece for every byte, else one.
    """

    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        self.single = set()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
                if len(piece) == 1:
                    self.single.add(piece)
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        pieces = {piece for piece, _ in vocabulary}
        self.has_bytes = all(f"<0x{byte:02X}>" in pieces for byte in range(256))

    def count(self, word: str) -> int:
        n = len(word)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, match in self.automaton.iter(word):
            ending[last + 1].append(match)
        best, start_of, unknown_at = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        pieces = [0] * (n + 1)
        for end in range(1, n + 1):
            score = None
            matches = sorted(ending[end], reverse=True)
            if word[end - 1] not in self.single:
                matches.append((1, None))
            for length, value in matches:
                total = best[end - length] + (self.unknown if value is None else value)
                if score is None or total > score:
                    score, start_of[end], unknown_at[end] = total, end - length, value is None
            best[end] = score
            before = start_of[end]
            if not unknown_at[end]:
                pieces[end] = pieces[before] + 1
            elif self.has_bytes:
                pieces[end] = pieces[before] + len(word[end - 1].encode("utf-8", "surrogatepass"))
            else:
                pieces[end] = pieces[before] + (not (before and unknown_at[before]))
        return pieces[n]


@cache
def _counter(path: str) -> tuple[PieceCounter, dict[str, int]]:
    return PieceCounter(unigram_vocabulary(path)), {}


def count_tokens(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and n_tokens of every whole text, by the unigram vocabulary at `path`.

    A text is cut before every space and begins with one, as the tokenizer's
    word splitter does (`Metaspace`); each word is segmented on its own, so a
    worker counts a word once. Null and empty texts have no tokens. One result
    row per input row, repeated rows and null ids included; other columns are
    not read. The file must be at the same path on every machine.
    """
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def work(columns: dict[str, list]) -> dict[str, list]:
        hold(_counter.cache_clear)
        counter, known = _counter(path)
        counts = []
        for text in columns["text"]:
            text = text or ""
            pieces = text.replace(" ", MARK).split(MARK)
            if text and text[0] in (" ", MARK):
                pieces = pieces[1:]
            total = 0
            for piece in pieces if text else ():
                n = known.get(piece)
                if n is None:
                    n = counter.count(MARK + piece)
                    if len(piece) <= KEPT_LENGTH:
                        if len(known) >= MEMORY:
                            known.clear()
                        known[piece] = n
                total += n
            counts.append(total)
        return {"doc_id": columns["doc_id"], "n_tokens": counts}

    return map_slices(documents.select("doc_id", "text"), work, "doc_id long, n_tokens long")

"""Token counts: count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates all pieces that end at each character of a
word; dynamic programming carries the best score and the number of pieces on its
path.  Words are the runs that the word mark begins: no path crosses one, so a
word is solved once per task and its count is looked up afterwards.

Rules of the tokenizer that counts are exact for: a blank becomes the word mark,
one more stands before the text unless it begins with one; a later piece
replaces the path to a position only with a strictly larger score, pieces being
tried by where they start; a character without a piece of its own may be
unknown, for the least score minus ``PENALTY``; unknown characters become their
bytes, where the vocabulary has all of them, else a run of them is one piece.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import register, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
PENALTY = 10.0
CACHED = 1 << 19  # words whose counts a task remembers


@dataclass
class Vocabulary:
    """Pieces with their scores; ``bytes_known``: unknown characters become bytes."""

    pieces: Sequence[str]
    scores: Sequence[float]
    bytes_known: bool = True


def read_model(path: str = MODEL) -> Vocabulary:
    """The pieces and scores of a SentencePiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return Vocabulary([model.id_to_piece(i) for i in ids], [float(np.float32(model.get_score(i))) for i in ids])


class Counter(dict):
    """Counts by word without its mark; unknown words are solved when they are first met."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, score in zip(vocabulary.pieces, vocabulary.scores, strict=True):
            if piece:
                self.automaton.add_word(piece, (len(piece), float(score)))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.unknown = min(vocabulary.scores, default=0.0) - PENALTY
        known = set(vocabulary.pieces)
        self.byte = [vocabulary.bytes_known and f"<0x{b:02X}>" in known for b in range(256)]

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED:
            self.clear()
        count = self[word] = self.solve(MARK + word)
        return count

    def count(self, text: str) -> int:
        if not text:
            return 0
        marked = text.replace(" ", MARK)
        return sum(map(self.__getitem__, (marked[1:] if marked[0] == MARK else marked).split(MARK)))

    def solve(self, word: str) -> int:
        n = len(word)
        best: list[float | None] = [None] * (n + 1)
        best[0] = 0.0
        pieces = [0] * (n + 1)  # before the run of unknown characters that may end here
        open_run = [0] * (n + 1)  # where that run starts, plus one
        at = 0
        unknown = self.unknown

        def guess(end: int) -> None:
            score = best[end - 1] + unknown
            if best[end] is None or score > best[end]:
                best[end] = score
                pieces[end] = pieces[end - 1]
                open_run[end] = open_run[end - 1] or end

        single = False  # whether a piece of one character ends at ``at``
        for last, (size, score) in self.automaton.iter(word) if len(self.automaton) else ():
            end = last + 1
            while at < end:  # done with ``at``: pieces come by their end
                if at and not single:
                    guess(at)
                at, single = at + 1, False
            start = end - size
            total = best[start] + score
            if best[end] is None or total > best[end]:
                best[end] = total
                pieces[end] = pieces[start] + 1 + (self.spelled(word[open_run[start] - 1 : start]) if open_run[start] else 0)
                open_run[end] = 0
            single = single or size == 1
        while at <= n:
            if at and not single:
                guess(at)
            at, single = at + 1, False
        return pieces[n] + (self.spelled(word[open_run[n] - 1 :]) if open_run[n] else 0)

    def spelled(self, run: str) -> int:
        """Pieces of a run of unknown characters."""
        raw = run.encode()
        return len(raw) if all(self.byte[b] for b in raw) else 1


def token_counts(docs: DataFrame, doc_id: str, text: str, vocabulary: Vocabulary) -> DataFrame:
    """``(doc_id, n_tokens)``, one row per row of ``docs``.

    A null or empty text has 0 tokens; equal texts have equal counts; other
    columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        counter = Counter(shared.value)
        for batch in batches:
            counts = [counter.count(t.as_py()) if t.is_valid else 0 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    read = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return read.mapInArrow(count, "doc_id long, n_tokens long")


@register("op6_token_counts")
def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", read_model())

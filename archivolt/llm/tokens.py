"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the pieces that end at each character; the best path carries its score and its
number of pieces only. The tie rules are those of the usual unigram tokenizers: a path replaces another only if its score
is strictly larger, starts are tried from the left (so of equal paths the one with the longest last piece stays), a
character that is no piece by itself may be unknown at the least score minus 10, and unknown characters fall back to
their bytes. Where no piece crosses from a word into a blank, words are counted one by one and remembered.

Edge cases: null and empty texts have 0 tokens; repeated rows are answered alike; long texts are read whole, and the
memory of words is emptied when it is full, which changes no result; an empty table gives an empty result; further columns,
whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import portions

BLANK = "▁"
UNKNOWN_PENALTY = 10.0
MEMORY = 400_000


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, in order of their ids. Control pieces get no text."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [("" if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) else sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


class Counts:
    """Counts pieces of texts; pickles as its vocabulary and builds the automaton where it is used."""

    def __init__(self, vocabulary: list[tuple[str, float]]) -> None:
        self.vocabulary = [(p, s) for p, s in vocabulary if p]
        self.least = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.crosses = any(re.search(f"[^{BLANK}]{BLANK}", p) for p, _ in self.vocabulary)
        self._ready = False

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("auto", "memory")} | {"_ready": False}

    def _build(self) -> None:
        self.auto, self.memory = ahocorasick.Automaton(), {}
        for piece, score in self.vocabulary:
            if piece not in self.auto:  # of repeated pieces the first counts
                self.auto.add_word(piece, (len(piece), score))
        self.auto.make_automaton()
        self._ready = True

    def segment(self, text: str) -> int:
        """Number of tokens on the best path through a string."""
        if not self._ready:
            self._build()
        n = len(text)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, match in self.auto.iter(text):
            ends[last + 1].append(match)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        for e in range(1, n + 1):
            top, of, single = None, 0, False
            for size, score in ends[e]:
                s = best[e - size] + score
                if top is None or s > top or (s == top and size > of):
                    top, of = s, size
                single |= size == 1
            unknown = best[e - 1] + self.least
            if not single and (top is None or unknown > top):
                best[e], count[e] = unknown, count[e - 1] + len(text[e - 1].encode("utf-8", "surrogatepass"))
            else:
                best[e], count[e] = top, count[e - of] + 1
        return count[n]

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        if not self._ready:
            self._build()
        marked = BLANK + text.replace(" ", BLANK)
        if self.crosses:
            return self.segment(marked)
        total = 0
        for word, k in Counter(re.findall(f"{BLANK}*[^{BLANK}]+|{BLANK}+", marked)).items():
            n = self.memory.get(word)
            if n is None:
                n = self.segment(word)
                if len(self.memory) >= MEMORY:
                    self.memory.clear()
                if len(word) < 64:
                    self.memory[word] = n
            total += k * n
        return total


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens for every row. Map only; the vocabulary's size is fixed by its file."""
    shared = docs.sparkSession.sparkContext.broadcast(Counts(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, "text"):
            yield pa.record_batch([b["doc_id"], pa.array([shared.value.text(t) for t in b["text"].to_pylist()], pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long")

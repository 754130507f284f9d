"""Which of many phrases stand in a text: one pass over each text, with an automaton of all phrases at once."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.sources.shared import spread

# Characters of different phrases in one automaton: about a hundred bytes each in every Python worker.
BUDGET = 1_000_000
# Rows (eid, part) of phrases that a join may broadcast.
SMALL = 100_000


class Phrases:
    """Phrases and their automaton, which each worker builds once, for as long as the broadcast lives."""

    def __init__(self, parts: pa.Array) -> None:
        self.parts, self.built = parts, None

    def __getstate__(self) -> dict:
        return {"parts": self.parts, "built": None}

    def found(self, text: str) -> set[int]:
        """Numbers of the phrases in the text; the empty phrase stands in every text."""
        if self.built is None:
            auto = ahocorasick.Automaton()
            self.always = set()
            for i, p in enumerate(self.parts.to_pylist()):
                if p:
                    auto.add_word(p, i)
                else:
                    self.always.add(i)
            auto.make_automaton()
            self.built = auto
        if not len(self.built):
            return set(self.always)
        return {i for _, i in self.built.iter(text)} | self.always


def found_phrases(docs: DataFrame, phrases: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(doc_id, eid), once each, of the phrases (eid, part) that stand anywhere in a text (doc_id, text).

    Each text is read once for every `budget` characters of different phrases and goes nowhere: what leaves a row is its
    id and the phrases found. The phrases of a pass are broadcast; longer lists are dealt into passes by hash. Null texts
    and phrases match nothing.
    """
    spark = docs.sparkSession
    p = phrases.select("eid", "part").where("part IS NOT NULL")
    one = p.select("part").distinct()
    of = p.groupBy("part").agg(F.count("*").alias("n")).agg(F.sum(F.length("part") + 1), F.sum("n")).first()
    size, n = of[0] or 0, of[1] or 0
    passes = max(1, -(-size // budget))
    p = F.broadcast(p) if n <= SMALL else p
    texts = spread(docs.select("doc_id", "text")).where("text IS NOT NULL")
    out = None
    for i in range(passes):
        own = one.where(F.pmod(F.xxhash64("part"), F.lit(passes)) == i).toArrow()["part"].combine_chunks()  # about `budget` characters
        held = spark.sparkContext.broadcast(Phrases(own))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            known = held.value
            for b in batches:
                rows, parts = [], []
                for row, text in enumerate(b["text"]):
                    hit = known.found(text.as_py())
                    rows += [row] * len(hit)
                    parts += hit
                yield pa.record_batch([b["doc_id"].take(pa.array(rows, pa.int64())), known.parts.take(pa.array(parts, pa.int64()))], names=["doc_id", "part"])

        hits = texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, part string")
        out = hits if out is None else out.unionByName(hits)
    return out.join(p, "part").select("doc_id", "eid").distinct()

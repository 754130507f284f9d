"""Phrase collocations by a multikey three-way quicksort of suffix pointers.

Every word begins a suffix of at most LONGEST words of its piece, led by its language. Suffixes are routed by their leading
words into buckets, equal ones of a portion of text as one with a count. In a bucket the pointers are sorted word by word: a
range is parted at a pivot into less, equal and greater; the size of an equal part is the count of a phrase, the equal part
goes on with the next word, and parts with less than `least` suffixes are abandoned.

A bucket holds about BUCKET suffixes. Leaders that alone have more than HOT route by one word more, and so on to all words and
then by portion, so no leader fills a task. Which they are is read from a sketch: counters of all leaders of all texts by hash,
so a wrong guess costs balance and never a count. Counts of such leaders come in parts from many
buckets and are added up at the end. The sketch has 2^22 counters at most and travels as that many bits.

Edge cases: a null text is empty, an empty text has no words; a null language is `und`; texts of any length are cut between
words, with LONGEST - 1 words of what follows in sight, so nothing is lost; repeated rows and ids count as often as they stand
there; a language without candidates has no rows; an empty table gives an empty result; equal scores go by count, then by the
bytes of the phrase; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import input_columns, portions, saved
from .words import mix

LONGEST = 5
PORTION = 2_000_000
BUCKET = 500_000
HOT = 125_000
COUNTERS = 1 << 22

# What parts words, and what parts pieces.
_BLANK, _BREAK = b" \t", b".,;:!?\n\x0b\x0c\r"
_WORD = re.compile(rb"[^ \t.,;:!?\n\x0b\x0c\r]+")
_KIND = np.zeros(256, np.uint8)
_KIND[list(_BLANK)] = 1
_KIND[list(_BREAK)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_END = np.uint64(0x5851F42D4C957F2D)


class Suffixes:
    """Suffixes of some text as rows of codes: the language, then up to LONGEST words; -1 beyond the end of the piece."""

    def __init__(self, raw: np.ndarray, edges: np.ndarray, langs: pa.Array, own: int) -> None:
        kind = _KIND[raw]
        word = kind == 0
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        ends[:-1] &= ~word[1:]
        inner = edges[1:-1]
        inner = inner[(inner > 0) & (inner < len(raw))]
        begins[inner] = word[inner]
        ends[inner - 1] = word[inner - 1]
        begin, end = np.flatnonzero(begins), np.flatnonzero(ends)
        row = np.searchsorted(edges, begin, side="right") - 1
        piece = np.cumsum(kind == 2, dtype=np.int32)[begin]
        lengths = end - begin + 1
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        text = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(_LOWER[raw[word]]))
        coded = text.dictionary_encode()
        code = coded.indices.to_numpy()
        n = int(np.searchsorted(begin, own, side="left"))
        named = langs.cast(pa.large_string()).dictionary_encode()
        self.words = pa.concat_arrays([coded.dictionary, named.dictionary])
        self.codes = np.full((n, 1 + LONGEST), -1, np.int32)
        self.codes[:, 0] = named.indices.to_numpy()[row[:n]] + len(coded.dictionary)
        inside = np.ones(n, bool)
        for j in range(LONGEST):
            if j:
                m = max(0, min(n, len(code) - j))
                inside[m:] = False
                inside[:m] &= (row[j : m + j] == row[:m]) & (piece[j : m + j] == piece[:m])
            at = np.flatnonzero(inside)
            self.codes[at, 1 + j] = code[at + j]

    def leaders(self) -> np.ndarray:
        """Hash of the first m words and the language, by column m - 1; equal words have equal hashes in all tasks."""
        of = np.append(pd.util.hash_array(self.words.to_numpy(zero_copy_only=False)), _END)  # -1 is the last one
        h, out = mix(of[self.codes[:, 0]]), np.zeros((len(self.codes), LONGEST), np.uint64)
        for j in range(LONGEST):
            h = mix(h ^ of[self.codes[:, 1 + j]], j + 1)
            out[:, j] = h
        return out


def _cut(raw: bytes) -> Iterator[tuple[int, int, int]]:
    """(begin, own, sight) of the parts of a long text: suffixes begin before `own` and end before `sight`."""
    begin = 0
    while begin < len(raw):
        own = len(raw)
        if len(raw) - begin > PORTION:
            inside = _WORD.match(raw, begin + PORTION)
            own = inside.end() if inside else begin + PORTION
        sight = own
        for _, next_word in zip(range(LONGEST - 1), _WORD.finditer(raw, own), strict=False):
            sight = next_word.end()
        yield begin, own, sight
        begin = own


def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[Suffixes]:
    """The suffixes of (text, lang), a portion of text at a time."""
    for batch in batches:
        for b in portions([batch], "text", PORTION):
            texts = pc.fill_null(b["text"], "").cast(pa.large_string())
            langs = pc.fill_null(b["lang"].cast(pa.string()), "und")
            edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            if not len(texts) or edges[-1] == edges[0]:
                continue
            raw = np.frombuffer(texts.buffers()[2], np.uint8)[edges[0] : edges[-1]]
            if len(raw) <= PORTION or len(texts) > 1:
                yield Suffixes(raw, edges - edges[0], langs, len(raw))
                continue
            for begin, own, sight in _cut(raw.tobytes()):
                yield Suffixes(raw[begin:sight], np.array([0, sight - begin]), langs, own - begin)


def _sketched(counters: int, share: float):
    """(slot, n): a task's counters that hold the given share of its words or more, and its words at the slot behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(counters + 1, np.int64)
        for s in suffixes(batches):
            h = s.leaders()
            for j in range(LONGEST):
                some = h[:, j][s.codes[:, 1 + j] >= 0]
                held[:counters] += np.bincount((some & np.uint64(counters - 1)).astype(np.int64), minlength=counters)
            held[counters] += len(h)
        at = np.flatnonzero(held > share * held[counters])
        yield pa.record_batch([at, held[at]], names=["slot", "n"])

    return run


def _routed(hot: np.ndarray, buckets: int):
    """Rows (bucket, words, codes, counts): a row for each bucket and portion; codes hold the route in the last column."""
    counters = len(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for portion, s in enumerate(suffixes(batches)):
            n, h = len(s.codes), s.leaders()
            if not n:
                continue
            route = np.ones(n, np.int64)
            more = np.ones(n, bool)
            for j in range(LONGEST):
                more &= (s.codes[:, 1 + j] >= 0) & hot[(h[:, j] & np.uint64(counters - 1)).astype(np.int64)]
                route += more
            lead = h[np.arange(n), np.minimum(route, LONGEST) - 1]
            lead = np.where(route > LONGEST, mix(lead, portion % 97 + LONGEST + 1), lead)
            bucket = ((lead >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort((bucket.astype(np.uint64) << np.uint64(40)) | (h[:, -1] >> np.uint64(24)))
            codes, bucket, route = s.codes[order], bucket[order], route[order]
            new = np.ones(n, bool)
            new[1:] = (codes[1:] != codes[:-1]).any(axis=1) | (bucket[1:] != bucket[:-1])
            first = np.flatnonzero(new)
            counts = np.diff(np.append(first, n)).astype(np.uint32)
            codes, bucket, route = codes[first], bucket[first], route[first]
            size = len(s.words)
            keys = np.where(codes >= 0, bucket[:, None] * size + codes, -1).ravel()
            local, found = pd.factorize(keys)  # in order of appearance, so bucket by bucket
            real = found >= 0
            number = np.cumsum(real)  # 1 for the first word; the missing one is not counted
            found_bucket = np.where(real, found // size, -1)[real]
            starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            names = bucket[starts]
            words_at = np.append(np.searchsorted(found_bucket, names, side="left"), len(found_bucket))
            local = np.where(real[local], number[local], 0).reshape(codes.shape)
            base = np.repeat(words_at[:-1], np.diff(np.append(starts, len(bucket))))
            local = np.where(local > 0, local - base[:, None], 0)
            kind = np.uint16 if np.diff(words_at).max() < 65_535 else np.uint32
            packed = np.column_stack([local, route]).astype(kind)
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array(words_at, pa.int32()), s.words.take(pa.array(found[real] % size)).cast(pa.string())), "\n")
            cut = lambda a, each: pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(bucket)).astype(np.int64) * each), pa.py_buffer(np.ascontiguousarray(a))]).cast(pa.binary())
            yield pa.record_batch([pa.array(names), text, cut(packed, packed.itemsize * packed.shape[1]), cut(counts, 4), pa.array(np.full(len(names), packed.itemsize, np.int32))], names=["bucket", "words", "codes", "counts", "width"])

    return run


def sorted_counts(codes: np.ndarray, counts: np.ndarray, route: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, words, count): a suffix that begins with the phrase, its number of words, its count.

    The quicksort parts all its ranges at once. Phrases shorter than the route of their suffixes are counts in part, and
    neither they nor the ranges that lead to them are abandoned.
    """
    order = np.argsort(route, kind="stable")
    routes, sizes = np.unique(route[order], return_counts=True)
    p, depth, of = order, np.zeros(len(routes), np.int64), routes
    rows, long, many = [], [], []
    while len(sizes):
        starts = np.cumsum(sizes) - sizes
        at = np.repeat(np.arange(len(sizes)), sizes)
        key = codes[p, depth[at]]
        middle = starts + sizes // 2
        pivot = key[middle]
        against = pivot[at]
        side = (key >= against).astype(np.int8) + (key > against)
        held, weight = [], counts[p]
        partial = depth < of
        for c in (0, 1, 2):
            here = side == c
            whose = at[here]
            n = np.bincount(whose, minlength=len(sizes))
            w = np.bincount(whose, weights=weight[here], minlength=len(sizes)).astype(np.int64)
            go_on = (n > 0) & (partial | (w >= least))
            if c == 1:
                go_on &= pivot >= 0
                rows.append(p[middle[go_on]])
                long.append(depth[go_on])
                many.append(w[go_on])
                go_on &= depth < LONGEST
            held.append((p[here][go_on[whose]], n[go_on], depth[go_on] + (c == 1), of[go_on]))
        p, sizes, depth, of = (np.concatenate(x) for x in zip(*held, strict=True))
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return cat(rows), cat(long), cat(many)


def _counted(least: int):
    def run(group: pa.Table) -> pa.Table:
        lists = pc.split_pattern(group["words"].combine_chunks().cast(pa.large_string()), "\n")
        words = lists.flatten().dictionary_encode()
        base = lists.offsets.to_numpy()
        to = np.append(-1, words.indices.to_numpy())
        codes, counts, route = [], [], []
        for i, (blob, n, width) in enumerate(zip(group["codes"], group["counts"], group["width"].to_pylist(), strict=True)):
            x = np.frombuffer(blob.as_buffer(), np.uint16 if width == 2 else np.uint32).reshape(-1, 2 + LONGEST).astype(np.int64)
            codes.append(to[np.where(x[:, :-1] > 0, x[:, :-1] + base[i], 0)].astype(np.int32))
            route.append(x[:, -1].astype(np.int8))
            counts.append(np.frombuffer(n.as_buffer(), np.uint32))
        codes = np.concatenate(codes)
        rows, long, many = sorted_counts(codes, np.concatenate(counts).astype(np.int64), np.concatenate(route), least)
        out = []
        for m in range(LONGEST + 1):
            some = codes[rows[long == m]]
            part = [words.dictionary.take(pa.array(some[:, j])) for j in range(m + 1)]
            phrase = pc.binary_join_element_wise(*part[1:], pa.scalar(" ", pa.large_string())) if m else pa.array([""] * len(some), pa.large_string())
            out.append(pa.table({"lang": part[0].cast(pa.string()), "phrase": phrase.cast(pa.string()), "words": np.full(len(some), m, np.int32), "f": many[long == m]}))
        return pa.concat_tables(out).combine_chunks()

    return run


def counts(docs: DataFrame, *, least: int = 100, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, words, f): phrases of 1 to LONGEST words with f >= least; words = 0 has the number of all words."""
    spark = docs.sparkSession
    texts = input_columns(docs, text_col, lang_col).select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counters = 1 << int(np.clip(np.ceil(np.log2(64 * max(size, 1) / HOT)), 12, np.log2(COUNTERS)))  # a counter then overstates by HOT / 16 on average
    # There are at most size / 2 + 1 words: what the tasks leave out of a counter adds up to HOT / 2 at most.
    sketch = texts.mapInArrow(_sketched(counters, HOT / max(size + 2, HOT)), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    hot = np.zeros(counters, bool)
    large = sketch.where((F.col("n") > HOT // 2) | (F.col("slot") == counters)).toArrow()  # a row for each counter at most
    slots = large["slot"].to_numpy()
    n = int(large["n"].to_numpy()[slots == counters].sum())
    hot[slots[slots < counters]] = True
    buckets = max(1, -(-n // BUCKET))
    held = spark.sparkContext.broadcast(np.packbits(hot))  # at most 2^22 bits

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _routed(np.unpackbits(held.value)[:counters].astype(bool), buckets)(batches)

    routed = texts.mapInArrow(route, "bucket long, words string, codes binary, counts binary, width int")
    found = routed.groupBy("bucket").applyInArrow(_counted(least), "lang string, phrase string, words int, f long")
    return saved(found.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("words") == 0)), "phrases")


def collocations(docs: DataFrame, *, least: int = 100, first: int = 2000, covered: int = 100, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases.

    A phrase goes if a longer candidate holds it with `covered` per cent of its count or more.
    """
    f = counts(docs, least=least, text_col=text_col, lang_col=lang_col)
    of = f.where("words = 0").select("lang", F.col("f").alias("n"))
    of = F.broadcast(of) if of.limit(10_001).count() <= 10_000 else of
    found = f.where("words >= 2").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    inside = f.where("words >= 3").select("lang", F.col("f").alias("longer"), F.split("phrase", " ").alias("w"))
    lengths = F.explode(F.sequence(F.lit(2), F.size("w") - 1))
    inside = inside.select("lang", "longer", "w", lengths.alias("m")).select("lang", "longer", "w", "m", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1)).alias("i"))
    inside = inside.groupBy("lang", F.array_join(F.slice("w", F.col("i"), F.col("m")), " ").alias("phrase")).agg(F.max("longer").alias("longer"))
    kept = found.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(38,0)") < covered * F.col("a").cast("decimal(38,0)")))
    cuts = kept.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("tail"))
    side = lambda part, name: f.where("words >= 1").select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    scored = cuts.join(side("head", "l"), ["lang", "head"]).join(side("tail", "r"), ["lang", "tail"]).join(of, "lang")
    wide = lambda c: f"cast({c} as decimal(19,0))"
    scored = scored.withColumn("score", F.expr(f"(1000 * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    best = best.select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")
    order = (F.desc("score"), F.desc("a"), "phrase")
    some = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order))  # a language's rows are many: first in 64 parts
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return best.withColumn("some", some).where(F.col("some") <= first).withColumn("rank", rank).where(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

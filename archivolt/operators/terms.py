"""Terms of texts counted in their rows: vocabularies and weighted vectors without a shuffle of texts or of counts.

A batch of texts becomes codes of its different words; terms are made once for each different word, so their cost follows
the vocabulary of the batch, and counts are array operations over all its texts at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.functions import text as X
from archivolt.sources.shared import spread

# Words of one step, cells of one table of counts, and terms that a task gathers before it reports them.
WORDS, CELLS, GATHERED = 200_000, 8_000_000, 1_000_000


@dataclass
class Entries:
    """Occurrences of a batch: row, term and how often; a term may stand more than once in a row."""

    rows: int
    terms: pa.Array
    row: np.ndarray
    term: np.ndarray
    count: np.ndarray


def _word_pairs(words: pa.Array, code: np.ndarray, row: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(pairs of neighbouring words, pair and row of each place)."""
    inside = np.flatnonzero(row[1:] == row[:-1])
    pair, number = np.unique(code[inside].astype(np.int64) * len(words) + code[inside + 1], return_inverse=True)
    text = pc.binary_join_element_wise(words.take(pa.array(pair // len(words))), words.take(pa.array(pair % len(words))), pa.scalar(" ", pa.large_string()))
    return text, number, row[inside]


def _plain(words: pa.Array, code: np.ndarray, row: np.ndarray, rows: int, pairs: bool) -> Entries:
    if not pairs or not len(code):
        return Entries(rows, words, row, code, np.ones(len(code), np.int64))
    text, number, at = _word_pairs(words, code, row)
    return Entries(rows, pa.concat_arrays([words, text]), np.concatenate([row, at]), np.concatenate([code, number + len(words)]), np.ones(len(code) + len(at), np.int64))


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different numbers in order, and how often each stands there: by sorting, which is faster than hashing here."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each key, from 0 by value; a place of each number)."""
    top = int(keys.max(initial=-1)) + 1
    if top <= 1 << 24:
        seen = np.zeros(top, bool)
        seen[keys] = True
        to = np.cumsum(seen, dtype=np.int32) - 1
        number, many = to[keys], int(seen.sum())
    else:
        values = _distinct(keys)[0]
        number, many = np.searchsorted(values, keys), len(values)
    place = np.zeros(many, np.int64)
    place[number] = np.arange(len(keys))
    return number, place


def _grams(words: pa.Array, low: int, high: int) -> tuple[pa.Array, list[tuple[np.ndarray, np.ndarray]]]:
    """(n-grams, for each n the first place of each word and the end, and the n-grams at the places).

    A padded word has three characters at least, so it gives itself where n is its length, and nothing for longer n. An
    n-gram is the number of the one before and a letter, numbered anew for each n.
    """
    padded = "".join(f" {w} " for w in words.to_pylist())
    points = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), np.uint32)
    length = pc.utf8_length(words).to_numpy().astype(np.int64) + 2
    start = np.cumsum(length) - length
    whose = np.repeat(np.arange(len(words)), length)
    behind = (start + length)[whose] - np.arange(len(points))  # characters from here to the word's end
    letter, places = _numbered(points.astype(np.int64))
    letters = len(places)
    number, texts, out, base = letter.astype(np.int64), [], [], 0
    at = np.arange(len(points))
    for n in range(2, high + 1):
        held = behind[at] >= n
        at, number = at[held], number[held]
        number, place = _numbered(number * letters + letter[at + n - 1])
        number = number.astype(np.int64)
        if n >= low:
            texts += [padded[b : b + n] for b in at[place].tolist()]
            out.append((np.searchsorted(whose[at], np.arange(len(words) + 1)), number + base))
            base += len(place)
    return pa.array(texts, pa.large_string()), out


@dataclass(frozen=True)
class Terms:
    """How a text is cut: words by a column expression, then terms of words. high = 0: words and, with pairs, word pairs;
    else n-grams of `low` (2 or 3) to `high` characters within words padded by a blank."""

    words: Callable[[Column], Column]
    pairs: bool = False
    low: int = 0
    high: int = 0

    def entries(self, lists: pa.Array) -> Iterator[tuple[int, Entries]]:
        """(first row, occurrences) of portions of a column of word lists."""
        offsets = lists.offsets.to_numpy()
        begin = 0
        while begin < len(lists):
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + WORDS, side="right")) - 1)
            part = lists.values.slice(offsets[begin], offsets[end] - offsets[begin]).cast(pa.large_string()).dictionary_encode()
            words, code = part.dictionary, part.indices.to_numpy()
            row = np.repeat(np.arange(end - begin), np.diff(offsets[begin : end + 1]))
            yield begin, self._portion(words, code, row, end - begin)
            begin = end

    def _portion(self, words: pa.Array, code: np.ndarray, row: np.ndarray, rows: int) -> Entries:
        if not self.high or not len(code):
            return _plain(words, code, row, rows, self.pairs)
        key, count = _distinct(row * len(words) + code)
        row, code = key // len(words), key % len(words)
        texts, by_length = _grams(words, self.low, self.high)
        found = []
        for starts, gram in by_length:
            many = np.diff(starts)[code]
            at = np.repeat(starts[:-1][code] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            found.append((np.repeat(row, many), gram[at], np.repeat(count, many)))
        return Entries(rows, texts, *(np.concatenate(x) for x in zip(*found, strict=True)))


def split_words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), f"{X.SPACE}+"), lambda w: w != "")


# Words and pairs of neighbouring words; words alone; character n-grams of 2 to 4.
WORD = Terms(X.words, pairs=True)
CHAR = Terms(split_words, low=2, high=4)


def _cut(units: DataFrame, terms: Terms) -> DataFrame:
    return spread(units.select("unit", "text")).select("unit", F.coalesce(terms.words(F.col("text")), F.array().cast("array<string>")).alias("words"))


def _lists(column: pa.Array) -> pa.Array:
    return column.cast(pa.list_(pa.string())) if column.type != pa.list_(pa.string()) else column


def vocabulary(units: DataFrame, terms: Terms, features: int) -> DataFrame:
    """(term, df, idf) of the `features` most frequent terms; ties go to the smaller term. A unit is a row (unit, text).

    What is shuffled are the terms of a task with their counts, once each for about GATHERED terms.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for b in batches:
            for _, e in terms.entries(_lists(b["words"])):
                many = len(e.terms)
                if not many:
                    continue
                n = np.bincount(e.term, weights=e.count, minlength=many).astype(np.int64)
                df = np.bincount(_distinct(e.row * many + e.term)[0] % many, minlength=many)
                held.append(pa.table({"term": e.terms.cast(pa.string()), "n": n, "df": df}))
                size += many
                if size > GATHERED:
                    held = [_summed(held)]
                    if len(held[0]) > GATHERED // 2:
                        yield from held[0].to_batches()
                        held = []
                    size = sum(len(t) for t in held)
        if held:
            yield from _summed(held).to_batches()

    counts = _cut(units, terms).select("words").mapInArrow(run, "term string, n long, df long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    total = units.count()
    best = counts.orderBy(F.desc("n"), "term").limit(features)
    return best.select("term", "df", (F.log((1 + F.lit(total)) / (1 + F.col("df"))) + 1).alias("idf"))


def _summed(tables: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(tables).group_by("term").aggregate([("n", "sum"), ("df", "sum")])
    return out.rename_columns(["term", "n", "df"]) if out.column_names[0] == "term" else out.select(["term", "n_sum", "df_sum"]).rename_columns(["term", "n", "df"])


@dataclass
class Weighing:
    """A vocabulary in a worker: terms and idf, and how counts of a row become weights."""

    terms: pa.Array
    idf: np.ndarray
    sublinear: bool

    def rows(self, e: Entries) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, rows, row, term, weight) of blocks of rows; the weights of a row have a square sum of 1."""
        many = max(1, len(self.terms))
        number = pc.fill_null(pc.index_in(e.terms.cast(pa.string()), value_set=self.terms), -1).to_numpy() if len(self.terms) else np.full(len(e.terms), -1)
        number = number[e.term]
        real = number >= 0
        row, number, count = e.row[real], number[real], e.count[real]
        step = max(1, CELLS // many)
        if e.rows > step:
            order = np.argsort(row, kind="stable")
            row, number, count = row[order], number[order], count[order]
        for low in range(0, e.rows, step):
            here = slice(np.searchsorted(row, low), np.searchsorted(row, low + step)) if e.rows > step else slice(None)
            tf = np.bincount((row[here] - low) * many + number[here], weights=count[here])
            at = np.flatnonzero(tf)
            r, t = at // many, at % many
            x = (1 + np.log(tf[at]) if self.sublinear else tf[at]) * self.idf[t]
            yield low, min(step, e.rows - low), r, t, x / np.sqrt(np.bincount(r, weights=x * x, minlength=1))[r]


def _weighing(vocab: DataFrame, sublinear: bool) -> Weighing:
    known = vocab.select("term", "idf").toArrow()  # at most `features` rows
    return Weighing(known["term"].combine_chunks(), known["idf"].to_numpy(), sublinear)


def vectors(units: DataFrame, terms: Terms, vocab: DataFrame, sublinear: bool = False, only: DataFrame | None = None) -> DataFrame:
    """(unit, term, w): L2-normalised TF-IDF of each unit over the vocabulary, made in its row.

    The vocabulary has at most as many rows as features were asked for, and is broadcast. only: (term) of the terms that are
    given out; norms are over all.
    """
    known = _weighing(vocab, sublinear)
    wanted = np.ones(len(known.terms), bool)
    if only is not None:
        wanted = pc.is_in(known.terms, value_set=only.join(vocab, "term", "left_semi").select("term").distinct().toArrow()["term"].combine_chunks()).to_numpy(zero_copy_only=False)
    held = units.sparkSession.sparkContext.broadcast((known, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh, out = held.value
        for b in batches:
            for first, e in terms.entries(_lists(b["words"])):
                for low, _, r, t, w in weigh.rows(e):
                    keep = out[t]
                    r, t, w = r[keep], t[keep], w[keep]
                    yield pa.record_batch([b["unit"].take(pa.array(first + low + r)), weigh.terms.take(pa.array(t)), w], names=["unit", "term", "w"])

    cut = _cut(units, terms)
    return cut.mapInArrow(run, f"unit {cut.schema['unit'].dataType.simpleString()}, term string, w double")


# Queries that are scored in the rows of the units, and bytes of their weights in one pass.
QUERIES, WEIGHTS = 4096, 64_000_000


def best(units: DataFrame, terms: Terms, vocab: DataFrame, asked: DataFrame, k: int, sublinear: bool = False) -> DataFrame:
    """qid, unit, score: candidates for the k best units of each query, from the rows of the units.

    asked: (unit = qid, term, w) of at most QUERIES queries, broadcast in blocks of WEIGHTS bytes; a block is one pass over
    the units. A task keeps the k-th best score of each query so far. Before a block of units is scored, the largest weight
    of each term in it bounds what a query can find there, and queries that cannot beat their k-th best are left out; of the
    others the k best units go on. Nothing is lost: a unit that is left out is behind k others of its task.
    """
    known = _weighing(vocab, sublinear)
    table = asked.select("unit", "term", "w").toArrow()  # at most QUERIES vectors
    qids = table["unit"].combine_chunks().dictionary_encode()
    term = pc.index_in(table["term"].combine_chunks(), value_set=known.terms).to_numpy(zero_copy_only=False).astype(np.int64)
    number, w = qids.indices.to_numpy(), table["w"].to_numpy()
    used = np.unique(term)
    column = np.full(len(known.terms), -1)
    column[used] = np.arange(len(used))
    step = max(1, WEIGHTS // (8 * max(1, len(used))))
    cut = _cut(units, terms)
    kind = cut.schema["unit"].dataType.simpleString()
    out = None
    for low in range(0, max(1, len(qids.dictionary)), step):
        here = (number >= low) & (number < low + step)
        size = min(step, len(qids.dictionary) - low)
        matrix = np.zeros((len(used), max(0, size)))
        matrix[column[term[here]], number[here] - low] = w[here]
        held = units.sparkSession.sparkContext.broadcast((known, column, matrix, qids.dictionary.slice(low, step)))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            weigh, to, weights, names = held.value
            top = np.full((weights.shape[1], k), -np.inf)  # falling scores of each query in this task
            for b in batches:
                for first, e in terms.entries(_lists(b["words"])) if weights.size else ():
                    for low, many, r, t, x in weigh.rows(e):
                        keep = to[t] >= 0
                        block = np.zeros((many, len(weights)))
                        block[r[keep], to[t[keep]]] = x[keep]
                        asking = np.flatnonzero(block.max(axis=0) @ weights >= top[:, -1] - 1e-6)
                        if not len(asking):
                            continue
                        score = block @ weights[:, asking]
                        score = np.where(score > 0, np.round(score, 6), -np.inf)
                        unit = b["unit"].slice(first + low, many)
                        place = np.empty(many, np.int64)
                        place[pc.sort_indices(unit).to_numpy()] = np.arange(many)
                        order = np.lexsort((np.broadcast_to(place[:, None], score.shape), -score), axis=0)[:k]
                        found = np.take_along_axis(score, order, axis=0)
                        good = (found > -np.inf) & (found >= top[asking, -1])
                        both = np.concatenate([top[asking], found.T], axis=1)
                        top[asking] = -np.sort(-both, axis=1)[:, :k]
                        yield pa.record_batch([names.take(pa.array(np.broadcast_to(asking, good.shape)[good])), unit.take(pa.array(order[good])), found[good]], names=["qid", "unit", "score"])

        one = cut.mapInArrow(run, f"qid {asked.schema['unit'].dataType.simpleString()}, unit {kind}, score double")
        out = one if out is None else out.unionByName(one)
    return out

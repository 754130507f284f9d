"""Language ID with bit-sliced Bloom filters: one word of the filter holds, per slot, the mask of languages.

An n-gram's masks at its slots, ANDed, give all languages that contain it (and some by accident). A text's n-grams are
counted per language, the count is corrected by the filter's false-positive rate, and the largest decides.

Edge cases: a null or empty text, or one without a letter (of any plane of Unicode), is `und` with score 0; a text whose
n-grams no language contains gets the language with most training rows and score 0; ties go to the first language in order;
rows without a language or a text are not learned from, nor are those with a null id (it is held out); repeated rows are
answered alike; very long texts are read whole; with no training rows every text is `und`; an empty table gives an empty
result; columns in `keep` come through whatever their names, and the two new ones have the names that are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import fold, portions, quoted, saved

ORDERS = (1, 2, 3)
TRAIN_ROWS = 20_000  # labelled rows that the filters are learned from, shared evenly by the languages, by hash of the id
GRAMS = 50_000  # size of the model: n-grams per language in the filters, most frequent first
SEEN = 3  # an n-gram that the training rows of a language hold fewer times is no evidence of it
PORTION = 400_000  # bytes of text whose n-grams are held at once; a longer text stands alone
LEAST_SHARE = 0.4  # a language contains an n-gram if its rate is at least so much of the largest rate
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LETTER = np.zeros(0x110000, bool)


def _letters() -> np.ndarray:
    if not _LETTER[97]:
        _LETTER[:] = [chr(i).isalpha() for i in range(len(_LETTER))]
    return _LETTER


def gram_keys(texts: list[str | None], orders: tuple[int, ...] = ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all n-grams of letters (words padded with a blank), and the row each comes from. Texts are lower-cased."""
    joined = "\0".join(["", *[(t or "").replace("\0", " ") for t in texts], ""]).lower()
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    row = np.cumsum(points == 0) - 1
    before = np.concatenate([[False], letter[:-1]])
    kept = letter | before | (points == 0)  # a blank after each word; the row mark also stands before the first
    code, row = np.where(letter, points, 32).astype(np.uint64)[kept], row[kept]
    keys, rows = [], []
    for n in orders:
        if len(code) < n:
            continue
        k = np.zeros(len(code) - n + 1, np.uint64)
        for i in range(n):
            k = (k ^ code[i : len(code) - n + 1 + i]) * _MIX
            k ^= k >> np.uint64(29)
        first, last = row[: len(k)], row[n - 1 :]
        good = first == last
        if n == 1:
            good &= code != 32
        keys.append(k[good] + np.uint64(n))
        rows.append(first[good])
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys_all, rows_all = np.concatenate(keys), np.concatenate(rows)
    order = np.argsort(rows_all, kind="stable")
    keys_all, rows_all = keys_all[order], rows_all[order]
    inside = rows_all < len(texts)
    return keys_all[inside], rows_all[inside]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in portions(batches, "text", PORTION):
        keys, rows = gram_keys(b["text"].to_pylist())
        names, code = np.unique(np.array(b["lang"].to_pylist(), object).astype(str), return_inverse=True)
        of = code[rows]
        for i, name in enumerate(names):
            k, n = np.unique(keys[of == i], return_counts=True)
            yield pa.record_batch({"gram": k.view(np.int64), "lang": pa.array([str(name)] * len(k), pa.string()), "n": n.astype(np.int64)})


class Filters:
    """Bloom filters of all languages side by side: words[w][slot] has bit l for language 64 w + l."""

    def __init__(self, langs: list[str], grams: np.ndarray, of: np.ndarray, default: str, hashes: int = 3, spare: float = 12.0) -> None:
        self.langs, self.default, self.hashes = langs, default, hashes
        self.bits = max(10, int(np.ceil(np.log2(max(1, len(np.unique(grams))) * spare))))
        self.words = np.zeros((-(-len(langs) // 64) or 1, 1 << self.bits), np.uint64)
        for slot in self._slots(grams):
            np.bitwise_or.at(self.words, (of // 64, slot), np.uint64(1) << (of % 64).astype(np.uint64))
        fill = np.array([np.mean((self.words[i // 64] >> np.uint64(i % 64)) & np.uint64(1)) for i in range(len(langs))])
        self.false_rate = fill**hashes

    def _slots(self, keys: np.ndarray) -> list[np.ndarray]:
        shift = np.uint64(64 - self.bits)
        return [((keys ^ np.uint64(i * 0x51ED27)) * (_MIX + np.uint64(2 * i * 0x1234567)) >> shift).astype(np.int64) for i in range(self.hashes)]

    def masks(self, keys: np.ndarray) -> np.ndarray:
        slots = self._slots(keys)
        found = self.words[:, slots[0]]
        for s in slots[1:]:
            found = found & self.words[:, s]
        return found

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        keys, rows = gram_keys(texts)
        n = np.bincount(rows, minlength=len(texts)).astype(float)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        masks = self.masks(keys)
        hits = np.stack([np.bincount(rows[(masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1) == 1], minlength=len(texts)) for i in range(len(self.langs))])
        true = np.maximum(0, (hits - n * self.false_rate[:, None]) / (1 - np.minimum(self.false_rate, 0.999))[:, None])
        best, total = true.argmax(axis=0), true.sum(axis=0)
        top = true.max(axis=0)
        score = np.where(total > 0, top / np.maximum(total, 1e-9), 0.0)
        said = [("und" if not n[i] else self.langs[best[i]] if total[i] > 0 else self.default) for i in range(len(texts))]
        return said, np.clip(score, 0, 1)


def learn(docs: DataFrame, *, rows: int = TRAIN_ROWS, grams: int = GRAMS, seen: int = SEEN, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Filters from rows with a language outside the held-out fold; at most about `rows` of them, by hash of the id.

    Each language has the same share of them, so small ones are learned whole.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where((fold("id") != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    docs_by = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    langs = sorted(docs_by)
    if not langs:
        return Filters([], np.zeros(0, np.uint64), np.zeros(0, np.int64), "und")
    most = -(-rows // len(langs))
    if max(docs_by.values()) > most:
        share = F.create_map(*[F.lit(x) for k, n in docs_by.items() for x in (k, min(1_000_000, most * 1_000_000 // n))])
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share[F.col("lang")])
    counts = saved(known.select("lang", "text").mapInArrow(_count, "gram long, lang string, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n")), "lang-grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rate = counts.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total"))
    peak = rate.groupBy("gram").agg(F.max("rate").alias("peak"))
    kept = rate.join(peak, "gram").where((F.col("rate") >= LEAST_SHARE * F.col("peak")) & (F.col("n") >= seen))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    picked = kept.withColumn("place", place).where(F.col("place") <= grams).groupBy("lang").agg(F.collect_list("gram").alias("grams"))
    owners, of = [], []
    for r in picked.collect():  # a row a language, at most `grams` numbers each
        owners.append(np.array(r["grams"], np.int64).view(np.uint64))
        of.append(np.full(len(r["grams"]), langs.index(r["lang"])))
    if not owners:
        owners, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    return Filters(langs, np.concatenate(owners), np.concatenate(of), max(langs, key=lambda x: (docs_by[x], x)))


def identify(docs: DataFrame, filters: Filters, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns in `keep`, then the language and the score under `names`, for every row. Map only: no shuffle."""
    plain = [f"c{i}" for i in range(len(keep))]  # Python takes plain names only
    whole = text_col in keep  # whole rows carry the text once
    text = plain[keep.index(text_col)] if whole else "words"
    share = docs.sparkSession.sparkContext.broadcast(filters)  # size set by GRAMS, the languages and `spare`

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, text, PORTION):
            said, score = share.value.decide(b[text].to_pylist())
            yield pa.record_batch([*[b[c] for c in plain], pa.array(said, pa.string()), pa.array(score, pa.float64())], names=[*plain, "said", "sure"])

    source = quoted(docs, *keep, *([] if whole else [text_col]))
    kinds = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(plain, source.schema, strict=False))
    return source.toDF(*plain, *([] if whole else [text])).mapInArrow(run, f"{kinds}, said string, sure double").toDF(*keep, *names)

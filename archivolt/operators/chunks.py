"""Cutting texts into chunks with their provenance."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivolt.functions import text as X
from archivolt.operators.matching import found_phrases
from archivolt.sources.shared import saved

# The mark of a page; what stands between a title and its page number in a table of contents.
MARK = r"\[PAGE:(\d+)\]"
PAGE_BEHIND = r"[\s,，．。·、—\-]*\d{1,4}"


def window_chunks(docs: DataFrame, max_chars: int = 3500, overlap: int = 300) -> DataFrame:
    """doc_id, source, seq, text: windows of max_chars that step by max_chars - overlap; the last ends with the text."""
    clean = X.strip(X.sub(X.sub(F.col("text"), r"\n{3,}", "\n\n"), r"[ \t]{2,}|\t", " "))
    step = max_chars - overlap
    count = F.when(F.length("t") <= max_chars, F.lit(1)).otherwise(1 + F.ceil((F.length("t") - max_chars) / step)).cast("int")
    # Exploded from an array of one, the cleaned text is a column that no later expression computes again.
    one = docs.select("doc_id", "source", F.explode(F.array(clean)).alias("t")).where(F.length("t") > 0)
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(F.col("t"), i * step + 1, F.lit(max_chars)))
    return one.select("doc_id", "source", F.posexplode(cut).alias("seq", "text"))


def merge_lines(text: str, target: int = 500, least: int = 100) -> list[tuple[str, int, int | None]]:
    """Chunks of joined lines with the offset of their first line and the page they start on."""
    import re

    out: list[list] = []
    held, start, page_at, page, place = "", 0, None, None, 0

    def emit() -> None:
        nonlocal held
        out.append([held, start, page_at])
        held = ""

    for raw in text.split("\n"):
        here, place = place, place + len(raw) + 1
        if m := re.search(MARK, raw):
            page = int(m[1])
        line = re.sub(MARK, "", raw).strip()
        if not line:
            if len(held) >= least:
                emit()
            continue
        if not held:
            start, page_at = here, page
        held += line
        if len(held) >= target:
            emit()
    if held:
        if len(held) >= least or not out:
            if len(held) >= least:
                emit()
        else:
            out[-1][0] += held
    return [tuple(x) for x in out]


def line_chunks(docs: DataFrame, target: int = 500, least: int = 100) -> DataFrame:
    """doc_id, source, seq, text, offset, page. Sequential within a document, so an Arrow helper; no shuffle."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(d, s, i, *c) for d, s, t in zip(f.doc_id, f.source, f.text, strict=True) for i, c in enumerate(merge_lines(t or "", target, least))]
            out = pd.DataFrame(rows, columns=["doc_id", "source", "seq", "text", "offset", "page"])
            yield out.astype({"page": "Int32"})

    return docs.select("doc_id", "source", "text").mapInPandas(run, "doc_id long, source string, seq int, text string, offset int, page int")


def body_samples(docs: DataFrame, max_chars: int = 400, k: int = 3, front: int = 12) -> DataFrame:
    """k evenly spaced segments of the text behind its first `front` per cent."""
    body = F.substring(F.col("text"), (F.length("text") * front / 100).cast("int") + 1, F.length("text"))
    b = docs.withColumn("body", body).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    start = F.greatest(F.lit(0), F.least(F.col("i") * F.floor(F.length("body") / k), F.length("body") - max_chars)).cast("int")
    return b.select("doc_id", "i", start.alias("start"), F.substring(F.col("body"), start + 1, F.lit(max_chars)).alias("text"))


def tag_places(chunks: DataFrame, terms: Sequence[str]) -> DataFrame:
    return chunks.withColumn("locations", X.found_terms(F.col("text"), terms))


def postings(tagged: DataFrame) -> DataFrame:
    """The inverted index in long form (place, doc_id, seq): a common place makes many short rows, not one long one."""
    return tagged.select(F.explode("locations").alias("place"), "doc_id", "seq")


def corpus_stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source").agg(F.count("*").alias("chunks"), F.floor(F.sum(F.length("text")) / F.count("*")).alias("avg_chars"))


def next_page(toc: DataFrame) -> Column:
    """Exclusive end of each item's page range: the next page that is not null, or the book's last page + 1."""
    # Backward, as a frame up to the end of the book would be read anew for each item.
    w = Window.partitionBy("book").orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.last("page", ignorenulls=True).over(w), F.max("page").over(Window.partitionBy("book")) + 1)


def section_of(chunks: DataFrame, toc: DataFrame) -> DataFrame:
    """chunks (book, chunk_id, page) with the first item, in order, whose page range holds the page.

    Each range is laid out over its pages, so that chunks and items meet by an equi-join, however large a book is.
    """
    ranges = toc.withColumn("stop", next_page(toc)).where(F.col("page") < F.col("stop"))
    pages = ranges.select("book", "ord", "item", F.explode(F.sequence("page", F.col("stop") - 1)).alias("page"))
    first = pages.groupBy("book", "page").agg(F.min_by("item", "ord").alias("section"))
    return chunks.select("book", "chunk_id", "page").join(first, ["book", "page"], "left").select("book", "chunk_id", "page", "section")


def approx_annotated(chunks: DataFrame, toc: DataFrame, front: float = 0.03) -> DataFrame:
    """book, chunk_id, section, page, how: pages by linear interpolation between a book's first and last page.

    chunks: book, chunk_id, offset, length (of the book's text). The body begins at `front` of it. Where no item holds the
    page, or the book has none with a page, all three are null.
    """
    ends = toc.groupBy("book").agg(F.min("page").alias("lo"), F.max("page").alias("hi"))
    body = F.greatest(F.col("length") * (1 - front), F.lit(1.0))
    along = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("offset") - F.col("length") * front) / body))
    page = F.bround(F.col("lo") + along * (F.col("hi") - F.col("lo")), 0).cast("int")
    got = section_of(chunks.join(ends, "book", "left").withColumn("page", page), toc)
    known = F.col("section").isNotNull()
    return got.select("book", "chunk_id", "section", F.when(known, F.col("page")).alias("page"), F.when(known, "approx").alias("how"))


def place_counts(postings_: DataFrame, most: int = 20) -> DataFrame:
    """place, n: the places with most chunks, ties by name."""
    return postings_.groupBy("place").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "place").limit(most)


def annotated_share(annotated: DataFrame) -> DataFrame:
    """book, chunks, with_page, with_section, share (of chunks with a section) per book."""
    c = annotated.groupBy("book").agg(F.count("*").alias("chunks"), F.count("page").alias("with_page"), F.count("section").alias("with_section"))
    return c.withColumn("share", F.round(F.col("with_section") / F.col("chunks"), 4))


def totals(chunks: DataFrame) -> DataFrame:
    """chunks, chars, mean_chars over all chunks: the summary of an index."""
    return chunks.agg(F.count("*").alias("chunks"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.round(F.avg(F.length("text")), 4).alias("mean_chars"))


def match_book(files: DataFrame, titles: DataFrame) -> DataFrame:
    """fid, title: the longest title that contains a file's name or is contained in it, both normalized; the first of equals.

    files: fid, name. titles: ord, title. Names and titles without a character left match nothing. Each side is searched once
    with an automaton of the other, so nothing is compared in pairs. Equal names and equal titles are searched as one: where
    either side has copies, pairs of files and titles would grow with their product.
    """
    bare = lambda c: F.explode(F.array(X.normalize(F.col(c), X.PUNCTUATION_TOC)))  # noqa: E731  (a column that the filter does not compute again)
    f = files.select("fid", bare("name").alias("fn")).where("fn <> ''")
    t = titles.select("ord", "title", bare("title").alias("tn")).where("tn <> ''")
    n = saved(f.select("fn").distinct())
    t = saved(t.groupBy("tn").agg(F.min(F.struct((-F.length("tn")).alias("short"), "ord", "title")).alias("book")))
    inside = found_phrases(n.select(F.col("fn").alias("doc_id"), F.col("fn").alias("text")), t.select(F.col("book").alias("eid"), F.col("tn").alias("part"))).select(F.col("doc_id").alias("fn"), F.col("eid").alias("book"))
    around = found_phrases(t.select(F.col("book").alias("doc_id"), F.col("tn").alias("text")), n.select(F.col("fn").alias("eid"), F.col("fn").alias("part"))).select(F.col("eid").alias("fn"), F.col("doc_id").alias("book"))
    best = inside.unionByName(around).groupBy("fn").agg(F.min("book").alias("book"))
    return f.join(best, "fn").groupBy("fid").agg(F.min("book")["title"].alias("title"))


def books(pages: DataFrame, letter: str = X.HAN) -> DataFrame:
    """book, text: the cleaned pages that are not blank in page order, each behind its mark. pages: book, page, ord, text."""
    p = pages.withColumn("text", X.clean_ocr_text(F.col("text"), letter)).where("text <> ''")
    p = p.withColumn("text", F.concat(F.lit("[PAGE:"), F.col("page").cast("string"), F.lit("]\n"), F.col("text")))
    parts = F.array_sort(F.collect_list(F.struct("page", "ord", "text")))
    return p.groupBy("book").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("text"))


def anchored(chunks: DataFrame, segments: DataFrame) -> DataFrame:
    """chunks (book, chunk_id, offset, section) with the section of the first segment that holds the offset, else their own.

    segments: book, ord, start, stop (exclusive), title.
    """
    hit = chunks.alias("c").join(segments.alias("s"), F.expr("c.book = s.book AND c.offset >= s.start AND c.offset < s.stop"), "left")
    got = hit.groupBy("c.book", "c.chunk_id", "c.section").agg(F.min_by("s.title", "s.ord").alias("exact"))
    return got.select("book", "chunk_id", F.coalesce("exact", "section").alias("section"), F.when(F.col("exact").isNotNull(), "exact").when(F.col("section").isNotNull(), "approx").alias("how"))


def title_places(text: str, title: str, gap: int = 12) -> list[int]:
    """Places of a title, as it is or without white space and punctuation, that no page number follows within `gap`."""
    import re

    half = title.translate(str.maketrans(X.FULL_WIDTH, X.HALF_WIDTH))
    bare = re.sub(rf"[\s{re.escape(X.PUNCTUATION_TOC)}]", "", half)
    number = re.compile(PAGE_BEHIND)
    found = {m.start() for t in {title, bare} if t for m in re.finditer(f"(?={re.escape(t)})", text) if not number.match(text[m.start() + len(t) : m.start() + len(t) + gap])}
    return sorted(found)


def anchor_segments(text: str, items: Sequence[tuple[str, int | None]]) -> list[tuple[int, str, int | None, int, int]]:
    """(ord, title, page, start, stop) of each title from the first found on; empty if too few titles are found.

    A table of contents at the front also holds the titles, so the walk begins at the upper quartile of first places. A
    title without a place of its own takes the segment before it; one that comes twice has the page of its first.
    """
    places = [title_places(text, t) for t, _ in items]
    firsts = sorted(p[0] for p in places if p)
    if len(firsts) < max(3, 0.3 * len(items)):
        return []
    at, first_page, anchors = firsts[int(len(firsts) * 0.75)], {}, []
    for (title, page), found in zip(items, places, strict=True):
        first_page.setdefault(title, page)
        place = next((p for p in found if p >= at), None)
        if place is not None:
            anchors.append((title, first_page[title], place))
            at = place + max(1, len(title))
        elif anchors:
            anchors.append(anchors[-1])
    starts = sorted({a[2] for a in anchors})
    stop = dict(zip(starts, [*starts[1:], len(text)], strict=True))
    return [(i, t, page, place, stop[place]) for i, (t, page, place) in enumerate(anchors)]


def anchors(books: DataFrame, toc: DataFrame) -> DataFrame:
    """book, ord, title, page, start, stop of the reliably anchored titles; one book with its titles a group.

    books: book, text. toc: book, ord, item, page. Walking a cursor is sequential within a book, so a helper.
    """
    items = toc.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("ord", "item", "page"))).alias("items"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(b, *s) for b, t, xs in zip(f["book"], f["text"], f["items"], strict=True) for s in anchor_segments(t, [(x["item"] or "", x["page"]) for x in xs])]
            yield pd.DataFrame(rows, columns=["book", "ord", "title", "page", "start", "stop"]).astype({"page": "Int32"})

    kind = dict(books.dtypes)["book"]
    return books.where("text IS NOT NULL").join(items, "book").select("book", "text", "items").mapInPandas(run, f"book {kind}, ord int, title string, page int, start int, stop int")

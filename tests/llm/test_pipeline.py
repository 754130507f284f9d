"""The corpus pipeline against brute force: null and repeated ids, repeated rows, an unlabelled table."""

import random

import pyarrow as pa

import corpus_pipeline
from archivolt.llm import jaccard
from archivolt.llm.words import shingles

DOCS = "doc_id long, text string, lang string, source string, row_key long"


def texts_of(rnd):
    word = lambda: "".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(3))
    return [[word() for _ in range(60)] for _ in range(24)]


def planted(langs=True):
    """Rows of 24 unlike texts: clean, near copies, repeated rows, ids that are null or shared by unlike texts."""
    rnd = random.Random(6)
    base = texts_of(rnd)
    near = [[*t[:59], "zz"] for t in base[:6]]
    ids = [i if i % 4 else None for i in range(24)]
    ids[5] = ids[6] = 77
    rows = [(d, " ".join(t)) for d, t in [*zip(ids, base, strict=True), *zip(range(100, 106), near, strict=True)]]
    rows += [rows[9], rows[9], rows[12], (77, "1 2 3"), (None, None)]
    return [(d, t, "en" if langs else None, "s", i) for i, (d, t) in enumerate(rows)], base


def classes(rows):
    x, row, _ = shingles(pa.array([r[1] for r in rows], pa.string()))
    sets = [set(x[row == i].tolist()) for i in range(len(rows))]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if v == old else v for v in label]
    return label


def test_near_duplicates_keep_one_row_of_each_class(spark):
    rows, _ = planted()
    rows = rows[:-2]
    label = classes(rows)
    want = []
    for c in set(label):
        want.append(min((r for r, v in zip(rows, label, strict=True) if v == c), key=lambda r: (r[0] is None, r[0] or 0, r[4])))
    got = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS).coalesce(1), "").collect()]
    assert sorted(got, key=lambda r: r[4]) == sorted(want, key=lambda r: r[4])


def test_run_with_null_ids_and_no_labels(spark, tmp_path):
    rows, base = planted(langs=False)
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    bench = [(0, " ".join(base[8])), (1, " ".join(base[5])), (2, " ".join(base[7][10:40]))]  # ids null, shared, plain
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted((r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str)
    kept = [min((r[0] for r in rows[:-2] if r[1] == " ".join(t)), key=str) for i, t in enumerate(base) if i not in (5, 7, 8)]
    # Texts 0 and 4 have a near copy with an id, which goes before null.
    kept = [100, *kept[1:4], 104, *kept[5:]]
    assert got == sorted(kept, key=str)


def test_stages_keep_columns_of_clashing_names_and_empty_tables(spark, tmp_path):
    from pyspark.sql import functions as F

    rows, base = planted()
    clash = ("lang_pred", "Score", "class_id", "lcs", "size", "shard", "copies", "rid", "text_", "a.b", "x`y")
    docs = spark.createDataFrame(rows, DOCS).select("*", *[F.lit(c).alias(c) for c in clash])
    bench = spark.createDataFrame([(0, " ".join(base[8]))], "item_id long, text string")
    for given, folder in ((docs, "some"), (docs.limit(0), "none")):
        at = str(tmp_path / folder)
        (bench if folder == "some" else bench.limit(0)).write.parquet(f"{at}/benchmark.parquet")
        kept = given
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, at)
            assert kept.columns == docs.columns, name
        out = kept.collect()
        assert bool(out) == (folder == "some") and all(r[c] == c for r in out for c in clash)
        assert corpus_pipeline.sharded(spark, kept, at).count() == len(out)
    english = corpus_pipeline.language(spark, docs, "").collect()
    assert {r.text for r in english} == {r[1] for r in rows if r[1] and any(c.isalpha() for c in r[1])}


def test_near_duplicates_of_a_shared_passage(spark, monkeypatch):
    taken, cored = [], jaccard.cored

    def counted(rows, name):
        taken.append((name, rows.count()))
        return cored(rows, name)

    monkeypatch.setattr(jaccard, "cored", counted)
    passage = [f"a{i}" for i in range(30)]
    texts = [" ".join([*passage, *(f"q{i}v{j}" for j in range(60))]) for i in range(100)]
    texts += [t.replace("v59", "v60") for t in texts[:3]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == list(range(100))
    _, large, paths, *_ = [n for name, n in taken if name == "cp-size"]
    assert large >= 2 * 103 and 0 < paths < large

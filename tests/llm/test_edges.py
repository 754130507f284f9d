"""Brute-force versions and edge cases of each training-data operator: nulls, repeats, ties, long texts, clashing columns."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from archivolt.llm import decontam, html, jaccard, langid, mixing, pii, queries, shard, tokens, topk, toxicity

SF = "/root/testdata/sf0.001"
VOCAB = "/opt/tokenizers/piece_bpe_32k.model"
# Further columns with the names that the operators' results have.
CLASH = ["class_id", "rid", "rep", "lang_pred", "score", "size", "shard", "slot", "n_tokens", "lcs", "row", "m", "target", "copies", "key"]


@pytest.fixture(scope="module")
def documents():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


def frame(spark, rows, langs=None):
    """Documents with further columns; rows: texts, or (id, text)."""
    rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
    made = [(d, t, langs[i] if langs else "en", f"s{i % 3}") for i, (d, t) in enumerate(rows)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string, source string")
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH])


LONG = " ".join(f"word{i % 977}" for i in range(20_000))


# Main text of pages


def test_only_the_ratio_tells_menus_from_text():
    links = "".join(f'<div><a href="/{i}">Topic number {i}</a></div>' for i in range(12))
    prose = [f"Paragraph {i} goes on about the matter at some length, as text does, without any links in it at all." for i in range(4)]
    short = "".join(f"<span><b>{w}</b></span><br>" for w in "home shop help".split())
    for page in (
        f"<body><div>{links}</div><div>{''.join(f'<p>{p}</p>' for p in prose)}</div></body>",
        f"<body><div>{''.join(f'<p>{p}</p>' for p in prose)}</div><div>{links}</div></body>",
        f"<body><div>{short}</div><div><div>{''.join(f'<p>{p}</p>' for p in prose)}</div></div><div>{short}</div></body>",
    ):
        assert html.main_text(page) == " ".join(prose)


def test_text_of_an_article_stays_whole_with_short_and_linked_lines():
    said = "A line that is long enough to be text, and to hold its neighbours up, stands here."
    page = f'<body><p>We use cookies</p><article><h1>Head</h1><p>{said}</p><p>No.</p><p><a href="x">All of it a link</a></p><p>{said}</p></article></body>'
    assert html.main_text(page) == f"Head {said} No. All of it a link {said}"


def test_end_tags_that_are_left_out_are_supplied():
    assert html.main_text('<article><p class="ad">buy<p>Real text here that stays</article>') == "Real text here that stays"
    assert html.main_text('<article><ul><li class="share">x<li>Kept point</ul></article>') == "Kept point"
    assert html.main_text("<nav><a>Home</a><article><p>Text of it</p></article>") == "Text of it"
    assert html.main_text("<table><tr><td class=ad>buy<td>Real cell of text<tr><td>Second row of it</table>") == "Real cell of text Second row of it"
    assert html.main_text("<body><nav>only a menu</nav></body>") == "only a menu"


def test_one_word_of_a_class_does_not_take_text_away():
    text = "Real history of the thing, told at length."
    assert html.main_text(f'<article><div class="social-history"><p>{text}</p></div><div class="reader-comments"><p>{text} No.</p></div></article>') == text


def test_constant_ratios_change_most_pages(monkeypatch):
    pages = pq.read_table(f"{SF}/pages.parquet")["html"].to_pylist()
    before = [html.main_text(p) for p in pages]
    monkeypatch.setattr(html, "smoothed", lambda ratios, weights, sigma=1.0: np.ones(len(ratios)))
    assert sum(html.main_text(p) != b for p, b in zip(pages, before, strict=True)) > 0.5 * len(pages)


def test_smoothing_and_regions_match_their_definitions():
    rnd = random.Random(1)
    r, w = np.array([rnd.random() * 50 for _ in range(17)]), np.array([float(rnd.random() < 0.7) for _ in range(17)])
    k = lambda i, j: math.exp(-((i - j) ** 2) / 2) if abs(i - j) <= 3 else 0.0
    want = [w[i] * sum(k(i, j) * w[j] * r[j] for j in range(17)) / sum(k(i, j) for j in range(-3, 20)) for i in range(17)]
    inner = slice(3, 14)
    assert np.allclose(html.smoothed(r, w)[inner], np.array(want)[inner])
    assert html.region([("", 0), ("body", 0), ("div", 1), ("div", 1)], [2, 2, 3], np.array([5.0, 5.0, 1.0])) == 2


def test_pages_of_every_kind(spark):
    long = "<article>" + "".join(f"<p>Line {i} of a very long article that goes on.</p>" for i in range(5000)) + "</article>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", long), (None, "u", "<p>a</p>"), (5, "u", "no tags &amp; none"), (5, "u", "no tags &amp; none")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", F.lit(1).alias("text"), F.lit(2).alias("n_chars"))
    got = sorted(tuple(r) for r in html.extract(df).collect() if r.page_id)
    assert [g[2] for g in got[:2]] == ["", ""] and len(got[2][2]) == got[2][3] > 200_000 and got[3] == got[4] == (5, "u", "no tags & none", 14)
    assert html.extract(df.limit(0)).count() == 0


# Exact top-k


def test_topk_repeats_ties_and_large_components(spark):
    rows = [(0, [1.0, 0.5]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [100_000.0, 1.0]), (4, [1.0]), (5, []), (6, None), (None, [1.0, 1.0]), (0, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", F.lit(1).alias("score"), F.lit(1).alias("copies"))
    got = [(r.rank, r.vec_id, r.score) for r in sorted(topk.top_k(df, k=5).collect(), key=lambda r: r.rank)]
    u, far = 1024, 102_400_000  # the least vector of id 0 asks: [1, 0.5]
    assert got == [(1, 3, far * u + u * u // 2), (2, 1, u * u * 3 // 2), (3, 1, u * u * 3 // 2), (4, 2, u * u * 3 // 2), (5, 4, u * u)]
    assert topk.top_k(df.limit(0)).count() == 0 and topk.top_k(df.where("vec_id = 1")).count() == 0


def test_topk_over_many_blocks(spark):
    rnd = np.random.default_rng(4)
    e = rnd.integers(-3, 4, (900, 5)) / 8.0
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(e)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in topk.top_k(df, query_every=10, row_block=64, query_block=16).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    z = np.floor(1024 * e).astype(int)
    for q in range(0, 900, 10):
        want = sorted((-int(x), i) for i, x in enumerate(z @ z[q]) if i != q)[:10]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]


# Sharding and mixing


def test_shards_hold_whole_groups_and_near_equal_bytes(spark):
    rnd = random.Random(7)
    texts = [f"text {rnd.randrange(400)} " * 3 for _ in range(3000)] + ["hot " * 10] * 1500 + [None, "", LONG[:9000]]
    got = shard.shard(frame(spark, texts), shards=8).collect()
    sizes, of = collections.Counter(), collections.defaultdict(set)
    group = collections.Counter()
    for r in got:
        sizes[r.shard] += r.size
        of[r.text_crc32].add(r.shard)
        group[r.text_crc32] += r.size
    mean = sum(sizes.values()) / 8
    unit = max(max(r.size for r in got), 0.25 * mean)
    assert len(got) == len(texts) and len(sizes) == 8 and max(abs(v - mean) for v in sizes.values()) <= unit + 8 * 0.002 * mean
    assert all(len(v) == 1 for k, v in of.items() if group[k] <= 0.25 * mean)
    assert all(r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) and r.size == 16 + len((texts[r.doc_id] or "").encode()) for r in got)


def test_mix_is_near_its_targets_and_reruns_agree(spark):
    rnd = random.Random(8)
    docs = frame(spark, [" ".join(["w"] * rnd.randrange(1, 60)) for _ in range(4000)] + [LONG, None, ""])
    runs = [sorted(tuple(r) for r in mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken").collect()) for _ in range(2)]
    assert runs[0] == runs[1]
    taken, target, spread = collections.Counter(), {}, collections.Counter()
    for d, size, source_size, t, n in runs[0]:
        f = t / source_size - math.floor(t / source_size)
        taken[source_size] += n
        target[source_size] = t
        spread[source_size] += size * size * f * (1 - f)
        assert n <= 3 * size
    assert all(abs(taken[s] - target[s]) <= 4 * math.sqrt(spread[s]) + 1 for s in target)


# Toxicity


def by_halves(s):
    """Maximal segments: the best segment (shortest of equals), then those left and right of it."""
    best = max(((sum(s[a:b]), -(b - a), -a) for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=(0,))
    if best[0] <= 0:
        return []
    a = -best[2]
    b = a - best[1]
    return [*by_halves(s[:a]), (a, b), *[(x + b, y + b) for x, y in by_halves(s[b:])]]


def test_all_maximal_segments_match_the_recursive_definition():
    rnd = random.Random(11)
    for _ in range(300):
        s = [rnd.choice([-1.0, 2.3, -1.0, 3.1, -1.0]) for _ in range(rnd.randrange(16))]
        got = toxicity.maximal_segments([(i, v) for i, v in enumerate(s) if v > 0], -1.0)
        assert [(a, b) for a, b, _ in got] == by_halves(s)


def test_log_odds_and_scores_match_brute_force(spark, documents):
    labels = pq.read_table(f"{SF}/labels.parquet").to_pylist()
    toxic = {r["doc_id"]: r["toxic"] for r in labels if r["toxic"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5}
    counts = [collections.Counter(), collections.Counter()]
    for d in documents:
        if d["doc_id"] in toxic:
            counts[toxic[d["doc_id"]]].update(re.findall(r"\w+", (d["text"] or "").lower()))
    model = toxicity.learn(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    n, mass = [sum(c.values()) for c in counts], 0.1 * sum(sum(c.values()) for c in counts)
    want = {}
    for w in counts[0] | counts[1]:
        prior = (counts[0][w] + counts[1][w]) * mass / sum(n)
        y = [c[w] + prior for c in counts]
        odds = [math.log(a / (m + mass - a)) for a, m in zip(y, n, strict=True)]
        if (odds[1] - odds[0]) / math.sqrt(1 / y[0] + 1 / y[1]) >= toxicity.Z:
            want[w] = odds[1] - odds[0]
    assert want and model.scores == pytest.approx(want)
    got = {r.doc_id: r.score for r in toxicity.score(spark.read.parquet(f"{SF}/documents.parquet"), model).collect()}
    for d in documents[:60]:
        words = re.findall(r"\w+", (d["text"] or "").lower())
        if len(words) > 120:
            continue
        s = [want.get(w, model.other) for w in words]
        each = sorted((model.rate * sum(s[a:b]) - math.log(len(s)) for a, b in by_halves(s)), reverse=True)
        x = min(60.0, each[0] + sum(v for v in each[1:] if v > 0)) if each else -math.log(max(len(s), 1)) - 1
        assert got[d["doc_id"]] == pytest.approx(1 / (1 + math.exp(-model.offset - model.slope * x)), abs=1e-6)


def test_toxicity_without_labels_and_rows(spark):
    docs = frame(spark, ["a b", None, "", LONG, (None, "a b"), "a b"])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, none)
    got = toxicity.score(docs, model, keep=tuple(docs.columns), names=("score_", "n", "p")).collect()
    assert len({r.score_ for r in got}) == 1 and len(got) == 6 and {r.score for r in got} == {"x"}
    assert toxicity.score(docs.limit(0), model).count() == 0


# Language ID


def test_letters_of_all_planes_and_none(spark):
    texts = ["😀😀", "𝒳𐐷", "12 34 !", None, "", LONG] + ["aa bb aa bb aa"] * 40 + ["cc dd cc dd cc"] * 40
    langs = [None] * 6 + ["l1"] * 40 + ["l2"] * 40
    docs = frame(spark, texts, langs)
    found = langid.identify(docs, langid.learn(docs), keep=tuple(docs.columns), names=("lang_pred_", "score_"))
    got = {r.doc_id: r for r in found.collect()}
    assert [got[i].lang_pred_ for i in (0, 2, 3, 4)] == ["und"] * 4 and got[1].lang_pred_ in ("l1", "l2") and got[5].score_ <= 1
    assert got[6].lang_pred_ == "l1" and got[50].lang_pred_ == "l2" and got[6].lang_pred == "x"
    assert langid.identify(docs.limit(0), langid.learn(docs.limit(0))).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, langid.learn(docs.limit(0))).collect()} == {"und"}


def test_filters_answer_like_exact_sets(spark, documents):
    """The same rule over exact sets of n-grams gives the same language but where the two best are close."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    by = collections.defaultdict(collections.Counter)
    for d in documents:
        if d["text"] is not None and d["lang"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 5:
            by[d["lang"]].update(langid.gram_keys([d["text"]])[0].tolist())
    rate = {k: {g: n / sum(c.values()) for g, n in c.items()} for k, c in by.items()}
    peak = collections.defaultdict(float)
    for c in rate.values():
        for g, x in c.items():
            peak[g] = max(peak[g], x)
    known = {k: {g for g, n in by[k].items() if n >= langid.SEEN and rate[k][g] >= langid.LEAST_SHARE * peak[g]} for k in by}
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, langid.learn(docs)).collect()}
    for d in documents:
        keys = langid.gram_keys([d["text"]])[0].tolist()
        hits = sorted(((sum(k in known[x] for k in keys), x) for x in known), reverse=True)
        if not keys:
            assert got[d["doc_id"]] == "und"
        elif hits[0][0] - hits[1][0] > 0.05 * len(keys):
            assert got[d["doc_id"]] == hits[0][1]


def test_a_text_of_two_languages_goes_to_the_first_in_order(spark):
    docs = frame(spark, ["aa bb"] * 50 + ["cc dd"] * 50 + ["aa bb cc dd"], ["l1"] * 50 + ["l2"] * 50 + [None])
    got = {r.doc_id: r for r in langid.identify(docs, langid.learn(docs)).collect()}
    assert got[100].lang_pred == "l1" and got[100].score == pytest.approx(0.5, abs=0.02)


# Personal data


def base_spans(text):
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }
    found = [(m.start(), n, m.end(), k) for n, (k, (p, ok)) in enumerate(kinds.items()) for m in re.finditer(p, text or "") if ok(m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_base_spans_match_the_stated_patterns(spark, documents):
    import hashlib

    hard = ["1.2.3.4.5.6.7.8", "a@b.c@d.e.f", "x" * 50 + "@" * 20 + "y.z", "4111 1111 1111 1111 4111-1111-1111-1111", "+1 2 3 4 5 6 7 8 9 +12345678 +1", "00001.002.3.0255", "4" * 400, "ä+49 (30) 1234567-8ß", None, ""]
    texts = [d["text"] for d in documents] + hard + [LONG, "1.1.1.1", "1.1.1.1"]
    got = {r.doc_id: r for r in pii.digest(*pii.spans(frame(spark, texts))).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), t
        assert [x for x in got[i].spans.split(",") if x and not x.startswith("id:")] == [x for x in want.split(",") if x]
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(len(re.findall(k + ":", want)) for k in ("email", "ip", "card", "phone"))
    assert pii.digest(*pii.spans(frame(spark, []))).count() == 0


# Token counts


def test_counts_of_all_documents_match_a_unigram_tokenizer(spark, documents):
    import sentencepiece
    from tokenizers import Tokenizer, models

    vocab = tokens.read_vocabulary(VOCAB)
    sp = sentencepiece.SentencePieceProcessor(model_file=VOCAB)
    plain = [(p or f"<no{i}>", sp.get_score(i)) for i, (p, _) in enumerate(vocab)]
    ref = Tokenizer(models.Unigram(plain, 0, False))
    docs = frame(spark, [(d["doc_id"], d["text"]) for d in documents] + [(None, "a b"), (-1, None), (-2, "")])
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs, vocab).collect()}
    known = {p for p, _ in vocab if p}
    for d in documents:
        t = d["text"] or ""
        marked = "▁" + t.replace(" ", "▁")
        if t and len(t) < 4000 and all(c in known for c in marked):
            assert got[d["doc_id"]] == len(ref.encode(marked).ids)
    assert got[-1] == got[-2] == 0 and got[None] > 0
    assert tokens.count_tokens(docs.limit(0), vocab).count() == 0


# Near duplicates and benchmark passages


def test_classes_of_repeated_and_null_ids(spark):
    base = " ".join(f"w{i}" for i in range(50))
    rows = [(5, base), (5, base), (None, base + " more"), (3, LONG), (3, LONG + " z"), (None, "alone here now it is"), (9, None), (9, "")]
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard.classes(frame(spark, rows)).collect()), key=str)
    want = [(5, 5, 2), (5, 5, 2), (None, 5, 2), (3, 3, 1), (3, 3, 1), (None, None, 0), (9, 9, 0), (9, 9, 0)]
    assert got == sorted(want, key=str)
    assert jaccard.classes(frame(spark, [])).count() == 0


def test_leaks_of_repeats_nulls_and_nothing(spark):
    item = " ".join(f"rare{i}" for i in range(30))
    bench = spark.createDataFrame([(1, item), (2, item), (3, None), (4, "")], "item_id long, text string").withColumn("lcs", F.lit(0))
    docs = frame(spark, [(1, f"so {item} then"), (1, f"so {item} then"), (2, f"{LONG} {item} {LONG}"), (None, item), (4, None), (5, ""), (6, LONG)])
    got = sorted(((r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()), key=str)
    assert got == sorted([(d, i) for d in (1, 2, None) for i in (1, 2)], key=str)
    assert decontam.leaks(docs, bench.limit(0)).count() == 0 and decontam.leaks(docs, bench.where("item_id > 2")).count() == 0


def test_registered_queries_keep_one_row_of_each_document(spark, documents):
    for name in ("op4_toxicity", "op5_jaccard_join", "op10_language", "op7_personal_data"):
        got = queries.QUERIES[name](spark, SF)
        assert got.count() == len(documents) and ("held_out" not in got.columns or got.where("held_out IS NULL").count() == 0)

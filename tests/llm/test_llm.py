"""Brute-force and edge-case tests of the training-data operators."""

import random

import numpy as np
import pyarrow as pa
import pytest

from archivolt.llm import decontam, html, jaccard, langid, mixing, pii, shard, tokens, topk, toxicity
from archivolt.llm.words import shingles

DOCS = "doc_id long, text string, lang string, source string, size string"
VOCAB = "/opt/tokenizers/piece_bpe_32k.model"


def frame(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source if i % 3 else None, "clash") for i, t in enumerate(texts)], DOCS)


ODD = [None, "", " \n ", "same words here now again and again", "same words here now again and again", "é" * 5000, "x y", "x y"]


def test_topk_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    e = rng.normal(0, 0.2, (700, 9)).round(2)
    rows = [(i, [float(x) for x in v], "extra") for i, v in enumerate(e)] + [(701, None, "n"), (702, [None] * 9, "n"), (703, [float("nan")] * 9, "n")]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")).collect()
    z = np.floor(1024 * e).astype(int)
    for q in range(0, 700, 100):
        s = z @ z[q]
        want = sorted((-int(s[i]), i) for i in range(700) if i != q)[:10]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want


def test_mix_sizes_targets_and_empty(spark):
    got = mixing.mix(frame(spark, ODD)).collect()
    assert len(got) == len(ODD) and all(r.taken <= 3 * r.size for r in got)
    assert abs(sum({r.source_size: r.target for r in got}.values()) - sum(r.size for r in got)) < 1e-6
    assert mixing.mix(frame(spark, []).limit(0)).count() == 0
    assert mixing.emit(frame(spark, ODD)).columns == [c.split()[0] for c in DOCS.split(", ")]


def test_shards_are_gapless_and_keep_equal_texts(spark):
    texts = [f"t{i % 90} " * (1 + i % 40) for i in range(900)]
    got = shard.shard(frame(spark, texts), shards=8).collect()
    assert len(got) == 900
    sizes = {}
    for r in got:
        sizes.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in sizes.values())
    totals = [sum(r.size for r in v) for v in sizes.values()]
    assert len(totals) == 8 and max(totals) < 1.1 * min(totals)
    assert shard.shard(frame(spark, ODD), shards=4).count() == len(ODD)
    assert shard.shard(frame(spark, ODD).limit(0), shards=4).count() == 0


@pytest.mark.parametrize("block", [512, 8])
def test_classes_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)  # small blocks: centres, cores and pairs of blocks
    rnd = random.Random(3)
    texts = list(ODD)
    for _ in range(60):
        base = [rnd.choice("abcdefghijklmnopqrstuvwxyz") + str(rnd.randrange(200)) for _ in range(60)]
        for _ in range(rnd.choice([1, 1, 2, 4, 60])):
            w = list(base)
            for _ in range(rnd.randrange(3)):
                w[rnd.randrange(len(w))] = "zz" + str(rnd.randrange(1000))
            texts.append(" ".join(w))
    star = [rnd.choice("abcd") + str(i) for i in range(80)]  # copies near one text, but not near one another
    texts += [" ".join([*star[: 2 * i], f"n{i}", *star[2 * i + 1 :]]) for i in range(1, 39)] + [" ".join(star)]
    passage = [f"p{i}" for i in range(60)]  # a passage that unlike texts share
    texts += [" ".join([*passage, *(f"q{i}v{j}" for j in range(25))]) for i in range(60)]
    got = {r.doc_id: r for r in jaccard.classes(frame(spark, texts)).collect()}
    x, row, _ = shingles(pa.array(texts, pa.string()))
    sets = [set(x[row == i].tolist()) for i in range(len(texts))]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(texts)
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    assert [(got[i].class_id, got[i].n_links) for i in range(len(texts))] == [(root(i), links[i]) for i in range(len(texts))]


def test_paths_take_only_large_buckets(spark, monkeypatch):
    taken, cored = [], jaccard.cored

    def counted(rows, name):
        taken.append((name, rows.count()))
        return cored(rows, name)

    monkeypatch.setattr(jaccard, "cored", counted)
    passage = [f"a{i}" for i in range(30)]  # a third of each of 200 texts, else unlike
    texts = [" ".join([*passage, *(f"q{i}v{j}" for j in range(60))]) for i in range(200)]
    texts += [t.replace("v59", "v60") for t in texts[:3]]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.classes(frame(spark, texts)).collect()}
    assert got == {i: (i % 200, int(i % 200 < 3)) for i in range(203)}
    _, large, paths, *_ = [n for name, n in taken if name == "cp-size"]
    assert large >= 2 * 203 and 0 < paths < large


def test_segments_match_the_definition():
    rnd = random.Random(5)
    for _ in range(200):
        n = rnd.randrange(1, 14)
        s = [rnd.choice([-1.0, 2.0, -1.0, 3.0]) for _ in range(n)]
        got = toxicity.maximal_segments([(i, v) for i, v in enumerate(s) if v > 0], -1.0)
        best = max(sum(s[a:b]) for a in range(n) for b in range(a + 1, n + 1))
        assert max((x[2] for x in got), default=-1.0) == pytest.approx(best)
        assert all(b <= c for (_, b, _), (c, _, _) in zip(got, got[1:], strict=False))


def test_toxicity_learns_and_holds_out(spark):
    rnd = random.Random(2)
    rows, labels = [], []
    for i in range(300):
        bad = i % 4 == 0
        w = [f"w{rnd.randrange(50)}" for _ in range(40)] + (["awful", "vile", "awful"] if bad else [])
        rows.append(" ".join(w))
        labels.append((i, 1, int(bad)))
    docs = frame(spark, [*rows, *ODD])
    model = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == bool(t) for i, _, t in labels) and len(got) == 308 and all(0 <= s <= 1 for s in got.values())


def test_language(spark):
    rnd = random.Random(4)
    text = lambda a: " ".join("".join(rnd.choice(a) for _ in range(5)) for _ in range(30))
    rows = [(i, text("abcdeé") if i % 2 else text("uvwxyz"), "l1" if i % 2 else "l2", "s", "x") for i in range(200)]
    docs = spark.createDataFrame([*rows, (900, None, "l1", "s", "x"), (901, "12 34", None, "s", "x")], DOCS)
    got = {r.doc_id: r for r in langid.identify(docs, langid.learn(docs)).collect()}
    assert all(got[i].lang_pred == r[2] for i, r in enumerate(rows)) and got[900].lang_pred == got[901].lang_pred == "und"


def test_main_text():
    page = '<html><head><title>T</title><script>x="</p>"</script></head><body><nav><a>menu</a></nav><div class="ad">buy</div><article><h1>Head &amp; line</h1><p>First  part<br>goes on</p><div class="comments">no</div><p>More</p></article><footer>f</footer>'
    assert html.main_text(page) == "Head & line First part goes on More"
    assert html.main_text(None) == html.main_text("") == "" and html.main_text("plain <b>words") == "plain words"


def test_token_counts_match_a_unigram_tokenizer():
    from tokenizers import Tokenizer, models

    vocab = tokens.read_vocabulary(VOCAB)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=VOCAB)
    full = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]
    plain = [(p if q else f"<no{i}>", s) for i, ((p, s), (q, _)) in enumerate(zip(full, vocab, strict=True))]
    ref = Tokenizer(models.Unigram(plain, 0, False))
    counts = tokens.Counts(vocab)
    for t in ["Hello world", "the  the   of", "a" * 50, "einen Überblick über", "x = 12345;"]:
        marked = "▁" + t.replace(" ", "▁")
        assert counts.text(t) == counts.segment(marked) == len(ref.encode(marked).ids)
    assert counts.text(None) == counts.text("") == 0 and counts.text("ab") == counts.text("ab")


def test_spans(spark):
    texts = ["mail a.b@c.example.com now", "ip 1.2.3.4 and 300.1.1.1", "card 4111 1111 1111 1111 ok", "+1 (234) 555-6789", "9" * 30000 + " a@b" * 3, None, ""]
    got = {r.doc_id: r for r in pii.digest(*pii.spans(frame(spark, texts))).collect()}
    assert [got[i].spans for i in range(7)] == ["email:5:22", "ip:3:10", "card:5:24", "phone:0:17", "", "", ""]
    assert got[5].base_sha256 == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_leaks_exact_and_paraphrased(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(3))
    common = [word() for _ in range(40)]
    text = lambda n: [rnd.choice(common) if rnd.random() < 0.5 else word() for _ in range(n)]
    items = [text(30) for _ in range(20)]
    docs = [text(200) for _ in range(80)]
    docs[3][50:50] = items[0]
    changed = list(items[1])
    changed[5], changed[15] = "other", "words"
    docs[7][120:120] = changed
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = decontam.leaks(frame(spark, [*map(" ".join, docs), None, ""]), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(3, 0), (7, 1)}
    assert decontam.leaks(frame(spark, []), bench).count() == 0


def test_identifiers_two_hops_from_the_seeds(spark):
    token = lambda i: f"{i * 7919 + 1:010x}q{i % 10}"
    first = [f'token = "{token(i)}"' for i in range(20)] + [f"ticket {token(i)};" for i in range(26)]
    second = [f"badge {token(i)}!" for i in range(20, 27)]
    plain = [f"around {token(i)}? and" for i in range(40, 48)]
    got = {r.doc_id: r for r in pii.digest(*pii.spans(frame(spark, first + second + plain))).collect()}
    assert [got[i].n_id for i in range(61)] == [1] * 53 + [0] * 8


def test_identifiers_beside_base_entities_and_with_separators(spark):
    mails = [f"reach user{i}@mail.example.com now" for i in range(6)] + ["reach k9-2x/77 now", "reach ab12 now"]
    cards = [f"paid {x} ok" for x in ("4111 1111 1111 1111", "5500 0000 0000 0004", "4012 8888 8888 1881")] + ["paid 12-34-56 ok", "paid 1234 5678 ok"]
    got = {r.doc_id: r for r in pii.digest(*pii.spans(frame(spark, [*mails, *cards, "seen 4242 there"]))).collect()}
    assert [got[i].spans for i in (6, 7, 11, 12, 13)] == ["id:6:14", "id:6:10", "id:5:13", "id:5:14", ""]


def test_leaks_of_long_and_reworded_items_match_brute_force(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(4))
    known = [word() for _ in range(4000)]
    items = [rnd.sample(known, rnd.choice([8, 10, 12, 59, 150, 300])) for _ in range(150)]
    docs = [[rnd.choice(known) for _ in range(rnd.choice([40, 700]))] for _ in range(200)]
    for i in range(80):
        said = list(items[i])
        if i % 2:  # reworded evenly: two words of six go, others come
            said = [w if j % 6 not in (1, 4) else rnd.choice(known) for j, w in enumerate(said)]
        at = rnd.randrange(len(docs[i]))
        docs[i][at:at] = said
    terms = {w: i for i, w in enumerate({w for t in items for w in t})}

    def lcs(item, doc):
        bits = {}
        for j, w in enumerate(item):
            bits[terms[w]] = bits.get(terms[w], 0) | 1 << j
        return decontam.common_subsequence(bits, len(item), [terms[w] for w in doc if w in terms])

    def leaked(item, doc):
        """Whether the item stands in the doc at all, and so in the words around one of its windows."""
        most, n = 0.6 * len(item), len(item)
        return lcs(item, doc) >= most and any(lcs(item, doc[max(0, j - n) : j + 32 + n]) >= most for j in range(0, max(1, len(doc) - 16), 16))

    want = {(d, i) for d, doc in enumerate(docs) for i, item in enumerate(items) if leaked(item, doc)}
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    found = decontam.leaks(frame(spark, list(map(" ".join, docs))), bench, answers=0.0).collect()
    assert {(i, i) for i in range(80)} <= want and {(r.doc_id, r.item_id) for r in found} == want
    copied = {(i, i) for i in range(0, 80, 2)}  # a reworded item may lose its rarest words, a copied one does not
    found = {(r.doc_id, r.item_id) for r in decontam.leaks(frame(spark, list(map(" ".join, docs))), bench).collect()}
    assert copied <= found <= want

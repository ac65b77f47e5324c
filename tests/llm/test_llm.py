"""The training-data operators against brute force and on the awkward cases of their docstrings."""
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voltaic.llm import decontam, hashing, html, jaccard, langid, linededup, lm, mixing, pstable, quality, queries, sharding
from voltaic.llm.graph import connected_components

from . import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h1 string, comp int, _key int, full int"


def docs_of(spark, texts, **extra):
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, 0, "x", 1, 2, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def near_texts(n, seed=1):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    base = [[rng.choice(vocab) for _ in range(rng.choice([1, 3, 5, 8, 12, 20, 30, 60, 150]))] for _ in range(n // 6)]
    passage = [rng.choice(vocab) for _ in range(25)]
    out = [None, "", "  \n ", "One", "one", "a b", "A  b"]
    while len(out) < n:
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            k = rng.randrange(max(1, len(w)))
            w[k:k + 1] = rng.choice([[], ["zz"], w[k:k + 1] + ["yy"]])
        if rng.random() < 0.1:
            w += passage
        out.append(" ".join(w))
    return out


def test_words_match_the_pattern():
    texts = near_texts(60) + ["x" * (3 << 20) + " y", "Ünïcode É e9 a_b\x0bq\x1cz", None]
    raw, off = hashing.string_buffers(pa.array(texts))
    for table, words in ((hashing.SPACE_WORDS, brute.space_words), (hashing.ALNUM_WORDS, brute.alnum_words)):
        h, first = hashing.hash_words(raw, off, table)
        expected = [words(t) for t in texts]
        assert np.diff(first).tolist() == [len(w) for w in expected]
        names = {}
        for code, w in zip(h.tolist(), [w for ws in expected for w in ws]):
            assert names.setdefault(code, w) == w
        assert len(names) == len({w for ws in expected for w in ws})


@pytest.mark.parametrize("shingle,num,den", [(4, 85, 100), (5, 80, 100), (2, 50, 100)])
def test_jaccard_join_is_exact(spark, shingle, num, den):
    texts = near_texts(260)
    got = jaccard.jaccard_join(docs_of(spark, texts), shingle=shingle, num=num, den=den).collect()
    assert sorted(tuple(r) for r in got) == brute.jaccard(list(enumerate(texts)), shingle, num, den)
    assert sum(r.n_links for r in got) > 100


def test_jaccard_blocks_split_a_large_group(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"t{k}" for k in range(120)]
    texts = []
    for _ in range(70):
        w = list(base)
        w[rng.randrange(120)] = f"n{rng.randrange(10 ** 6)}"
        texts.append(" ".join(w))
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    got = jaccard.jaccard_join(docs_of(spark, texts), shingle=4, num=85, den=100).collect()
    assert sorted(tuple(r) for r in got) == brute.jaccard(list(enumerate(texts)), 4, 85, 100)
    assert {r.component_id for r in got} == {0}


def test_jaccard_repeated_ids_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (9, "a b c d e"), (8, None)],
                               "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard.jaccard_join(df, shingle=4).collect()), key=str)
    assert got == sorted([(None, 2, None, 0), (7, 2, 7, 2), (7, 2, 7, 2), (9, 2, 7, 2), (8, 0, 8, 0)], key=str)
    assert jaccard.jaccard_join(df.limit(0)).collect() == []


def test_slices_keep_every_linked_pair():
    rng = np.random.default_rng(5)
    for _ in range(400):
        n = int(rng.integers(1, 90))
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) > 0.08], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 8)), dtype=np.uint64)]))
        inter = len(np.intersect1d(x, y))
        if len(y) and 100 * inter >= 85 * (len(x) + len(y) - inter) and inter < max(len(x), len(y)):
            assert np.intersect1d(jaccard.slice_keys(x, 85, 100), jaccard.slice_keys(y, 85, 100)).size


def test_dual_traversal_loses_no_link():
    rng = np.random.default_rng(2)
    base = [np.unique(rng.integers(0, 1 << 63, int(n), dtype=np.uint64)) for n in rng.integers(5, 60, 12)]
    sets = [np.unique(np.concatenate([b[rng.random(len(b)) > 0.05], b[:1]])) for b in base for _ in range(6)]
    x, y = jaccard.link_blocks(sets, None, 85, 100)
    exact = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))
             if 100 * (k := len(np.intersect1d(sets[i], sets[j]))) >= 85 * (len(sets[i]) + len(sets[j]) - k)}
    assert set(zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist())) == exact and exact


def test_components_of_chains_stars_and_nothing(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(5, 5), (None, 3)]
    got = dict(connected_components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect())
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 120)} == {100}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_line_templates(spark):
    rows = [f"own line {chr(97 + i)} {chr(97 + i) * 3} here {chr(98 + i) * 2}\nPage {i} of {i + 9} printed on day {i}\n\nok" for i in range(8)]
    rows += [rows[0], None, "", "Share this page\t now with  friends", "only mine words stay here"]
    rows += [f"Share this page now with {w}" for w in ("friends", "friends ", "us", "me", "you all")]
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in enumerate(rows)], "doc_id long, text string, n_lines int, _gone string")
    got = {r.doc_id: r for r in linededup.drop_recurring_lines(df, min_texts=5).collect()}
    assert got[1].text == "own line b bbb here cc\n\nok" and (got[1].n_lines, got[1].n_dropped) == (4, 1)
    assert got[9].text is None and (got[9].n_lines, got[9].n_dropped) == (0, 0)
    assert got[10].text == "" and got[12].text == "only mine words stay here"
    assert got[11].text == "" and got[11].n_dropped == 1          # a variant of the generalised template
    assert linededup.drop_recurring_lines(df.limit(0)).collect() == []


def test_shards_follow_the_mixture(spark):
    texts = ["t" * (i % 7) for i in range(999)] + [None]
    got = sharding.assign_shards(docs_of(spark, texts), 24).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
        t = texts[r.doc_id] or ""
        assert r.size == len(t) + 8 and r.text_crc32 == zlib.crc32(t.encode())
    counts = [len(v) for v in by.values()]
    assert len(by) == 24 and max(counts) - min(counts) <= 1
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        for s in ("s0", "s1", "s2", None):
            share = sum(r.source == s for r in got) / 1000
            assert abs(sum(r.source == s for r in rows) - share * len(rows)) <= 3
    assert sharding.assign_shards(docs_of(spark, texts).limit(0), 24).collect() == []


def mix_frame(spark):
    rows = [(i, "w " * (1 + i % 4), s) for i, s in enumerate(["big"] * 400 + ["mid"] * 100 + ["small"] * 25 + [None] * 10)]
    rows += [(1000, None, "void"), (1001, "", "void"), (3, "w w w w ", "big")]
    return spark.createDataFrame([r + (1, 2) for r in rows], "doc_id long, text string, source string, full int, _cut int")


def test_mixing_meets_the_limit_and_the_budget(spark):
    df = mix_frame(spark)
    plan = {r.src: r for r in mixing.source_plan(df, max_repeat=3.0).collect()}
    tokens = {"1" + s if s else "0": sum(len((r.text or "").split()) for r in df.collect() if r.source == s)
              for s in ("big", "mid", "small", None, "void")}
    assert {k: v.tokens for k, v in plan.items()} == tokens
    assert max(r.passes for r in plan.values()) == pytest.approx(3.0, abs=1e-5)
    assert min(r.passes for r in plan.values()) == pytest.approx(1.0, abs=1e-6)
    out = mixing.mix_sources(df, mixing.source_plan(df, max_repeat=3.0))
    assert out.columns == df.columns + ["epoch"]
    got = out.collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in df.collect()}
    for src, p in plan.items():
        name = src[1:] or None
        n = sum(len((r.text or "").split()) for r in got if r.source == name)
        assert p.passes * p.tokens - 8 <= n <= p.passes * p.tokens + 1e-6
    place = mixing.block_positions(out).collect()
    for block in {(r.source, r.epoch) for r in place}:
        at = [r.position for r in place if (r.source, r.epoch) == block]
        assert sorted(at) == list(range(len(at)))
    assert mixing.mix_sources(df.limit(0), mixing.source_plan(df.limit(0))).collect() == []


def test_mixing_meets_an_entropy(spark):
    plan = mixing.source_plan(mix_frame(spark), target_entropy=1.0, budget=500).collect()
    assert -sum(r.weight * math.log(r.weight) for r in plan if r.weight) == pytest.approx(1.0, abs=1e-5)
    assert sum(r.weight for r in plan) == pytest.approx(1.0)


def pstable_brute(vectors, least):
    rows = [(i, None if v is None or not v or None in v or not np.isfinite(v).all() or not any(v) else np.array(v, float))
            for i, v in vectors]
    links, pairs = [0] * len(rows), []
    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a][1], rows[b][1]
            if x is not None and y is not None and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= least:
                links[a] += 1
                links[b] += 1
                pairs.append((a, b))
    comp = brute.components(len(rows), pairs)
    return [(i, n, rows[c][0], rows[c][0] == i) for (i, _), n, c in zip(rows, links, comp)]


def test_embedding_links(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vectors = []
    for c in range(12):
        base = rng.standard_normal(32)
        vectors += [(base + rng.standard_normal(32) * 0.12).astype(np.float32).tolist() for _ in range(12)]
    vectors += [vectors[0]] * 30 + [None, [], [0.0] * 32, [float("nan")] * 32, [None] + [1.0] * 31, [1.0, 2.0], [1.0, 2.0], [2.0, 4.0]]
    rows = list(enumerate(vectors))
    monkeypatch.setattr(pstable, "BLOCK", 8)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in pstable.embedding_dedup(df).collect())
    assert got == pstable_brute(rows, 0.9)
    assert pstable.embedding_dedup(df.limit(0)).collect() == []


def test_embedding_recall_at_the_threshold():
    rng = np.random.default_rng(9)
    a, b = (pstable.normalise(rng.standard_normal((6000, 64))) for _ in range(2))
    b = pstable.normalise(b - (a * b).sum(1, keepdims=True) * a)
    met = (pstable.bucket_codes(a) == pstable.bucket_codes(0.9 * a + np.sqrt(1 - 0.81) * b)).any(1)
    assert met.mean() > 0.98


def test_decontamination(spark, monkeypatch):
    rng = random.Random(8)
    vocab = [f"v{k}" for k in range(60)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([2, 4, 7, 13, 14, 30, 50])))) for i in range(25)]
    items += [(0, items[0][1]), (None, "null id item with a few words"), (90, None), (91, " .. "), (92, "a a a a a a a a a a a a a a a")]
    texts = [None, "", "!!", "x a a a a a a a a a a a a a a a a a", "null ID item-with a few words"]
    for _ in range(150):
        w = [rng.choice(vocab) for _ in range(rng.choice([0, 5, 40, 200]))]
        for _ in range(rng.choice([0, 1, 3])):
            s = rng.choice([t for _, t in items if t]).split()
            a = rng.randrange(len(s))
            at = rng.randrange(len(w) + 1)
            w[at:at] = s[max(0, a - 15):a + 15]
        texts.append(" ".join(w).upper() if rng.random() < 0.2 else ", ".join(w))
    docs, bench = docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    expected = brute.hits(list(enumerate(texts)), items, 13)
    for block in (decontam.BLOCK_BYTES, 700):
        monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
        got = decontam.benchmark_hits(docs, bench).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got} == expected
    assert sum(v[1] > 0 for v in expected.values()) > 50
    none = decontam.benchmark_hits(docs, bench.limit(0)).collect()
    assert len(none) == len(texts) and not any(r.n_hit for r in none)
    assert decontam.benchmark_hits(docs.limit(0), bench).collect() == []


def test_language_id_scores_like_a_plain_bayes(spark):
    texts = ["The quick brown fox", "Der schnelle Fuchs läuft", "the dog and the fox", "die Katze und der Hund", None, "", "12 !?", "É"]
    langs = ["en", "de", "en", "de", "en", "de", None, None]
    df = spark.createDataFrame([(i, t, c, "x") for i, (t, c) in enumerate(zip(texts, langs))],
                               "doc_id long, text string, lang string, lang_pred string")
    model = langid.train(df, F.lit(True))
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert model[0] == ["de", "en"]
    assert [got[i].lang_pred for i in range(4)] == ["en", "de", "en", "de"]
    assert [(got[i].lang_pred, got[i].score) for i in (4, 5, 6)] == [("und", 0.0)] * 3
    assert got[7].lang_pred in ("de", "en")

    def slots(t):
        raw, off = hashing.string_buffers(pa.array([t]))
        return np.concatenate([s[i] for s, i in langid.slots(raw, off)])
    counts = np.full((2, langid.FEATURES), langid.SMOOTH)
    for t, c in zip(texts, langs):
        if t and c:
            np.add.at(counts[model[0].index(c)], slots(t), 1)
    logp = np.log(counts / counts.sum(1, keepdims=True))
    for i in range(4):
        z = logp[:, slots(texts[i])].sum(1)
        assert got[i].score == pytest.approx(1 / np.exp(z - z.max()).sum(), rel=1e-3)
    empty = langid.train(df.limit(0), F.lit(True))
    assert {(r.lang_pred, r.score) for r in langid.identify(df, empty).collect()} == {("und", 0.0)}
    assert langid.identify(df.limit(0), model).collect() == []


def test_language_id_of_a_cut_text_is_that_of_the_whole(monkeypatch):
    text = "Ein langer Text mit vielen Wörtern. " * 50
    raw, off = hashing.string_buffers(pa.array(["ab", text, ""]))
    whole = sorted(np.concatenate([s[i] for s, i in langid.slots(raw, off)]).tolist())
    cut = [s for lo, hi, a, b in langid.pieces(off, 64) for s, _ in langid._grams(raw, off, lo, hi, a, b, off[hi])]
    assert sorted(np.concatenate(cut).tolist()) == whole
    ref = quality.term_counts(raw, off)
    monkeypatch.setattr(quality, "pieces", lambda o, most: langid.pieces(o, 64))
    assert (quality.term_counts(raw, off) == ref).all()


def test_held_out_accuracy(spark, sf_dir):
    lang = {r.doc_id: r.lang for r in queries.table(spark, sf_dir, "documents").collect()}
    out = queries.op8(spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held) > 0
    label = {r.doc_id: r.quality for r in queries.table(spark, sf_dir, "labels").collect()}
    out = queries.op4(spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
               and r.predicted == (r.score >= 0.3) for r in out)
    held = [r for r in out if r.held_out and r.doc_id in label]
    assert sum(r.predicted == label[r.doc_id] for r in held) >= 0.85 * len(held) > 0


def test_quality_without_labels_or_texts(spark):
    df = docs_of(spark, ["some words", None, ""])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality.score_quality(df, quality.fit(df, none, F.lit(True))).collect()] == [0.5] * 3
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (1, None, 0), (None, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(df, labels, F.lit(True))
    assert [r.score for r in quality.score_quality(df, model).collect()] == [1.0] * 3
    assert quality.score_quality(df.limit(0), model).collect() == []


def test_neighbour_votes_are_exact():
    rng = np.random.default_rng(6)
    counts = rng.poisson(0.3, (60, quality.TERMS)).astype(np.float32)
    labels = np.arange(60) % 2
    model = quality.LatentVotes(counts, labels, {0: 30, 1: 90})
    query = rng.poisson(0.3, (5, quality.TERMS)).astype(np.float32)
    for row, got in zip(query, model.score(query)):
        x = quality.spread(row[None]) * model.idf
        cosine = (model.latent(x / np.linalg.norm(x)) @ model.known.T)[0]
        near = np.argsort(-cosine)[:quality.NEIGHBOURS]
        vote = np.maximum(cosine[near], 1e-6) ** quality.SHARPNESS * np.where(labels[near] == 1, 3, 1)
        assert got == pytest.approx(vote[labels[near] == 1].sum() / vote.sum(), rel=1e-4)


def test_quality_sees_words_of_equal_shape():
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    vocab = [[word(3 + k % 6) for k in range(60)] for _ in range(2)]
    labels = np.arange(300) % 2
    texts = [" ".join(rng.choice(vocab[c]) for _ in range(40)).capitalize() + "." for c in labels]
    raw, off = hashing.string_buffers(pa.array(texts))
    counts = quality.term_counts(raw, off)
    model = quality.LatentVotes(counts[:200], labels[:200], {0: 100, 1: 100})
    assert ((model.score(counts[200:]) >= 0.5) == labels[200:]).mean() > 0.95


def test_pseudo_likelihood(spark, sf_dir):
    df = queries.table(spark, sf_dir, "documents")
    vocabulary, flat = lm.fit(df)
    net = lm.Network(flat)
    texts = ["The and of the", None, "", "one", "The and of the"]
    got = {r.doc_id: r for r in lm.score_documents(docs_of(spark, texts), (vocabulary, flat)).collect()}
    assert (got[1].n_tokens, got[1].log_prob, got[1].mean_log_prob) == (0, 0.0, None) and got[0].log_prob == got[4].log_prob
    raw, off = hashing.string_buffers(pa.array(texts[:1]))
    ids = lm.token_ids(hashing.hash_words(raw, off, hashing.SPACE_WORDS)[0])
    total = 0.0
    for i in range(len(ids)):
        h = net.bias.copy()
        for j, d in enumerate(lm.WINDOW):
            h += net.emb[j][ids[i + d] % lm.CONTEXT if 0 <= i + d < len(ids) else lm.CONTEXT]
        z = np.tanh(h) @ net.out + net.out_bias
        c = vocabulary.classes[ids[i]]
        total += z[c] - np.log(np.exp(z).sum()) + vocabulary.within[ids[i]]
    assert got[0].log_prob == pytest.approx(total, rel=1e-4)
    plain = lm.Network(lm.Network.fresh(vocabulary.class_mass).flat)
    plain.out[:] = 0
    rows = pa.array([r.text for r in df.limit(100).collect()])
    raw, off = hashing.string_buffers(rows)
    w, first = hashing.hash_words(raw, off, hashing.SPACE_WORDS)
    ids = lm.token_ids(w)
    assert lm.token_log_probs(ids, first, vocabulary, net).mean() > lm.token_log_probs(ids, first, vocabulary, plain).mean()
    empty = lm.fit(df.limit(0))
    assert lm.score_documents(df.limit(0), empty).collect() == []


def test_pseudo_likelihood_learns_from_every_text(spark):
    texts = [f"alpha beta gamma delta w{k}" for k in range(24)] + [None]
    for ids in (range(25), [None] * 25):
        df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
        vocabulary, flat = lm.fit(df)
        assert np.abs(flat - lm.Network.fresh(vocabulary.class_mass).flat).max() > 0.01
        for k in (0, 11, 23):                               # any text moves the model, one alone too
            vocabulary, one = lm.fit(df.where(f"text = '{texts[k]}'"))
            assert np.abs(one - lm.Network.fresh(vocabulary.class_mass).flat).max() > 0.01


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("just words", "just words"), ("<p>a<p>b <unfinis", "a\nb"),
    ("<article><h1>T &amp; U</h1><p>One,\n two&nbsp;<b>three<p>f&ouml;ur<br>five</article>", "T & U\nOne, two three\nför five".replace("för", "föur")),
    ("<nav><a href=x>Menu, menu</a></nav><div class='ad'>Buy, now, this</div><article><p>Body text.</p>"
     "<div class=comments><p>I think, that, so</p></div><script>var t='</p>';</script></article><footer>f</footer>", "Body text."),
    ("<div id=main><p>First long enough, paragraph, here.</p><ul><li>x<li>y</ul><pre>a\n  b</pre></div>"
     "<div class=sidebar><p>side, side, side, side, side</p></div>", "First long enough, paragraph, here.\nx\ny\na b"),
    ("<body><article><p>a &lt; b &am</article>", "a < b &am"), ("<script>x</script><style>y</style>", ""),
])
def test_main_text(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize("page,text", [
    ("<div><div><p>LONG</p></div><ul><li>a</ul><div><p>short last part</p></div> closing <b>words</b></div>",
     "LONG\na\nshort last part\nclosing words"),
    ("<div><div><div><p>LONG</p></div></div></div><div><p>with <a href=x>one</a> link</p></div>", "LONG\nwith one link"),
    ("<div>first words <div><p>LONG</p></div><ul><li><a href=x>Home</a><li><a href=y>About us</a></ul></div>", "first words\nLONG"),
])
def test_main_text_keeps_the_rest_of_the_page(page, text):
    long = "long, " * 60 + "end"
    assert html.main_text(page.replace("LONG", long)) == text.replace("LONG", long)


def test_pages(spark, sf_dir):
    pages = queries.table(spark, sf_dir, "pages")
    out = {r.page_id: r for r in queries.op10(spark, sf_dir).collect()}
    assert len(out) == pages.count()
    for r in pages.collect():
        got = out[r.page_id]
        assert got.n_chars == len(got.text) and "<p>" not in got.text and got.url == r.url
    df = spark.createDataFrame([(None, None, None), (1, "u", "<p>x"), (1, "u", "<p>x")], "page_id long, url string, html string")
    assert sorted(((r.page_id, r.text) for r in html.extract_main_text(df).collect()), key=str) == [(1, "x"), (1, "x"), (None, "")]
    assert html.extract_main_text(df.limit(0)).collect() == []


def test_queries_match_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in queries.table(spark, sf_dir, "documents").collect()]
    items = [tuple(r) for r in queries.table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    expected = brute.jaccard(rows, 4, 85, 100)
    assert sorted(tuple(r) for r in queries.op1(spark, sf_dir).collect()) == expected
    hits = brute.hits(rows, items, 13)
    for r in queries.op7(spark, sf_dir).collect():
        words, hit, found = hits[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items) == (words, hit, len(found))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert r.contaminated == (hit > 0 and 20 * hit >= words)
    vectors = [(r.vec_id, r.embedding) for r in queries.table(spark, sf_dir, "embeddings").limit(200).collect()]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in pstable.embedding_dedup(df).collect()) == sorted(pstable_brute(sorted(vectors), 0.9))
    assert queries.op3(spark, sf_dir).count() == len(rows) == queries.op2(spark, sf_dir).count()

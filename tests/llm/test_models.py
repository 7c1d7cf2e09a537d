"""Learnt operators: held-out accuracy, and the edge cases of every one of them."""

import math
import zlib

import numpy as np
import pytest

from tidemark.llm import langid_ecoc as L, lm_masked as M, queries, toxicity_ftrl as X
from tidemark.llm.text_arrays import bounded_sample, word_hashes

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, score string, __o string"
ROWS = [(1, None, "en", "x", "y"), (2, "", "en", "x", "y"), (3, " \n\t ", None, "x", "y"), (4, "12 34 !!", "de", "x", None),
        (5, "the cat sat", "en", None, "y"), (5, "the cat sat", "en", None, "y"), (6, "der Hund und die Katze", "de", "x", "y"),
        (None, "the dog and the cat", "en", "x", "y"), (7, "the of and " * 100_000, "en", "x", "y")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_word_hashes_depend_on_the_word_only():
    texts = [b"The cat  sat.\n on", b"", b" ", b"cat", b"x" * 300_000 + b" cat", b"cat the " * 30_000, "été cat".encode()]
    h, bounds = word_hashes(texts, alnum_only=True)
    words = [t.lower().replace(b".", b" ").split() for t in texts]
    assert np.diff(bounds).tolist() == [len(w) for w in words]
    seen = {}
    for w, x in zip(sum(words, []), h.tolist()):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_bounded_sample_is_bounded_and_repeatable(spark):
    ids = spark.range(5000).withColumnRenamed("id", "k")
    a, b = (sorted(r.k for r in bounded_sample(x, ["k"], 700).collect()) for x in (ids, ids.repartition(7)))
    assert a == b and len(a) == 700
    assert bounded_sample(ids.limit(3), ["k"], 700).count() == 3


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.op5_toxicity_ftrl(spark, sf).collect()}
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [(toxic[i], r.score) for i, r in got.items() if r.held_out and i in toxic]
    good, bad = [s for t, s in held if t == 0], [s for t, s in held if t == 1]
    assert np.mean([b > g for b in bad for g in good]) > 0.95
    assert np.mean([g < 0.5 for g in good]) > 0.97


def test_toxicity_edge_cases(spark, odd, none):
    labels = spark.createDataFrame([(5, 1), (6, 0), (1, 0), (99, 1), (2, None)], "doc_id long, toxic int")
    model = X.train(odd, labels)
    scored = X.score(odd, model, out="score")
    assert sorted(scored.columns) == sorted(odd.columns) and scored.count() == len(ROWS)
    assert all(0 <= r.score <= 1 for r in scored.collect())
    empty = X.train(none, labels)
    assert len(empty.index) == 0 and X.score(none, empty).collect() == []
    assert {r.toxicity for r in X.score(odd, empty).collect()} == {0.5}


def test_ftrl_keeps_few_weights():
    rng = np.random.default_rng(2)
    rows = []
    for k in range(2000):
        index = np.unique(rng.integers(10, 5000, 40))
        y = int(k % 4 == 0)
        rows.append((np.append(index, 1) if y else index, y))
    model = X.fit(rows, bits=13)
    assert 1 in model.index and len(model.index) < 500
    assert model.value[list(model.index).index(1)] == model.value.max()


def plain_ftrl(rows, alpha, beta, l1, l2, epochs):
    """One coordinate after the other, in dicts."""
    z, n, bz, bn = {}, {}, 0.0, 0.0
    for _ in range(epochs):
        for index, label in rows:
            w = {}
            for i in index:
                s = z.get(i, 0.0)
                w[i] = 0.0 if abs(s) <= l1 else -(s - (l1 if s > 0 else -l1)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)
            bias = -bz / ((beta + math.sqrt(bn)) / alpha)
            g = 1 / (1 + math.exp(-(sum(w.values()) + bias))) - label
            for i in index:
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * w[i]
                n[i] = old + g * g
            bz += g - (math.sqrt(bn + g * g) - math.sqrt(bn)) / alpha * bias
            bn += g * g
    weights = {i: -(s - (l1 if s > 0 else -l1)) / ((beta + math.sqrt(n[i])) / alpha + l2) for i, s in z.items() if abs(s) > l1}
    return weights, -bz / ((beta + math.sqrt(bn)) / alpha)


def test_ftrl_equals_a_plain_loop():
    rng = np.random.default_rng(5)
    rows = [(np.unique(rng.integers(0, 60, 12)), int(rng.random() < 0.4)) for _ in range(150)]
    weights, bias = plain_ftrl([(i.tolist(), y) for i, y in rows], 0.5, 1.0, 0.7, 0.1, 3)
    model = X.fit(rows, 6, 0.5, 1.0, 0.7, 0.1, 3)
    assert model.index.tolist() == sorted(weights) and model.bias == pytest.approx(bias, abs=1e-9)
    assert np.allclose(model.value, [weights[i] for i in sorted(weights)], atol=1e-5)


def test_features_of_a_text_are_bounded_alike():
    key = np.concatenate([np.arange(40, 44), (1 << 20) + np.arange(5000), (2 << 20) + np.arange(5000), [(5 << 20) + 3]])
    kept = X.bounded_features(key, 20, most=100)
    assert (np.diff(kept) > 0).all() and np.bincount(kept >> 20).tolist() == [4, 100, 100, 0, 0, 1]
    assert (kept[4:104] - (1 << 20) == kept[104:204] - (2 << 20)).all()
    assert X.bounded_features(key[:0], 20).tolist() == [] and X.bounded_features(key, 20) is key


def test_one_id_in_a_third_of_the_rows(spark):
    """The sample is made of ids, so an id that repeats weighs as one."""
    lines = [(i, "you fool" if i % 2 else "good day", "en" if i % 2 else "de") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 1)] * 30, "doc_id long, toxic int")
    once = spark.createDataFrame(lines, "doc_id long, text string, lang string")
    hot = once.union(spark.createDataFrame([lines[1]] * 3000, once.schema)).repartition(7)
    a, b = X.train(once, labels), X.train(hot, labels)
    assert a.index.tolist() == b.index.tolist() and a.value.tolist() == b.value.tolist() and a.bias == b.bias
    c, d = L.train(once), L.train(hot)
    assert c.langs == d.langs and (c.weights == d.weights).all() and (c.bias == d.bias).all()


def test_many_stray_languages(spark):
    lines = [(i, f"word{i} abc{i}", f"x{i}") for i in range(300)]
    frame = spark.createDataFrame(lines, "doc_id long, text string, lang string")
    codes = L.train(frame, sample=100)
    assert len(codes.langs) == 100
    assert {r.language.lang for r in L.identify(frame, codes).collect()} <= set(codes.langs)


def explicit_decode(codes, margin):
    """Bit by bit: a bit costs log(1 + exp(-margin x bit)) times the bit's weight."""
    costs = [sum(t * math.log1p(math.exp(-m * w)) for m, w, t in zip(margin, word, codes.trust)) for word in codes.words]
    best = min(range(len(costs)), key=costs.__getitem__)
    return codes.langs[best], math.exp(-costs[best]) / sum(math.exp(-c) for c in costs)


def test_decoding_equals_explicit_bits(spark, monkeypatch):
    monkeypatch.setattr(L, "CELLS", 40)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    codes = L.train(docs)
    texts = [(r.text or "").encode() for r in docs.limit(60).collect()]
    langs, score, _ = L.decoded(codes, texts)
    for text, lang, s in zip(texts, langs, score):
        both, starts, ends = L.grams([text])
        margin = [sum(float(np.mean(codes.weights[g[starts[0]:ends[0]], b])) for g in both) + codes.bias[b] for b in range(len(codes.bias))]
        want = explicit_decode(codes, margin)
        assert lang == L.UNKNOWN or (lang == want[0] and s == pytest.approx(want[1], abs=1e-4))


def test_language_held_out(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op7_langid_ecoc(spark, SF).collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r.lang_pred == docs[r.doc_id].lang for r in got if r.held_out]
    assert np.mean(held) > 0.95


def test_language_edge_cases(odd, none):
    codes = L.train(odd)
    found = L.identify(odd, codes, out="score")
    assert sorted(found.columns) == sorted(odd.columns)
    by = {(r.doc_id, r.text): r.score for r in found.collect()}
    assert all(by[k].lang == L.UNKNOWN and by[k].score == 0 for k in [(1, None), (2, ""), (3, " \n\t "), (4, "12 34 !!")])
    assert by[6, "der Hund und die Katze"].lang == "de" and by[5, "the cat sat"].lang == "en"
    nothing = L.train(none)
    assert nothing.langs == () and L.identify(none, nothing).collect() == []
    assert {r.language.lang for r in L.identify(odd, nothing).collect()} == {L.UNKNOWN}
    one = L.train(odd.where("lang = 'en'"))
    assert {r.language.lang for r in L.identify(odd, one).collect()} == {"en", L.UNKNOWN}


@pytest.mark.parametrize("k", [2, 4, 6, 9])
def test_codewords_are_far_apart(k):
    words = L.codewords(k)
    gaps = [(words[i] != words[j]).sum() for i in range(k) for j in range(i)]
    assert min(gaps) >= (words.shape[1] + 1) // 4


def test_decoding_corrects_a_wrong_bit():
    words = L.codewords(4)
    for lang in range(4):
        for bit in range(words.shape[1]):
            margin = words[lang] * 2.0
            margin[bit] *= -1
            loss = np.logaddexp(0, -margin[None, :] * words).sum(axis=1)
            assert loss.argmin() == lang


def test_pseudo_likelihood(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    vocab, net = M.train(docs)
    got = {r.doc_id: r.pll for r in M.score(docs, vocab, net).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(got[i].words == len((t or "").encode().split()) for i, t in texts.items())
    rng = np.random.default_rng(1)
    some = [i for i, t in texts.items() if 100 < len(t.split()) < 2000][:200]
    mixed = spark.createDataFrame([(i, " ".join(rng.permutation(texts[i].split()))) for i in some], "doc_id long, text string")
    other = {r.doc_id: r.pll.mean for r in M.score(mixed, vocab, net).collect()}
    assert np.mean([got[i].mean > other[i] for i in some]) > 0.8  # words in their order are likelier
    edge = {(r.doc_id, r.text): r.pll for r in M.score(odd, vocab, net).collect()}
    assert edge[1, None].words == 0 and edge[1, None].log_prob == 0 and edge[1, None].mean is None
    assert edge[7, ROWS[-1][1]].words == 300_000
    v, n = M.train(none)
    assert len(v) == 0 and M.score(none, v, n).collect() == []
    M.train(odd)


def test_rare_words_are_told_apart(spark):
    frequent = " ".join(f"f{i}" for i in range(M.WORDS - M.BUCKETS))
    rows = [(1, f"{frequent} " * 3), (2, "rare rare f1 once"), (2, "rare rare f1 once"), (3, None), (4, "f1 unseen, rare")]
    docs = spark.createDataFrame(rows[:4], "doc_id long, text string")
    vocab = M.vocabulary(docs)
    vocab = vocab[~np.isin(vocab, M.word_hashes([b"rare once"])[0])]
    scored = M.score(spark.createDataFrame(rows, docs.schema), vocab, M.Network.fresh()).cache()
    counts = {}
    for text in [t for _, t in rows[:4] if t]:
        for w in text.split():
            h = M.word_hashes([w.encode()])[0]
            if h[0] not in vocab:
                counts.setdefault(int(M.word_numbers(h, vocab)[0]), []).append(w)

    def more(text):
        out = 0
        for w in (text or "").split():
            h = M.word_hashes([w.encode()])[0]
            if h[0] not in vocab:
                same = counts.get(int(M.word_numbers(h, vocab)[0]), [])
                out += np.log(max(same.count(w), 1) / (len(same) + 1))
        return out

    before = {(r.doc_id, r.text): r.pll for r in scored.collect()}
    got = M.spelled(scored, docs, vocab).collect()
    assert len(got) == len(rows) and got[0].__fields__ == scored.columns
    for r in got:
        assert abs(r.pll.log_prob - before[r.doc_id, r.text].log_prob - more(r.text)) < 1e-9
        assert r.pll.words == len((r.text or "").split()) and (r.pll.mean is None) == (r.text is None)


def test_log_probs_sum_to_one_and_match_plain_sums():
    net = M.Network.fresh()
    rng = np.random.default_rng(4)
    net.to_class[:] = rng.normal(0, 0.3, net.to_class.shape)
    net.to_word[:] = rng.normal(0, 0.3, net.to_word.shape)
    near = rng.integers(0, M.WORDS + 1, (4, 1))
    every = np.arange(M.WORDS)
    p = np.exp(M.log_probs(net, every, np.repeat(near, M.WORDS, axis=1)))
    assert abs(p.sum() - 1) < 1e-4
    h = np.append(np.tanh(sum(net.near[k][near[k, 0]] for k in range(4))), 1)
    w = 777
    a, b = h @ net.to_class, h @ net.to_word[w // M.PER_CLASS]
    want = a[w // M.PER_CLASS] - np.log(np.exp(a).sum()) + b[w % M.PER_CLASS] - np.log(np.exp(b).sum())
    assert abs(np.log(p[w]) - want) < 1e-4


def test_contexts_stay_within_texts():
    near = M.contexts(np.array([5, 6, 7, 8]), np.array([0, 1, 1, 4]))
    assert near[:, 0].tolist() == [M.WORDS] * 4
    assert near[:, 2].tolist() == [M.WORDS, 6, 8, M.WORDS]

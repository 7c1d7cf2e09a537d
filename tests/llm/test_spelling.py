import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tidemark.llm import spelling_vgram as V

SCHEMA = "doc_id long, text string, word string"


def plain_counts(rows):
    out = Counter()
    for doc, text in rows:
        run = ""
        for ch in (text or "") + " ":
            if ch.isascii() and ch.isalpha() or "À" <= ch <= "ÿ":
                run += ch.lower() if ch.isascii() else ch
            elif run:
                h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
                out[run if h % 97 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
                run = ""
    return out


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(counts):
    words, out = list(counts), {}
    by_len = {}
    for w in words:
        by_len.setdefault(len(w), []).append(w)
    for w in words:
        found = [x for k in (-1, 0, 1) for x in by_len.get(len(w) + k, ()) if near(w, x)]
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        out[w] = [best if best and counts[best] >= 2 * counts[w] else None, len(found)]
    rows = {}
    for w, (form, n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows[w] = (form, root, counts[w], n, counts[form] if form else None)
    return rows


def frame_of(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


def rows_of(frame):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


@pytest.mark.parametrize("grams, fewest, q_max", [(20_000, 16, 4), (200, 1, 5), (50, 1, 3)])
def test_variants_equal_brute_force(spark, grams, fewest, q_max):
    """Words with many neighbours, repeated letters and accents, under dictionaries of several sizes."""
    rng = np.random.default_rng(grams)
    base = ["".join(rng.choice(list("abcdé"), rng.integers(5, 12))) for _ in range(150)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ababab", "bababa"]
    counts = Counter({w: int(rng.integers(3, 400)) for w in base})
    for w in base:
        for _ in range(6):
            i, c = int(rng.integers(0, len(w))), str(rng.choice(list("abcdéx")))
            for v in (w[:i] + c + w[i + 1:], w[:i] + c + w[i:], w[:i] + w[i + 1:]):
                if len(v) >= 5:
                    counts[v] = int(rng.integers(3, 60))
    got = rows_of(V.variants(frame_of(spark, counts), grams=grams, fewest=fewest, q_max=q_max))
    assert got == plain_variants(counts)


@given(st.text("ab", min_size=1, max_size=12), st.integers(0, 2), st.data())
@settings(max_examples=300, deadline=None)
def test_an_edit_spoils_no_more_grams_than_the_bound_says(word, kind, data):
    grams = {g: 1 for g in data.draw(st.sets(st.text("ab\x02\x03", min_size=2, max_size=3), max_size=20))}
    i = data.draw(st.integers(0, len(word) - 1))
    other = [word[:i] + "c" + word[i + 1:], word[:i] + data.draw(st.sampled_from("abc")) + word[i:], word[:i] + word[i + 1:]][kind]
    a, b = (V.decompose(f"\x02{w}\x03", grams) for w in (word, other))
    shared = sum((Counter(g for _, g in a) & Counter(g for _, g in b)).values())
    assert shared >= len(a) - V.affected(a, len(word) + 2)
    if kind == 0:  # a replaced code point moves nothing
        assert len(set(a) & set(b)) >= len(a) - V.affected(a, len(word) + 2)


def test_word_counts_equal_a_plain_reader(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(None, "Null id words WORDS Éé ÀÉ×÷ß"), (5, None), (6, ""), (7, "x" * 300_000 + " y" * 100_000), (8, "a1b2c3 don't end-of"), (8, "twice twice")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    for shortest in (1, 5):
        got = {r.word: r.n for r in V.word_counts(frame, shortest=shortest).collect()}
        assert got == {w: n for w, n in plain_counts(rows).items() if len(w) >= shortest}
    assert V.word_counts(frame.limit(0)).collect() == []


def test_whole_query_equals_brute_force(spark):
    from tidemark.llm import queries
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    counts = {w: n for w, n in plain_counts(rows).items() if len(w) >= 5 and n >= 3}
    assert rows_of(queries.op11_spelling_vgram(spark, "/root/testdata/sf0.001")) == plain_variants(counts)


def test_chains_ties_and_no_words(spark):
    counts = {"aaaaab": 4, "aaaaaa": 8, "aaaaac": 8, "aaaacc": 16, "aaaccc": 31, "zzzzz": 3}
    got = rows_of(V.variants(frame_of(spark, counts)))
    assert got == plain_variants(counts) and got["aaaaab"][0] == "aaaaaa" and got["zzzzz"] == (None, "zzzzz", 3, 0, None)
    assert got["aaaaac"][:2] == ("aaaacc", "aaaacc")
    assert V.variants(frame_of(spark, counts).limit(0)).collect() == []

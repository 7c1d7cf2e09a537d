import numpy as np
import pytest

from tidemark.llm import minhash_fss as M

SCHEMA = "doc_id long, text string, n_shingles string"


def words_of(text):
    return [w.decode() for w in (text or "").encode().lower().split()]


def plain_components(texts, over=85, under=100):
    """All pairs that share a shingle, compared as sets of strings."""
    sets, holders, root = [], {}, list(range(len(texts)))
    for t in texts:
        w = words_of(t)
        sets.append({" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for j, s in enumerate(sets):
        shared = {}
        for g in s:
            for i in holders.setdefault(g, []):
                shared[i] = shared.get(i, 0) + 1
            holders[g].append(j)
        for i, n in shared.items():
            if under * n >= over * (len(s) + len(sets[i]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize("size", [1, 2, 7, 400, 5000])
def test_every_coordinate_fills_and_agrees_with_the_similarity(size):
    rng = np.random.default_rng(size)
    sketcher, share = M.Sketcher(), []
    for _ in range(20):
        pool = rng.integers(0, 2**63, 2 * size, dtype=np.uint64)
        cut = size // 3
        a, b = pool[:size], pool[cut:cut + size]
        x, y = sketcher.sketch(a), sketcher.sketch(b)
        assert (x != M._EMPTY).all() and (x == sketcher.sketch(rng.permutation(a))).all()
        share.append((x == y).mean() - (size - cut) / (size + cut))
    assert abs(np.mean(share)) < 0.02 and np.std(share) < 0.05
    with pytest.raises(ValueError):
        sketcher.sketch(np.empty(0, np.uint64))


def test_sketch_equals_a_plain_loop():
    sketcher = M.Sketcher(bins=16)
    for n in (1, 3, 40):
        items = np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64)
        bins = [None] * 16
        for r in range(32):
            for x in items:
                h = int(M.mixed((np.array([x]) ^ sketcher.flip[r]) * sketcher.odd[r])[0])
                b = (h >> 40) * 16 >> 24 if r < 16 else r - 16
                v = r << 40 | h & (1 << 40) - 1
                bins[b] = v if bins[b] is None else min(v, bins[b])
            if r >= 15 and None not in bins:
                break
        assert sketcher.sketch(items).tolist() == bins


def test_similar_texts_equal_brute_force(spark):
    """Groups with similarities around the bound: chains, a hot group without a member in the middle, short texts."""
    rng = np.random.default_rng(8)
    rows = [("", 1), (None, 2), ("one two", 3), ("ONE  two", 4), ("one two three", 5), ("a b c d e", 6), ("A b c d e", 7)]
    for group in range(25):
        words = [f"w{x}" for x in rng.integers(0, 3000, 150)]
        for _ in range(120 if group == 0 else rng.integers(1, 30)):
            copy = list(words)
            for at in rng.integers(0, 150, rng.integers(0, 6)):
                copy[at] = f"x{rng.integers(0, 3000)}"
            rows.append((" ".join(copy), len(rows) + 1))
        for _ in range(12):  # each a step from the one before
            words[int(rng.integers(0, 150))] = f"y{rng.integers(0, 3000)}"
            rows.append((" ".join(words), len(rows) + 1))
    docs = spark.createDataFrame(rows, "text string, doc_id long").repartition(8)
    root, n = plain_components([t for t, _ in rows])
    got = {r.doc_id: r for r in M.near_duplicates(docs).collect()}
    want = {i: (n[k], rows[root[k]][1]) for k, (_, i) in enumerate(rows)}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert len(set(root)) < len(rows) / 2


def test_nulls_long_texts_repeated_rows_and_clashing_columns(spark):
    long = " ".join(f"w{i % 97_007}" for i in range(150_000))
    rows = [(1, None, "x"), (2, " \t\n", "x"), (3, "A b", "x"), (4, "a\x0bB", "x"), (5, long, "x"), (6, long + " end", "x"), (6, long + " end", "x"),
            (None, "alone here now", "x"), (None, "a b", "x"), (7, "other text", "x"), (7, "A b", "x")]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in M.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
                 if r.component_id is not None)
    assert got == [(0, 1, 3, False), (1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False), (5, 97_007, 5, True),
                   (6, 97_008, 5, False), (6, 97_008, 5, False), (7, 1, 3, False), (7, 1, 7, True)]
    empty = M.near_duplicates(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_a_third_of_the_rows_in_one_group(spark):
    base = " ".join(f"b{i}" for i in range(200))
    rows = [(i, base + f" tail{i % 40}" if i % 3 == 0 else " ".join(f"r{i}x{j}" for j in range(30))) for i in range(1500)]
    got = {r.doc_id: r.component_id for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 if i % 3 == 0 else i for i in range(1500)}


def test_shared_keys_move_once(spark):
    nodes = spark.createDataFrame([(1, 5, [10, 11, 12]), (2, 6, [10, 21, 12]), (3, 7, [30, 31, 12]), (4, 8, [])], "node long, n long, keys array<long>")
    met = M.shared_keys(nodes)
    assert sorted(map(tuple, met.select("k", "node", "n", "size").collect())) == [(10, 1, 5, 2), (10, 2, 6, 2), (12, 1, 5, 3), (12, 2, 6, 3), (12, 3, 7, 3)]
    assert met._jdf.queryExecution().sparkPlan().toString().count("Join") == 0
    assert met._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1

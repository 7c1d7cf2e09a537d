import numpy as np
import pytest

from tests.llm.helpers import near_components, simhash
from tidemark.llm import simhash_bk as S

SCHEMA = "doc_id long, text string, fingerprint string"


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    fps = {i: simhash(t) for i, t in texts.items()}
    comps = near_components(list(fps), list(fps.values()), 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.near_groups(docs).collect()}
    assert got == {i: (f"{fps[i]:016x}", comps[i]) for i in texts}
    assert {r.doc_id for r in S.keep_one(docs).collect()} == set(comps.values())


def test_nulls_empty_long_repeated_and_clashing_columns(spark):
    long = " ".join(f"w{i % 977}" for i in range(200_000))
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", None), (4, "A b", "x"), (5, "a\x0bB", "x"), (6, long, "x"), (7, long, "x"),
            (7, long, "x"), (None, "alone here now", "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in S.near_groups(docs).collect() if r.doc_id}
    of = {i: (f"{simhash(t):016x}") for i, t, _ in rows}
    assert got == {(1, "0" * 16, 1), (2, "0" * 16, 1), (3, "0" * 16, 1), (4, of[4], 4), (5, of[5], 4), (6, of[6], 6), (7, of[6], 6)}
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 4, 6]


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert S.near_groups(docs).collect() == [] and S.keep_one(docs).collect() == []


@pytest.mark.parametrize("tree", [8, 2048])
def test_hot_shards_lose_no_link(spark, tree):
    rng = np.random.default_rng(3)
    center = rng.integers(0, 2**63, 4, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (4, 300, 3), dtype=np.uint64)
    values = np.unique(np.concatenate([(center[:, None] ^ flips[..., 0] ^ flips[..., 1]).ravel(),
                                       (center[:, None] ^ flips[..., 0] ^ flips[..., 1] ^ flips[..., 2]).ravel(),
                                       rng.integers(0, 2**63, 500, dtype=np.uint64)]))
    fps = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    from tidemark.llm.components import components
    got = {r.node: r.root for r in components(S.near_links(fps, 2, tree)).collect()}
    want = near_components(list(range(len(values))), [int(v) for v in values], 2)
    groups = {}
    for i, r in want.items():
        groups.setdefault(r, set()).add(int(values.view(np.int64)[i]))
    found = {}
    for n, r in got.items():
        found.setdefault(r, set()).add(n)
    assert sorted(map(sorted, found.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_tree_search_equals_all_pairs():
    rng = np.random.default_rng(1)
    v = np.unique(rng.integers(0, 1 << 12, 600, dtype=np.uint64))
    zero = np.zeros(len(v), np.int64)
    q, n = S.BKForest(v, zero).within(v, zero, 2)
    assert set(zip(q.tolist(), n.tolist())) == {(i, j) for i in range(len(v)) for j in range(len(v))
                                                if int(v[i] ^ v[j]).bit_count() <= 2}


def test_stage_keeps_what_brute_force_keeps(spark):
    import corpus_pipeline
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    fps = {r.doc_id: simhash(r.text) for r in docs.select("doc_id", "text").collect()}
    ids = sorted(fps)
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "/root/testdata/sf0.1").collect()}
    assert got == set(near_components(ids, [fps[i] for i in ids], 2).values())


def test_a_repeated_id_loses_no_group(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a, "x"), (1, b, "x"), (2, b, "x"), (None, a, "x"), (None, "alone here now", "x"), (1, a, "x")]
    kept = S.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, "alone here now"), (1, a), (1, b)]

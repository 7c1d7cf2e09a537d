import collections
import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat_parts as C, queries as Q, shard_propagation as P, topk_nra as N

SF = "/root/testdata/sf0.01"


def shards_of(spark, rows, shards=4, **options):
    df = spark.createDataFrame(rows, "id long, g1 long, g2 long, slot string")
    return P.balanced_shards(df, shards, **options).collect()


def check_even(rows, shards):
    held = collections.Counter(r.shard for r in rows)
    assert max(held.values(), default=0) - min((held.get(s, 0) for s in range(shards)), default=0) <= 1
    for s, n in held.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))


def test_documents_are_even_and_copies_stay_together(spark):
    rows = Q.op1_shard_propagation(spark, SF).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    check_even(rows, 16)
    assert all((r.size, r.text_crc32) == (len(texts[r.doc_id].encode()) + 1, zlib.crc32(texts[r.doc_id].encode())) for r in rows)
    groups = collections.defaultdict(set)
    for r in rows:
        groups[texts[r.doc_id]].add(r.shard)
    assert all(len(g) == 1 for g in groups.values())
    assert sorted(rows) == sorted(Q.op1_shard_propagation(spark, SF).collect())


def test_a_group_of_half_the_rows_takes_as_few_shards_as_it_needs(spark):
    rows = [(i, 1 if i < 3000 else 10 + i, 1, "x") for i in range(6000)]
    got = shards_of(spark, rows, 8)
    check_even(got, 8)
    hot = collections.Counter(r.shard for r in got if r.id < 3000)
    assert len(hot) <= 6  # 4 would hold it; a hash would use 8


@pytest.mark.parametrize("linked", [1.0, 0.96])
def test_a_table_of_copies_is_swapped_together(spark, linked):
    n = 16_000
    rows = [(i, i // 2 if i < linked * n else n + i, 1, "x") for i in range(n)]
    got = shards_of(spark, rows, 8)
    check_even(got, 8)
    where = {r.id: r.shard for r in got}
    pairs = [i for i in range(0, int(linked * n), 2)]
    assert sum(where[i] != where[i + 1] for i in pairs) < 0.1 * len(pairs)  # a hash splits 7 of 8


def test_closed_shards_get_swaps_only():
    assert P.quotas({(0, 1): 10, (1, 0): 4}, [50, 50], [100, 100], frozenset({1})) == {(0, 1): 0.4, (1, 0): 1.0}


def test_shard_edge_cases(spark):
    assert shards_of(spark, []) == []
    got = shards_of(spark, [(None, None, None, "x"), (1, None, None, "x"), (1, None, None, "x"), (2, 5, 6, None), (3, 5, 6, None)])
    check_even(got, 4)
    assert len(got) == 5


def test_one_id_in_a_third_of_the_rows_is_moved_in_parts(spark):
    rows = [(None, 1, 1, "x")] * 1500 + [(7, 2, 2, "x")] * 1500 + [(i, i // 2, 3, "x") for i in range(100, 1600)]
    got = shards_of(spark, rows, 8)
    check_even(got, 8)
    assert len(got) == len(rows) and "salt" not in got[0].__fields__
    frame = spark.createDataFrame(rows, "id long, g1 long, g2 long, slot string")
    atoms = P.chunked(frame, P.CHUNKS).groupBy("g1", "g2", "chunk").count()
    assert max(r["count"] for r in atoms.collect()) <= 12  # 1,500 rows in 1,024 chunks; without salts one atom
    # as with ids of their own
    apart = shards_of(spark, [(i, *r[1:]) for i, r in enumerate(rows)], 8)
    spread = [[len({r.shard for r in g if r.g1 == group}) for group in (1, 2)] for g in (got, apart)]
    assert sum(spread[0]) <= sum(spread[1]) + 2


def test_quotas_grant_swaps_then_room():
    got = P.quotas({(0, 1): 10, (1, 0): 4, (2, 1): 6}, [1000, 1200, 800], [1000, 1227, 1000])
    assert got[1, 0] == 1.0 and got[0, 1] == pytest.approx((4 + 6 * 2 / 12) / 10) and got[2, 1] == pytest.approx(1 / 6)


def nearest(vectors, k=10):
    whole = {i: np.floor(1024 * np.array(v, np.float64)).astype(np.int64) for i, v in vectors.items()}
    out = []
    for q in sorted(whole):
        if q % 100 == 0:
            order = sorted((-int(whole[q] @ whole[i]), i) for i in whole if i != q and len(whole[i]) == len(whole[q]))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(order)]
    return out


def test_top_k_equals_brute_force(spark):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    assert sorted(map(tuple, Q.op3_topk_nra(spark, SF).collect())) == nearest(vectors)


def test_block_search_equals_sorting_all():
    rng = np.random.default_rng(3)
    for spread in (1, 50, 100_000):
        data = rng.integers(-spread, spread + 1, (700, 6))
        data[100:300] = data[0]
        ids = rng.permutation(700)
        q, r, s = N.search_block(ids, data, ids[:40], data[:40], 7)
        for j in range(40):
            want = sorted((-int(data[j] @ data[i]), int(ids[i])) for i in range(700) if i != j)[:7]
            assert [(-int(x), int(ids[y])) for x, y in zip(s[q == j], r[q == j])] == want


def test_top_k_edge_cases(spark):
    kind = "vec_id long, embedding array<float>, score string"
    rows = [(0, [1.0, 2.0], "x"), (1, [1.0, 2.0], "x"), (2, [1.0, None], "x"), (3, None, "x"), (4, [float("nan"), 1.0], "x"), (5, [float("inf"), 1.0], "x"),
            (6, [1.0], "x"), (7, [1.0, 2.0], None), (7, [1.0, 2.0], None), (100, [-0.0004, 0.0], "x"), (None, [1.0, 1.0], "x")]
    df = spark.createDataFrame(rows, kind)
    got = sorted(map(tuple, N.top_k(df, df.where("vec_id % 100 = 0"), 3).collect()))
    assert [g for g in got if g[0] == 0] == [(0, 1, 1, 5 << 20), (0, 2, 7, 5 << 20), (0, 3, 7, 5 << 20)]
    assert [g for g in got if g[0] == 100] == [(100, 1, 0, -1024), (100, 2, 1, -1024), (100, 3, 7, -1024)]
    assert N.top_k(df.limit(0), df.limit(0)).collect() == []
    with pytest.raises(OverflowError):
        N.product(np.array([[1 << 40]]), np.array([[1 << 40]]))


def test_chats_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = sorted(map(tuple, con.execute(Q.ORACLES["op8_chat_parts"]).fetchall()))
    got = Q.op8_chat_parts(spark, SF)
    assert sorted(map(tuple, got.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars").collect())) == want


def test_chat_round_trip_and_parts(spark):
    nasty = ["<turn>", "</turn>\n", "a\\", "\\l\\s<", "", None, "x" * 300_000, "😀<text>é", "\\<"]
    rows = [(1, n, "assistant" if n % 2 else "us<er\\", t, "clash") for n, t in enumerate(nasty)] + [(2, 0, None, "same", "x"), (2, 0, None, "same", "x"), (None, None, "user", "q", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    read = {r.conv_id: r for r in C.read_chats(C.format_chats(df.withColumn("parts", C.text_part(F.col("text"))))).collect()}
    assert [(t.role, t.text) for t in read[1].turns] == [("assistant" if n % 2 else "us<er\\", t or "") for n, t in enumerate(nasty)]
    learnt = "".join(t or "" for n, t in enumerate(nasty) if n % 2)
    assert read[1].learnt == learnt
    assert "".join(read[1].formatted[s.start:s.start + s.length] for s in read[1].loss) == "".join(
        (t or "").replace("\\", "\\s").replace("<", "\\l") for n, t in enumerate(nasty) if n % 2)
    assert [(t.role, t.text) for t in read[2].turns] == [("", "same")] * 2 and read[None].turns[0].text == "q"
    digest = {r.conv_id: r for r in C.digests(C.format_chats(df.withColumn("parts", C.text_part(F.col("text"))))).collect()}
    assert digest[1].loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest() and digest[1].formatted_chars == len(read[1].formatted)
    assert C.format_chats(df.limit(0).withColumn("parts", C.text_part(F.col("text")))).collect() == []


def test_attachments_keep_their_order(spark):
    kind = f"conv_id long, turn long, role string, parts array<{C.PART}>"
    rows = [(1, 0, "user", [("text", "see <this>", None, None), ("image", None, "a.png", 4), ("Audio", None, "b.wav", 3), (None, "and", None, None)]),
            (1, 1, "assistant", [("text", "ok", None, None)]), (1, 2, "user", None), (1, 3, "user", [("document", "ignored", "c.pdf", None), ("video", None, None, 2)])]
    r = C.format_chats(spark.createDataFrame(rows, kind)).collect()[0]
    assert r.formatted == ("<turn>user<text>see \\lthis><image/><audio/>and</turn>\n<turn>assistant<text>ok</turn>\n<turn>user<text></turn>\n"
                           "<turn>user<text><document/><video/></turn>\n")
    assert [tuple(a) for a in r.attachments] == [("image", "a.png", 1024), ("audio", "b.wav", 75), ("document", "c.pdf", 512), ("video", None, 2)]
    assert r.attachment_tokens == 1024 + 75 + 512 + 2
    assert [r.formatted[s.start:s.start + s.length] for s in r.loss] == ["ok"]


@pytest.mark.parametrize("name", ["op1_shard_propagation", "op8_chat_parts"])
def test_native_operators_run_no_python(spark, name):
    plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))

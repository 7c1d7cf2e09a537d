import itertools

import numpy as np
import pytest
import sentencepiece

from tidemark.llm import sentencepiece_nbest as S
from tidemark.llm.queries import PIECE_MODEL

TEXTS = ["The thntion  erhaat.\n▁x", "", " ", "  a", "é😀\x00<s> <0x41>", "\n\n tail ", "▁▁", "ab" * 5000, "\t x", "Ciónmente asque"]


@pytest.fixture(scope="module")
def pieces():
    return S.load(PIECE_MODEL)


def every(unit, table):
    """All segmentations of a short unit, best first."""
    out = []
    for cuts in itertools.product([0, 1], repeat=len(unit) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(unit)]
        parts = [unit[a:b] for a, b in zip(at, at[1:])]
        total, ids = 0.0, []
        for p in parts:
            if p in table.ids:
                total, ids = total + table.ids[p][1], ids + [table.ids[p][0]]
            elif len(p) == 1:
                code = [table.byte_ids[b] for b in p.replace(S.LITERAL, S.BLANK).encode()]
                total, ids = total + table.byte_score * len(code), ids + code
            else:
                break
        else:
            out.append((total, tuple(ids)))
    return sorted(out, key=lambda x: -x[0])


@pytest.mark.parametrize("unit", ["▁the", "▁thntion", "▁▁▁x", "▁é😀b", "▁theorem."])
def test_unit_equals_brute_force(pieces, unit):
    want = every(unit, pieces)
    got = S.unit_nbest(unit, pieces, 7)
    assert [s for s, _ in got] == [s for s, _ in want[:7]]
    assert len({i for _, i in got}) == len(got) and all(i in {w for _, w in want} for _, i in got)


def test_whole_text_equals_brute_force(pieces):
    text = "the in to"
    per = [every(u, pieces) for u in S.text_units(text, pieces)]
    want = sorted((sum(c[0] for c in combo) for combo in itertools.product(*per)), reverse=True)[:6]
    got = S.nbest(text, pieces, 6)
    assert [s for s, _ in got] == want
    assert all(S.restored(ids, pieces).decode() == text for _, ids in got)


def test_many_units_at_once_equal_one_by_one(pieces, spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()] + TEXTS
    units = list(dict.fromkeys(u for t in texts for u in S.text_units(t, pieces)))
    ids, loss = S.Solver(pieces).solve(units)
    for u, i, gap in zip(units, ids, loss):
        two = S.unit_nbest(u, pieces, 2)
        assert two[0][1] == i and gap == (two[0][0] - two[1][0] if len(two) > 1 else np.inf)


def test_search_solves_every_unit_and_its_ties(monkeypatch):
    pieces = S.Pieces({p: (k, s) for k, (p, s) in enumerate([("a", -2.0), ("b", -1.0), ("aa", -4.0), ("ab", -3.0), ("ba", -3.0), ("aba", -6.0), ("bb", -1.0)])},
                      list(range(7, 263)), -20.0, [b""] * 263)
    units = ["".join(u) for k in range(1, 8) for u in itertools.product("ab", repeat=k)] + ["ab" * 32, "a" * 64, "b" * 65, "xa"]
    searched, search = [], S._two_best

    def seen(roots, *rest):
        searched.append(len(roots))
        return search(roots, *rest)

    monkeypatch.setattr(S, "_two_best", seen)
    ids, loss = S.Solver(pieces).solve(units)
    assert searched == [len(units) - 2]  # a long unit and one with a byte piece are searched one by one
    for u, i, gap in zip(units, ids, loss):
        two = S.unit_nbest(u, pieces, 2)
        assert two[0][1] == i and gap == (two[0][0] - two[1][0] if len(two) > 1 else np.inf)
    assert S.Solver(pieces).solve(["xx"])[0] == [tuple(2 * [pieces.byte_ids[ord("x")]])] and S.Solver(pieces).solve([]) == ([], [])


def test_table_round_trip_and_library(pieces, spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(50, None, "x"), (51, "the same", None), (51, "the same", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pieces string")
    coded = S.encode(docs, pieces, 4)
    got = coded.collect()
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    assert len(got) == len(rows)
    for r in got:
        assert r.pieces.exact and list(r.pieces.scores) == sorted(r.pieces.scores, reverse=True)
        want = S.nbest(r.text or "", pieces, 4)
        assert r.pieces.ids == want[0][1] and r.pieces.scores == [s for s, _ in want]
        if r.text and "\x00" not in r.text:
            assert model.decode(r.pieces.ids) == r.text
    back = S.decode(coded.selectExpr("doc_id", "text", "pieces.ids AS ids"), pieces, out="back").collect()
    assert all(r.back == (r.text or "") for r in back)
    assert S.encode(docs.limit(0), pieces).collect() == []


@pytest.mark.parametrize("n", [1, 2, 4, 9])
def test_n_best_of_every_unit(pieces, spark, n):
    ties = S.Pieces({p: (k, s) for k, (p, s) in enumerate([("a", -2.0), ("b", -1.0), ("aa", -4.0), ("ab", -3.0), ("ba", -3.0), ("aba", -6.0), ("bb", -1.0)])},
                    list(range(7, 263)), -20.0, [b""] * 263)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(10).collect()] + TEXTS
    tied = ["".join(u) for k in range(1, 8) for u in itertools.product("ab", repeat=k)] + ["ab" * 20, "b" * 64, "a" * 65, "xa"]
    for table, units in (ties, tied), (pieces, list(dict.fromkeys(u for t in texts for u in S.text_units(t, pieces)))):
        solver = S.Solver(table)
        found = solver.nbest(units, n)
        ends = np.cumsum(found.count)
        for k, u in enumerate(units):
            want = S.unit_nbest(u, table, n)
            assert found.scores[k].tolist() == [s for s, _ in want] + [-np.inf] * (n - len(want))
            assert tuple(found.ids[ends[k] - found.count[k]:ends[k]].tolist()) == want[0][1]
            ids = [i for _, i in found.listed[k]] if k in found.listed else [solver.ids_of(u, int(m)) for m in found.masks[k, :len(want)]]
            assert ids == [i for _, i in want]
    assert len(solver.nbest([], n).ids) == 0


def test_every_segmentation_is_given_and_decoded(pieces, spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None, "the in to the in to"])], "doc_id long, text string")
    for n in (1, 4, 6):
        for r in S.all_ids(S.encode(docs, pieces, n)).collect():
            want = S.nbest(r.text or "", pieces, n)
            assert r.all_ids == [ids for _, ids in want] and r.pieces.scores == [s for s, _ in want]
            assert r.pieces.exact and all(S.restored(ids, pieces).decode() == (r.text or "") for ids in r.all_ids)
    # a segmentation other than the best one that does not give the text is told
    broken = S.Pieces(pieces.ids, pieces.byte_ids, pieces.byte_score, list(pieces.raw))
    worst = set(S.nbest("the in to", pieces, 4)[3][1]) - set(S.nbest("the in to", pieces, 4)[0][1])
    for number in worst:
        broken.raw[number] = b"?"
    broken.__post_init__()
    one = docs.selectExpr("'the in to' AS text").limit(1)
    assert [S.encode(one, broken, n).first().pieces.exact for n in (1, 4)] == [True, False]


def test_query_gives_all_four(spark, sf):
    from tidemark.llm.queries import op4_sentencepiece_nbest

    found = op4_sentencepiece_nbest(spark, sf).collect()
    assert found and all(len(r.others) == len(r.scores) - 1 and r.exact for r in found)
    assert sum(len(r.others) for r in found) > 2 * len(found)

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.operators.compare import frames_equal
from tidemark.functions import calendar, events, numeric, text
from tidemark.operators import aggregate, clean, compare, distance, expand, facets, windows
from tidemark.plans import ordered


def one(spark, expr):
    return spark.range(1).select(expr).first()[0]


# text and numbers

@pytest.mark.parametrize("raw, want", [("24,990", "24"), ("abc", ""), ("37500", "37500"), (None, "")])
def test_first_digits(spark, raw, want):
    assert one(spark, text.first_digits(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("raw, want", [("1.00k", 1000.0), ("$780/w", 780.0), ("$1,190,000", 1190000.0), ("x", None)])
def test_prices(spark, raw, want):
    assert one(spark, text.thousands(F.lit(raw))) == want


def test_paths(spark):
    url = F.lit("/property/qld/north-lakes-4509/7-senior-cl-north-lakes-qld-4509-5424032")
    assert one(spark, text.slug_address(url)) == "7 senior cl north lakes qld 4509 5424032"
    assert one(spark, text.path_segment(F.lit("a/b"), 5)) is None
    assert one(spark, text.item_id(F.lit("2012 Toyota"), F.lit("https://x/details/2012-t/SSE-AD-1/"))) == "2012-SSE-AD-1"
    assert one(spark, text.archive_path("c:/test", F.lit(2026), F.lit(2), F.lit("t%23est%23.zip"))) == "c:/test/2026/02/t#est#.zip"
    assert one(spark, text.drop_last(F.lit(""))) == "" and one(spark, text.drop_last(F.lit("abc"))) == "ab"


def test_page_count(spark):
    assert one(spark, text.page_count(F.lit("25 of 48 results"))) == 2
    assert one(spark, text.page_count(F.lit("no hits"))) is None


@pytest.mark.parametrize("value, divisor, want", [(2, 4, 2), (-8, 4, 0), (9, 4, 1), (-7, 3, 2)])
def test_floor_mod(spark, value, divisor, want):
    assert one(spark, numeric.floor_mod(F.lit(value), divisor)) == want


@pytest.mark.parametrize("divisor", [0, -1])
def test_floor_mod_needs_a_positive_divisor(divisor):
    with pytest.raises(ValueError):
        numeric.floor_mod(F.lit(1), divisor)


def test_half_even(spark):
    assert [one(spark, numeric.half_even(F.lit(x))) for x in (0.5, 1.5, 2.5)] == [0.0, 2.0, 2.0]


def test_bins(spark):
    edges, labels = [0, 50000, 75000, 100000, 125000, 150000, float("inf")], ["050k", "075k", "100k", "125k", "150k", "maxk"]
    values = [(0.0,), (50000.0,), (50000.5,), (75000.0,), (150000.0,), (150001.0,), (-1.0,), (None,)]
    frame = clean.bin_values(spark.createDataFrame(values, "v DOUBLE"), "b", "v", edges, labels)
    assert [r[1] for r in frame.collect()] == ["050k", "050k", "075k", "075k", "150k", "maxk", None, None]


# price events

def test_decode_both_layouts(spark):
    got = one(spark, events.decode_price_change(F.lit("cnt:1-amt:-2000-evts:[2022-05-29:26000;2022-06-04:24000]")))
    assert (got["count"], got["amount"]) == (1, -2000)
    assert [tuple(e) for e in got["events"]] == [(dt.date(2022, 5, 29), 26000), (dt.date(2022, 6, 4), 24000)]
    got = one(spark, events.decode_price_change(F.lit("count:1;amount:1000;events:2022-06-10 38500,2022-06-10 39500")))
    assert (got["count"], got["amount"]) == (1, 1000)
    assert [tuple(e) for e in got["events"]] == [(dt.date(2022, 6, 10), 38500), (dt.date(2022, 6, 10), 39500)]
    empty = one(spark, events.decode_price_change(F.lit("cnt:1-amt:0-evts:[]")))
    assert (empty["count"], empty["amount"], empty["events"]) == (1, 0, [])
    assert one(spark, events.decode_price_change(F.lit("else"))) is None


@pytest.mark.parametrize("raw, want", [
    ("20025(18300.19500)-24000(20800.22100)", (20025, 24000, 18300, 20800, 19500, 22100)),
    ("30035(.)-31890(.)", (30035, 31890, None, None, None, None)),
    ("range:350400-39500;private:35300-38700;dealer:37050-40600", (350400, 39500, 35300, 38700, 37050, 40600)),
])
def test_decode_guide(spark, raw, want):
    assert tuple(one(spark, events.decode_price_guide(F.lit(raw)))) == want


# calendar and explode

@pytest.mark.parametrize("start, end, want", [
    ("2026-01-31", "2026-02-01", [(2026, 1)]), ("2026-01-01", "2026-02-01", [(2026, 1)]),
    ("2026-01-15", "2026-03-02", [(2026, 1), (2026, 2), (2026, 3)]), ("2026-03-01", "2026-01-10", []),
    ("2026-01-01", "2026-01-01", []), ("2025-12-31", "2026-01-02", [(2025, 12), (2026, 1)]),
])
def test_year_months(spark, start, end, want):
    frame = spark.createDataFrame([(start, end)], "a STRING, b STRING").select(F.to_date("a").alias("a"), F.to_date("b").alias("b"))
    assert rows(expand.year_months(frame, "a", "b").select("year", "month"), "year", "month") == want


def test_explode_range(spark):
    ts = dt.datetime
    frame = spark.createDataFrame(
        [(1, ts(2020, 1, 1), ts(2020, 1, 1, 1, 10)), (2, ts(2020, 1, 2), ts(2020, 1, 1)), (3, None, ts(2020, 1, 1))],
        "k INT, a TIMESTAMP, b TIMESTAMP")
    assert rows(expand.explode_range(frame, "a", "b").select("k", "ts"), "ts") == [
        (1, ts(2020, 1, 1, 0, 0)), (1, ts(2020, 1, 1, 0, 30)), (1, ts(2020, 1, 1, 1, 0))]


def test_explode_list(spark):
    frame = spark.createDataFrame([(1, [1, 2]), (2, []), (3, None)], "k INT, a ARRAY<INT>")
    assert rows(expand.explode_list(frame, "a"), "k", "a") == [(1, 1), (1, 2)]
    assert rows(expand.explode_list(frame, "a", keep_empty=True), "k", "a") == [(1, 1), (1, 2), (2, None), (3, None)]


def test_page_plan_of_no_results_is_empty(spark):
    counts = spark.createDataFrame([("a", 0), ("b", 26)], "s STRING, n BIGINT")
    assert rows(expand.page_url_plan(counts, "n", F.lit("u/")).select("s", "url"), "url") == [("b", "u/1"), ("b", "u/2")]


def test_parse_time(spark):
    assert one(spark, calendar.parse_time(F.lit("1/12/2010 8:26"), "d/M/yyyy H:mm")) == dt.datetime(2010, 12, 1, 8, 26)
    assert one(spark, calendar.parse_date(F.lit("01 Nov 2022"))) == dt.date(2022, 11, 1)
    assert one(spark, calendar.parse_date(F.lit("soon"))) is None


# cleaning

def test_cast_keeps_rows_with_bad_cells(spark):
    frame = spark.createDataFrame([("536365", "85123A", "1/12/2010 8:26")], "a STRING, b STRING, t STRING")
    typed = clean.cast_columns(frame, {"a": "int", "b": "int", "t": ("timestamp", "d/M/yyyy H:mm")})
    assert rows(typed) == [(536365, None, dt.datetime(2010, 12, 1, 8, 26))]


def test_case_when_compares_as_text(spark):
    frame = spark.createDataFrame([("536365", "1", "UK"), ("C536379", "2", "FR")], "no STRING, id STRING, c STRING")
    assert [r["cd"] for r in clean.case_when(frame, "cd", "no", [536365, 541909], F.col("id"), F.col("c")).collect()] == ["1", "FR"]


def test_pick_and_names(spark):
    frame = spark.createDataFrame([(1, 2)], "A INT, B INT")
    assert clean.pick(frame, ["B", "A"]).columns == ["B", "A"]
    with pytest.raises(ValueError):
        clean.pick(frame, ["Z"])
    with pytest.raises(ValueError):
        clean.lower_names(spark.createDataFrame([(1, 2)], "x INT, X INT"))


def test_conditions(spark):
    frame = spark.range(10).toDF("v")
    kept = clean.where_conditions(frame, [("v", ">=", 3), ("v", "not in", [4, 5]), ("v", "<", 8)])
    assert [r[0] for r in rows(kept, "v")] == [3, 6, 7]
    assert clean.where_conditions(frame, None) is frame
    with pytest.raises(ValueError):
        clean.where_conditions(frame, [("v", "~", 3)])


def test_fill_and_map(spark):
    frame = spark.createDataFrame([(None, None), (1, "1.00k")], "n INT, s STRING")
    assert set(rows(clean.fill_missing(frame, 0, "0"))) == {(0, "0"), (1, "1.00k")}
    assert set(rows(clean.fill_missing(frame))) == {(0, None), (1, "1.00k")}
    assert set(rows(clean.map_values(frame, {"s": {"1.00k": 1000}}))) == {(None, None), (1, "1000")}


@pytest.mark.parametrize("name, want", [("Corolla ZR Hybrid", (3, "hybrid")), ("Corolla SX Auto", (2, "fuel")), ("Corolla Ascent", (1, "fuel"))])
def test_grades(spark, name, want):
    frame = spark.createDataFrame([(name,)], "name STRING")
    graded = clean.keyword_grade(frame, "grade", "name", [("zr", 3), ("sx", 2)], 1)
    assert rows(clean.keyword_grade(graded, "drive", "name", [("hybrid", "hybrid")], "fuel").select("grade", "drive")) == [want]


def test_constant_columns(spark):
    frame = spark.createDataFrame([(1, 1, None, None), (1, 2, 5, None)], "same INT, moves INT, half INT, none INT")
    assert clean.drop_constant(frame).columns == ["moves", "half"]
    numbers = spark.createDataFrame([(1.0, 0.0), (2.0, 0.0), (3.0, 0.0)], "a DOUBLE, b DOUBLE")
    assert clean.drop_low_variance(numbers).columns == ["a"]
    assert clean.drop_low_variance(numbers, 0.9).columns == ["a"]
    assert clean.drop_low_variance(numbers, 0.9, sample=False).columns == []


# facets and aggregates

CITIES = [("US", "dc", "3m"), ("US", "el", "2m"), ("UK", "dc", "1m"), ("UK", "ee", "5m")]


def test_facets(spark):
    frame = spark.createDataFrame(CITIES, "country STRING, city STRING, population STRING")
    assert rows(facets.cascade_options(frame, "country", "UK", "city", ["dc"])) == [("dc", True), ("ee", False)]
    joined = aggregate.concat_distinct(frame, ["country", "city"], ["population"])
    assert rows(joined.filter("country = 'US' AND city = 'dc'")) == [("US", "dc", "3m")]
    assert rows(aggregate.concat_distinct(frame, ["country"], ["city", "population"]), "country") == [
        ("UK", "dc/ee", "1m/5m"), ("US", "dc/el", "2m/3m")]
    assert facets.facet_filter(frame, {"country": "US", "city": "", "population": None}).count() == 2
    assert rows(facets.facet_options(frame, ["country"]), "value") == [("country", "UK"), ("country", "US")]


def test_scoreboard(spark):
    frame = spark.createDataFrame([("a", True), ("a", False), ("a", None)], "e STRING, ok BOOLEAN")
    got = rows(aggregate.scoreboard(frame, "e", "ok"))[0]
    assert got[:4] == ("a", 3, 1, 2) and got[4] == pytest.approx(100 / 3)


# ordered rows

STOP = "TFTTFTFT"


@pytest.mark.parametrize("limit", [None, 0])
def test_early_stop(spark, limit):
    data = [("a", i, c == "T") for i, c in enumerate(STOP, 1)] + [("b", i, i > 4) for i in range(1, 11)][::-1]
    # four of ten wrong, the wrong ones late: never above 0.40 from the sixth on
    data += [("c", i, i not in (7, 8, 9, 10)) for i in range(1, 11)]
    frame = spark.createDataFrame(data, "e STRING, n INT, ok BOOLEAN").repartition(4)
    kept = windows.early_stop(frame, "e", ["n"], "ok", max_group_rows=limit)
    last = {r["e"]: r["m"] for r in kept.groupBy("e").agg(F.max("n").alias("m")).collect()}
    assert last == {"a": 7, "b": 6, "c": 10}


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_blocks_equal_windows(spark, partitions):
    # one key holds most rows, one is null, and sums meet nulls
    frame = spark.range(3000).select(
        F.when(F.col("id") % 3 < 2, F.lit("hot")).when(F.col("id") % 30 == 2, F.lit(None)).otherwise(
            (F.col("id") % 7).cast("string")).alias("k"),
        F.xxhash64("id").alias("o"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("v"))
    sums = {"s": F.col("v"), "n": F.lit(1)}
    plain = ordered.running_sums(frame, ["k"], ["o"], sums, True)
    blocked = ordered.running_sums(frame, ["k"], ["o"], sums, False, partitions).drop(ordered.BLOCK)
    assert compare.frames_equal(plain, blocked)


def test_block_plan_broadcasts_block_totals_only(spark):
    frame = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id").alias("o"))
    found = ordered.running_sums(frame, ["k"], ["o"], {"n": F.lit(1)}, False, 8)
    assert found.agg(F.max("n")).first()[0] == 500
    assert found.select(ordered.BLOCK).distinct().count() > 4


def test_head_tail_with_ties(spark):
    frame = spark.createDataFrame([(1, c) for c in "abcd"] + [(None, "z")], "k INT, v STRING")
    got = sorted((r["part"], r["position"], r["v"]) for r in windows.head_tail(frame, ["k"], 2).collect())
    assert got == [("head", 1, "z"), ("head", 2, "a"), ("tail", 1, "d"), ("tail", 2, "c")]
    same = spark.createDataFrame([(1,)] * 4, "k INT")
    assert sorted((r["part"], r["position"]) for r in windows.head_tail(same, ["k"], 1).collect()) == [("head", 1), ("tail", 1)]
    assert windows.head_tail(same, ["k"], 3).count() == 4


def test_nan_has_no_bin_and_months_need_free_names(spark):
    frame = spark.createDataFrame([(float("nan"),), (5.0,), (float("inf"),)], "v DOUBLE")
    got = [r["b"] for r in clean.bin_values(frame, "b", "v", [0, 10, float("inf")], ["low", "high"]).collect()]
    assert got == [None, "low", "high"]
    with pytest.raises(ValueError, match="year or month"):
        expand.year_months(spark.createDataFrame([("x",)], "year STRING"), "a", "b")


def test_head_tail(spark):
    got = rows(windows.head_tail(spark.range(5).toDF("v"), ["v"], 3), "v")
    assert got == [(0, "head", 1), (1, "head", 2), (2, "head", 3), (3, "tail", 2), (4, "tail", 1)]


def test_last_of(spark):
    frame = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("b", 1, 7)], "k STRING, o INT, v INT")
    assert rows(windows.last_of(frame, ["k"], ["o"], ["v"]), "k") == [("a", 6), ("b", 7)]


# comparison

def test_frames_equal(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "k INT, s STRING")
    assert compare.frames_equal(a, a.orderBy(F.desc("k")))
    assert not compare.frames_equal(a, a.distinct())
    assert not compare.frames_equal(a, a.withColumn("k", F.col("k").cast("bigint")))


def test_frame_diffs(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1)], "k INT, s STRING, n INT")
    b = spark.createDataFrame([(1, "x", 3), (3, "z", None)], "k INT, s STRING, n INT")
    assert rows(compare.frame_diffs(a, b, ["k"]), "k", "column") == [
        (1, "n", None, "3"), (2, "(row)", "present", None), (2, "n", "1", None), (2, "s", "y", None),
        (3, "(row)", None, "present"), (3, "s", None, "z")]


# distance

@pytest.fixture(scope="module")
def vectors():
    return np.random.RandomState(11).rand(100, 1000)


def brute(arr):
    return np.abs(arr[:, None, :] - arr[None, :, :]).sum(axis=2)


@pytest.mark.parametrize("block", [7, 40, 2048])
def test_distance_matrix(spark, vectors, block):
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id INT, v ARRAY<DOUBLE>")
    got = distance.pairwise_l1(frame, "id", "v", block_rows=block).collect()
    matrix = np.zeros((100, 100))
    for a, b, d in got:
        matrix[a, b] = d
    assert len(got) == 100 * 99
    np.testing.assert_allclose(matrix, brute(vectors), rtol=1e-12)


@pytest.mark.parametrize("block", [7, 2048])
def test_nearest_with_ties(spark, block):
    # a third of the rows are copies of one vector, so ties must break by id
    arr = np.random.RandomState(3).rand(90, 8).round(1)
    arr[::3] = arr[0]
    frame = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(arr)], "id INT, g INT, v ARRAY<DOUBLE>")
    got = {}
    for r in distance.pairwise_l1(frame, "id", "v", key="g", top=4, block_rows=block).orderBy("a", "rank").collect():
        got.setdefault(r["a"], []).append((r["b"], round(r["distance"], 9)))
    exact = brute(arr).round(9)
    for i in range(90):
        others = [j for j in range(90) if j != i and j % 2 == i % 2]
        want = sorted(others, key=lambda j: (exact[i, j], j))[:4]
        assert [d for _, d in got[i]] == [exact[i, j] for j in want]
    assert [b for b, _ in got[0]] == [6, 12, 18, 24]


def test_l1_expression(spark):
    assert one(spark, numeric.l1(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(0.5), F.lit(4.0)))) == 2.5


def test_running_sums_do_not_depend_on_the_plan(spark):
    from tidemark.plans import ordered

    frame = spark.range(20_000).select("id", (F.col("id") % 3).alias("k"), (F.rand(7) * 1000).alias("v"))
    frame = frame.withColumn("v", F.when(F.col("id") % 17 == 0, None).when(F.col("id") == 5, float("nan")).otherwise(F.col("v"))).cache()
    one = windows.running_total(frame, ["k"], ["id"], "v", max_group_rows=10**9)
    many = windows.running_total(frame, ["k"], ["id"], "v", max_group_rows=0)
    assert dict(one.dtypes)["running"] == dict(many.dtypes)["running"] == "double"
    assert frames_equal(one.select("id", "running"), many.select("id", "running"))
    assert ordered.ordered_blocks(frame, ["k"], ["id"]).select(ordered.BLOCK).distinct().count() > 1
    assert not ordered.fits_window(frame, []) and ordered.fits_window(frame, ["k"])
    assert frames_equal(windows.numbered(frame, [], ["id"]).select("id", "n"), frame.select("id", (F.col("id") + 1).alias("n")))

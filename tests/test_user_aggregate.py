"""User aggregates, table functions over pages and semi-joins with a filter."""

import math

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.operators import user_aggregate as U
from tidemark.operators.page_functions import register_page_functions
from tidemark.operators.semi_filter import bloom_candidates, bloom_semi_join


def test_partial_states_and_merge(spark):
    frame = spark.range(90_000, numPartitions=6).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 50).alias("k"), (F.col("id") % 7).alias("s0"), (F.pow(F.col("id") % 101, F.lit(2))).alias("x"))
    found = U.aggregate_by(frame, ["k"], texts=U.distinct_texts("s0"), skew=U.skewness("x"))
    want = frame.groupBy("k").agg(F.array_join(F.array_sort(F.collect_set(F.col("s0").cast("string"))), "/").alias("texts"), F.skewness("x").alias("skew"))
    pairs = list(zip(rows(found, "k"), rows(want, "k")))
    assert len(pairs) == 51 and all(a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-9) for a, b in pairs)
    # two thirds of all rows have one key; a task passes on a line per key
    assert U._states(frame, ["k"], [U.skewness("x")]).count() <= 6 * 51
    plan = found._jdf.queryExecution().toString()
    assert plan.count("MapInArrow") >= 2


def test_flush_and_long_runs(spark, monkeypatch):
    monkeypatch.setattr(U, "HELD", 5)
    frame = spark.range(3000, numPartitions=100).select((F.col("id") % 20).alias("k"), F.col("id").alias("v"))
    found = U.aggregate_by(frame, ["k"], n=U.UserAggregate(
        ["v"], "n BIGINT", "BIGINT", lambda b: {"n": b.num_rows}, lambda s: {"n": sum(x["n"] for x in s)}, lambda s: s["n"]))
    assert rows(found, "k") == [(k, 150) for k in range(20)]
    assert rows(U.aggregate_by(frame, [], t=U.distinct_texts("k"))) == [("/".join(sorted(map(str, range(20)))),)]


def test_odd_keys_and_values(spark):
    nan = float("nan")
    frame = spark.createDataFrame([(nan, "a", 1.0), (nan, "a", None), (0.0, None, 3.0), (-0.0, None, nan), (None, "a", 2.0), (None, "é", math.inf)],
                                  "k DOUBLE, v STRING, x DOUBLE").repartition(5)
    found = {str(r.k): (r.v, r.sk) for r in U.aggregate_by(frame, ["k"], v=U.distinct_texts("v"), sk=U.skewness("x")).collect()}
    assert found == {"nan": ("a", None), "0.0": ("", None), "None": ("a/é", None)}
    assert U.aggregate_by(frame.limit(0), ["k"], v=U.distinct_texts("v")).count() == 0
    assert U.aggregate_by(frame.limit(0), [], v=U.distinct_texts("v")).count() == 0
    with pytest.raises(ValueError):
        U.aggregate_by(frame, ["k"], k=U.distinct_texts("v"))


def test_table_functions(spark):
    register_page_functions(spark)
    pages = spark.createDataFrame([(1, "<p class='a b'>x<b>y</b></p><p>z"), (2, None), (3, "")], "id INT, html STRING")
    found = spark.sql("SELECT p.id, e.* FROM {p} p, LATERAL page_elements(p.html, 'p', NULL) e", p=pages)
    assert rows(found, "id", "n") == [(1, 0, "p", "xy", {"class": "a b"}), (1, 1, "p", "z", {})]
    worded = spark.sql("SELECT p.id, e.text FROM {p} p, LATERAL page_elements(p.html, NULL, 'a') e", p=pages)
    assert rows(worded, "id") == [(1, "xy")]


def test_filter_thins_before_the_shuffle(spark):
    many = spark.range(200_000, numPartitions=8).select(F.col("id").cast("int").alias("k"), F.col("id").alias("_word"), F.lit("x").alias("_bits"))
    listed = spark.range(5_000).select((F.col("id") * 37 + 5).alias("k"))
    listed = listed.union(listed)
    thinned = bloom_candidates(many, listed, ["k"])
    assert thinned.columns == many.columns
    inside = {k for k in range(5, 200_000, 37) if k < 5_000 * 37 + 5}
    kept = [r.k for r in thinned.select("k").collect()]
    assert inside <= set(kept) and len(kept) == len(set(kept)) and len(kept) < len(inside) + 0.02 * 200_000
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        exact = bloom_semi_join(many, listed, ["k"])
        assert sorted(r.k for r in exact.collect()) == sorted(inside)
        assert sorted(r.k for r in bloom_semi_join(many, listed, ["k"], words=3).collect()) == sorted(inside)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert bloom_candidates(many, listed, ["k"], words=3) is None


def test_filter_of_odd_keys(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, 1.0, "p"), (1, 1.0, "q"), (1, nan, "r"), (2, -0.0, "s"), (None, 1.0, "t"), (3, 3.0, "u")], "a INT, b DOUBLE, v STRING")
    listed = spark.createDataFrame([(1, 1.0), (1, 1.0), (1, nan), (2, 0.0), (None, 1.0)], "a BIGINT, b DOUBLE")
    assert rows(bloom_semi_join(df, listed, ["a", "b"]).select("v"), "v") == [("p",), ("q",), ("r",), ("s",)]
    assert bloom_semi_join(df, listed.limit(0), ["a", "b"]).count() == 0 == bloom_semi_join(df.limit(0), listed, ["a", "b"]).count()

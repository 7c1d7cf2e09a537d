"""Facet counts from bitmaps and comparison by digests, against plain versions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import hashed_diff
from tidemark.operators.compare import frame_diffs
from tidemark.operators.facet_index import facet_counts, facet_index
from tidemark.operators.hashed_diff import frame_diffs_hashed

COLUMNS = ["a", "b", "facet"]


def plain(rows, chosen, own):
    wanted = {c: v if isinstance(v, list) else [v] for c, v in chosen.items() if v not in (None, "", [])}
    out = {(c, r[i]): 0 for i, c in enumerate(COLUMNS) for r in rows}
    for r, (i, c) in itertools.product(rows, enumerate(COLUMNS)):
        if all(r[COLUMNS.index(w)] in v for w, v in wanted.items() if own or w != c):
            out[c, r[i]] += 1
    return out


@pytest.mark.parametrize("chosen", [{}, {"a": "x"}, {"a": ["x", "y"], "b": "1"}, {"a": "x", "b": "1", "facet": "p"}, {"a": "gone"}, {"a": None, "b": ""}])
@pytest.mark.parametrize("own", [False, True])
def test_counts_equal_a_rescan(spark, chosen, own):
    draw = random.Random(1)
    rows = [(draw.choice(["x", "x", "y", None]), str(draw.randrange(3)), draw.choice(["p", "q"])) for _ in range(400)]
    index = facet_index(spark.createDataFrame(rows, "a STRING, b STRING, facet STRING").repartition(5), COLUMNS)
    assert {(r.facet, r.value): r.rows for r in facet_counts(index, COLUMNS, chosen, own).collect()} == plain(rows, chosen, own)


def test_many_buckets_and_empty(spark):
    big = spark.range(0, 100_000, 1, 2).select((F.col("id") % 3).alias("a"), (F.col("id") % 2 == 0).alias("b"))
    index = facet_index(big, ["a", "b"])
    assert index.select("bucket").distinct().count() >= 4
    found = {(r.facet, r.value): r.rows for r in facet_counts(index, ["a", "b"], {"b": True}).collect()}
    assert found == {("a", "0"): 16667, ("a", "1"): 16666, ("a", "2"): 16667, ("b", "true"): 50000, ("b", "false"): 50000}
    assert facet_counts(facet_index(big.limit(0), ["a", "b"]), ["a", "b"], {"b": True}).count() == 0
    with pytest.raises(ValueError):
        facet_counts(index, ["a", "b"], {"c": 1})


def test_only_changed_parts_are_joined(spark):
    a = spark.range(60_000).select("id", (F.col("id") % 5).alias("k"), F.when(F.col("id") % 4 > 0, F.col("id") * 2.5).alias("v"), F.lit(None).cast("string").alias("s"))
    b = a.withColumn("v", F.when(F.col("id") == 77, None).otherwise(F.col("v"))).withColumn(
        "s", F.when(F.col("id") == 900, "new")).where("id <> 5000").union(spark.createDataFrame([(-1, 0, 1.0, "x")], a.schema))
    joined = []
    found = frame_diffs_hashed(a, b.repartition(7), ["id", "k"], joined)
    assert sorted(map(str, found.collect())) == sorted(map(str, frame_diffs(a, b, ["id", "k"]).collect())) and found.count() > 4
    assert joined[0] <= 20
    assert frame_diffs_hashed(a, a.repartition(3), ["id"]).count() == 0


def test_fine_digests_are_summed_in_tasks_of_bounded_rows(spark, monkeypatch):
    a = spark.range(20_000).select("id", (F.col("id") % 5).alias("k"))
    b = a.withColumn("k", F.when(F.col("id") % 4 == 0, 9).otherwise(F.col("k")))
    held = []
    monkeypatch.setattr(hashed_diff, "stored", lambda df: held.append(df) or df)
    monkeypatch.setattr(hashed_diff, "FINE_ROWS", 2_000, raising=False)
    assert frame_diffs_hashed(a, b, ["id"]).count() == 5_000
    # about 20 tasks for the 40,000 rows of both, in the stage that tells the parts
    assert 15 <= held[0].rdd.getNumPartitions() <= 20


def test_nulls_repeats_and_empty(spark):
    shape = "k INT, v STRING, w STRING"
    a = spark.createDataFrame([(None, "x", None), (1, None, "x"), (2, "y", "y")], shape)
    b = spark.createDataFrame([(None, None, "x"), (1, None, "x"), (2, "y", "y"), (2, "y", "y")], shape)
    assert sorted(map(str, frame_diffs_hashed(a, b, ["k"]).collect())) == sorted(map(str, frame_diffs(a, b, ["k"]).collect()))
    empty = a.limit(0)
    assert frame_diffs_hashed(empty, empty, ["k"]).count() == 0
    assert frame_diffs_hashed(a, empty, ["k"]).where("column = '(row)'").count() == 3
    with pytest.raises(ValueError):
        frame_diffs_hashed(a, b.withColumn("k", F.col("k").cast("long")), ["k"])

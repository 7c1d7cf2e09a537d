"""K-means sweeps that share their passes."""

import random

import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler

from tidemark.plans import sweep
from tidemark.plans.rfm import kmeans_sweep
from tidemark.plans.sweep import kmeans_sweep_shared
from tidemark.session import stored


def frame(spark, rows):
    return spark.createDataFrame(rows, "v ARRAY<DOUBLE>")


def test_costs_near_single_fits(spark):
    draw = random.Random(2)
    rows = [(5.0 * (i % 5) + draw.gauss(0, 1), draw.gauss(0, 1) + 3 * (i % 2)) for i in range(1500)]
    passes = []
    shared = {r.k: r for r in kmeans_sweep_shared(frame(spark, [(list(r),) for r in rows]), features="v", max_iter=60, passes=passes).collect()}
    assert sorted(shared) == list(range(2, 10))
    points = VectorAssembler(inputCols=["a", "b"], outputCol="v").transform(spark.createDataFrame(rows, "a DOUBLE, b DOUBLE")).cache()
    for k in (2, 5, 9):
        best = min(KMeans(featuresCol="v", k=k, seed=s).fit(points).summary.trainingCost for s in range(4))
        assert shared[k].cost <= 1.01 * best
    single = kmeans_sweep(points, [2], features="v").first()
    assert shared[2].silhouette == pytest.approx(single.silhouette, abs=0.01)
    one, eight = [], []
    small = frame(spark, [([float(i % 3), 0.0],) for i in range(90)])
    kmeans_sweep_shared(small, [3], features="v", passes=one)
    kmeans_sweep_shared(small, range(2, 10), features="v", passes=eight)
    assert eight[0] <= one[0] + 10 and passes[0] <= 75


def test_defined_cases(spark):
    assert kmeans_sweep_shared(frame(spark, []), features="v").count() == 0
    same = kmeans_sweep_shared(frame(spark, [([1.0, 2.0],)] * 30 + [(None,)]), [2, 3], features="v").collect()
    assert [tuple(r) for r in same] == [(2, 0.0, None), (3, 0.0, None)]
    two = kmeans_sweep_shared(frame(spark, [([0.0],)] * 20 + [([9.0],)] * 10), [1, 2, 4], features="v").collect()
    assert [r.k for r in two] == [1, 2, 4] and two[0].cost == pytest.approx(540.0) and two[0].silhouette is None
    assert two[1].cost == 0 and two[1].silhouette == 1.0 and two[2].silhouette == 1.0
    with pytest.raises(ValueError):
        kmeans_sweep_shared(frame(spark, []), [0], features="v")


def test_passes_read_blocks_on_all_cores(spark, monkeypatch):
    held = []
    monkeypatch.setattr(sweep, "stored", lambda df: held.append(stored(df)) or held[0])
    found = kmeans_sweep_shared(spark.range(0, 200_000, 1, 1).selectExpr("array(id % 3 * 10D, id % 3 + 0D) AS v"), [3], features="v").first()
    assert found.cost == 0 and found.silhouette == 1.0
    assert held[0].count() < 100 and held[0].rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    with pytest.raises(Exception, match="several lengths"):
        kmeans_sweep_shared(frame(spark, [([1.0],), ([1.0, 2.0, 3.0],)]).coalesce(1), [2], features="v")

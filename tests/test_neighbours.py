"""Mutual information from nearest neighbours against all pairs."""

import math
import random

import pandas as pd
import pytest

from pyspark.sql import functions as F

from tidemark.plans import neighbours


def psi(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def plain(pairs, k):
    n = len(pairs)
    points = []
    for axis in zip(*pairs):
        mean = sum(axis) / n
        sd = float(f"{math.sqrt(sum((v - mean) ** 2 for v in axis) / (n - 1)):.5e}") or 1.0
        points.append([math.floor(v / sd * neighbours.STEPS + 0.5) for v in axis])
    total = psi(n)
    for i in range(n):
        dx, dy = ([abs(p[i] - v) for v in p] for p in points)
        eps = sorted(max(a, b) for j, (a, b) in enumerate(zip(dx, dy)) if j != i)[k - 1]
        if eps:
            inner, nx, ny = k, sum(d < eps for d in dx), sum(d < eps for d in dy)
        else:
            inner, nx, ny = sum(not a and not b for a, b in zip(dx, dy)), dx.count(0), dy.count(0)
        total += (psi(inner) - psi(nx) - psi(ny)) / n
    return max(total, 0.0)


def scores(spark, rows, k=3, names=("a", "b", "t")):
    frame = spark.createDataFrame(rows, ", ".join(f"{n} DOUBLE" for n in names))
    return {r.feature: r.mutual_info for r in neighbours.neighbour_mutual_info(frame, list(names[:-1]), names[-1], k).collect()}


@pytest.mark.parametrize("strip", [20_000, 70])
def test_equals_all_pairs(spark, monkeypatch, strip):
    """One strip, and many small ones whose points visit each other."""
    monkeypatch.setattr(neighbours, "STRIP_ROWS", strip)
    monkeypatch.setattr(neighbours, "STRIP_ROOT", 1)
    draw = random.Random(4)
    rows = []
    for i in range(500):
        t = draw.gauss(0, 1)
        rows.append((t + draw.gauss(0, 0.3), float(draw.randrange(3)), t))
    rows += [(5.0, 1.0, 5.0)] * 250 + [(1e6, 0.0, -3.0)]  # a third of the rows is one point; one lies far off
    found = scores(spark, rows)
    for i, name in enumerate("ab"):
        assert found[name] == pytest.approx(plain([(r[i], r[2]) for r in rows], 3), abs=1e-9)
    assert found["a"] > found["b"]


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    clean = [(float(i % 7), 2.0, float(i)) for i in range(40)]
    dirty = clean + [(None, 2.0, 1.0), (nan, 2.0, 1.0), (1.0, inf, 1.0), (1.0, 2.0, None)]
    assert scores(spark, dirty) == scores(spark, clean)
    assert scores(spark, clean)["b"] == pytest.approx(0.0, abs=0.05)
    assert scores(spark, clean[:3]) == {"a": None, "b": None}
    assert scores(spark, []) == {"a": None, "b": None}
    equal = scores(spark, [(1.0, 1.0, 1.0)] * 50)
    assert equal["a"] == pytest.approx(0.0, abs=1e-9)


def test_points_that_ask_one_strip_come_in_parts(spark, monkeypatch):
    """An axis of two values is one block that every point asks."""
    monkeypatch.setattr(neighbours, "GUEST_ROWS", 300)
    guests = spark.range(2000).select(F.lit(0).alias("a"), F.lit(7).alias("strip"), F.col("id").alias("x"), F.col("id").alias("y"), F.col("id").alias("v"))
    hosts = spark.createDataFrame([(0, 7, 1, 5), (0, 7, 2, 6), (0, 8, 3, 1)], "a INT, strip INT, v LONG, w LONG")
    count = lambda one, two: pd.DataFrame({"g": [len(one)], "h": [len(two)]})
    met = neighbours._met(guests, hosts, "a").applyInPandas(count, "g LONG, h LONG").where("g > 0").collect()
    assert sum(r.g for r in met) == 2000 and max(r.g for r in met) < 600 and {r.h for r in met} == {2}

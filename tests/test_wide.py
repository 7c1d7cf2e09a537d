"""Correlations and inflation factors of many columns against NumPy."""

import numpy as np
import pytest

from tidemark.plans.wide import wide_corr, wide_vif


def test_three_hundred_columns(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(900, 300)) + 1e6
    x[:, 1] = x[:, 0] + draw.normal(size=900)
    x[:, 2] = 7.0
    frame = spark.createDataFrame([(r.tolist(),) for r in x], "v ARRAY<DOUBLE>").repartition(9)
    found = {(r.i, r.j): r.corr for r in wide_corr(frame, "v").collect()}
    with np.errstate(invalid="ignore", divide="ignore"):
        want = np.corrcoef(x.T)
    assert len(found) == 300 * 299 // 2
    for (i, j), value in found.items():
        assert (value is None) if 2 in (i, j) else value == pytest.approx(want[i, j], abs=1e-9)
    y = draw.normal(size=(900, 250))
    y[:, 1] = y[:, 0] + draw.normal(size=900)
    factors = {int(r.feature): r.vif for r in wide_vif(spark.createDataFrame([(r.tolist(),) for r in y], "v ARRAY<DOUBLE>"), "v").collect()}
    g = y.T @ y
    want = np.linalg.inv(g).diagonal() * g.diagonal()
    assert all(factors[i] == pytest.approx(want[i], rel=1e-9) for i in range(250))


def test_rows_left_out(spark):
    rows = [(1.0, 2.0), (2.0, 1.0), (3.0, 5.0)]
    dirty = rows + [(None, 1.0), (float("nan"), 1.0), (1.0, float("inf"))]
    clean, other = (spark.createDataFrame(r, "a DOUBLE, b DOUBLE") for r in (rows, dirty))
    assert wide_corr(other, ["a", "b"]).collect() == wide_corr(clean, ["a", "b"]).collect()
    assert [r.feature for r in wide_vif(other, ["a", "b"]).collect()] == ["a", "b"]
    assert wide_corr(clean.limit(0), ["a", "b"]).count() == 0 and wide_vif(clean.limit(0), ["a", "b"]).count() == 0

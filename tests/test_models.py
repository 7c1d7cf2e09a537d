import itertools

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.operators import rounding
from tidemark.plans import features, rfm as segments

# feature frame: x equals the target, y and z follow it, a hardly moves
FRAME = list(zip(
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10], [0, 1.1, 1.9, 3, 4, 5.1, 6, 7, 7.9, 9, 9.9],
    [0, 0.97, 2, 3, 4.1, 4.9, 6, 7.2, 8.1, 9.1, 10.1], [1, 1, 1, 1.1, 1, 1, 1, 0.9, 1, 1, 1.2]))
XYZA = ["x", "y", "z", "a"]


@pytest.fixture(scope="module")
def frame(spark):
    data = [(*map(float, r), float(r[0])) for r in FRAME]
    return spark.createDataFrame(data, "x DOUBLE, y DOUBLE, z DOUBLE, a DOUBLE, t DOUBLE").cache()


def scores(df):
    return {r[0]: r[1] for r in df.collect()}


def test_f_scores(frame):
    got = scores(features.f_scores(frame, XYZA, "t"))
    assert got["x"] == float("inf")
    assert [got[c] for c in "yza"] == pytest.approx([23338.8431, 21707.2982, 0.5548], rel=1e-4)
    assert [r[0] for r in features.f_scores(frame, XYZA, "t", top=2).collect()] == ["x", "y"]


def test_vif(frame):
    got = scores(features.vif(frame, XYZA))
    assert [got[c] for c in XYZA] == pytest.approx([27028.4274, 10233.7220, 9768.3031, 4.0486], rel=2e-5)


def test_lasso(frame):
    coef = scores(features.lasso(frame, XYZA, "t", 0.01))
    assert coef["y"] == 0 and coef["a"] == 0
    data = np.array([r for r in FRAME], dtype=float)
    w = np.array([coef[c] for c in XYZA])
    target = data[:, 0]
    residual = (target - target.mean()) - (data - data.mean(axis=0)) @ w
    assert (residual ** 2).sum() / (2 * len(data)) + 0.01 * np.abs(w).sum() == pytest.approx(0.00999, abs=2e-5)


def test_rfe(spark):
    # the target leans on p, less on q, hardly on r and s
    rng = np.random.RandomState(2)
    data = rng.rand(500, 4)
    target = data @ np.array([5, -3, 0.5, 0.1]) + rng.rand(500) / 10
    frame = spark.createDataFrame(np.column_stack([data, target]).tolist(), "p DOUBLE, q DOUBLE, r DOUBLE, s DOUBLE, t DOUBLE")
    got = {r["feature"]: (r["selected"], r["rank"]) for r in features.rfe(frame, ["p", "q", "r", "s"], "t", 2).collect()}
    assert got == {"p": (True, 1), "q": (True, 1), "r": (False, 2), "s": (False, 3)}


def test_rfe_keeps_the_exact_feature(frame):
    got = {r["feature"]: r["rank"] for r in features.rfe(frame, XYZA, "t", 2).collect()}
    assert got["x"] == 1 and sorted(got.values()) == [1, 1, 2, 3]


def test_rfe_svc(spark):
    frame = spark.range(200).select(
        (F.col("id") % 2).cast("double").alias("t"), ((F.col("id") % 2) * 4 + (F.col("id") % 3) / 3).alias("good"),
        ((F.col("id") % 5) / 10).alias("noise"))
    assert rows(features.rfe(frame, ["noise", "good"], "t", 1, model="svc").select("feature", "rank"), "feature") == [("good", 1), ("noise", 2)]


def test_binned_information_against_counts(spark):
    rng = np.random.RandomState(5)
    x = rng.rand(4000)
    data = np.column_stack([x, rng.rand(4000), x + rng.rand(4000) / 10])
    frame = spark.createDataFrame(data.tolist(), "x DOUBLE, noise DOUBLE, t DOUBLE")
    got = scores(features.binned_mutual_info(frame, ["x", "noise"], "t", bins=8))

    def binned(v):
        return np.minimum(np.floor((v - v.min()) / (v.max() - v.min()) * 8), 7).astype(int)

    for name, column in (("x", 0), ("noise", 1)):
        joint = np.zeros((8, 8))
        np.add.at(joint, (binned(data[:, column]), binned(data[:, 2])), 1)
        p = joint / joint.sum()
        outer = p.sum(1, keepdims=True) @ p.sum(0, keepdims=True)
        assert got[name] == pytest.approx((p[p > 0] * np.log(p[p > 0] / outer[p > 0])).sum(), rel=1e-9)
    labelled = frame.withColumn("t", F.when(F.col("t") > 0.5, "hi").otherwise("lo"))
    got = scores(features.binned_mutual_info(labelled, ["x", "noise"], "t", bins=8, discrete_target=True))
    assert got["x"] > 0.3 > 0.05 > got["noise"]


@pytest.fixture(scope="module")
def tree_frame(spark):
    return spark.range(1500).select(
        (F.xxhash64("id") % 1000 / 1000.0).alias("u"), (F.xxhash64(F.col("id") + 7) % 1000 / 1000.0).alias("v"),
    ).withColumn("t", F.col("u") * 10 + F.col("v")).withColumn("c", (F.col("u") > 0).cast("double")).cache()


@pytest.mark.parametrize("task, target", [("regression", "t"), ("classification", "c")])
def test_tree_importance(tree_frame, task, target):
    got = features.tree_importance(tree_frame, ["v", "u"], target, task, rounds=3).collect()
    assert got[0]["feature"] == "u" and sum(r["importance"] for r in got) == pytest.approx(1)


def test_tasks_of_a_forest_fit_are_bounded_by_rows(tree_frame, monkeypatch):
    seen = []

    class Seen(features.RandomForestRegressor):
        def fit(self, df):
            seen.append(df.rdd.getNumPartitions())
            return super().fit(df)

    monkeypatch.setattr(features, "RandomForestRegressor", Seen)
    monkeypatch.setattr(features, "FIT_ROWS", 100, raising=False)
    features.permutation_importance(tree_frame, ["v", "u"], "t", repeats=1, trees=2, depth=2)
    assert seen == [15]


def test_tasks_of_a_boosted_fit_are_bounded_by_rows(tree_frame, monkeypatch):
    seen = []

    class Seen(features.GBTRegressor):
        def fit(self, df):
            seen.append(df.rdd.getNumPartitions())
            return super().fit(df)

    monkeypatch.setattr(features, "GBTRegressor", Seen)
    monkeypatch.setattr(features, "FIT_ROWS", 100, raising=False)
    features.tree_importance(tree_frame, ["v", "u"], "t", rounds=1)
    assert seen == [15]


def test_permutation_importance(tree_frame, monkeypatch):
    monkeypatch.setattr(features, "GROUP_ROWS", 400)
    got = features.permutation_importance(tree_frame, ["v", "u"], "t", repeats=2, trees=10).collect()
    assert [r["feature"] for r in got] == ["u", "v"]
    assert got[0]["perm_score"] > 1 and abs(got[1]["perm_score"]) < 0.2
    again = features.permutation_importance(tree_frame, ["v", "u"], "t", repeats=2, trees=10).collect()
    assert [r["perm_score"] for r in again] == pytest.approx([r["perm_score"] for r in got])


@pytest.mark.parametrize("task, target", [("regression", "t"), ("classification", "c")])
def test_permutations_are_scored_by_cell(tree_frame, monkeypatch, task, target):
    frame = tree_frame.withColumn("c", (F.col("t") > 4).cast("double"))
    kind = features.RandomForestRegressor if task == "regression" else features.RandomForestClassifier
    scored = []

    class Seen(kind):
        def fit(self, df):
            model = super().fit(df)
            transform = model.transform
            model.transform = lambda rows: (scored.append(rows.count()), transform(rows))[1]
            return model

    monkeypatch.setattr(features, kind.__name__, Seen)
    found = []
    for most in (1 << 17, 0):
        monkeypatch.setattr(features, "CELLS", most, raising=False)
        scored.append(0)
        got = features.permutation_importance(frame, ["v", "u"], target, repeats=2, trees=3, depth=3, task=task).collect()
        found.append({r.feature: (r.perm_score, r.perm_score_std) for r in got})
    # cells of the base and of four shuffled copies, not their rows
    assert max(scored[:3]) < 1500 and max(scored[3:]) == 6000
    for f in ("v", "u"):
        assert found[0][f] == pytest.approx(found[1][f], rel=1e-9, abs=1e-12)


# segments

BUYS = [("A", "2020-01-01 00:00:10", 1, 5), ("A", "2020-01-01 00:00:20", 2, 5), ("B", "2020-01-01 00:00:10", 1, 7),
        ("B", "2020-01-01 00:00:05", 9, 9), ("A", "2020-01-01 00:00:20", 1, 1)]


def buys(spark):
    return spark.createDataFrame(BUYS, "c STRING, ts STRING, q INT, p INT").withColumn("ts", F.col("ts").cast("timestamp"))


def test_rfm_as_written_compares_with_every_customer(spark):
    got = rows(segments.rfm(buys(spark), "c", "ts", "q", "p", "2020-01-01 00:00:00"), "customer", "recency")
    # A keeps its row at 10 s because that is B's largest recency
    assert got == [("A", 10, 3, 16), ("A", 20, 3, 16), ("B", 10, 1, 7)]


def test_rfm_per_customer(spark):
    got = rows(segments.rfm(buys(spark), "c", "ts", "q", "p", "2020-01-01 00:00:00", per_customer=True), "customer")
    assert got == [("A", 20, 2, 11), ("B", 10, 1, 7)]


@pytest.fixture(scope="module")
def blobs(spark):
    return spark.range(300).select(
        "id", ((F.col("id") % 3) * 10 + F.rand(1)).alias("p"), ((F.col("id") % 3) * -5 + F.rand(2)).alias("q")).cache()


def test_standardize(spark, blobs):
    got = segments.standardize(blobs, ["p", "q"])
    assert got.columns == ["id", "p", "q", "standardized"]
    dev = blobs.agg(F.stddev_samp("p")).first()[0]
    row = got.select("p", vector_to_array("standardized")[0].alias("s")).first()
    assert row["s"] == pytest.approx(row["p"] / dev)


def test_kmeans(spark, blobs):
    scaled = segments.standardize(blobs, ["p", "q"])
    sweep = segments.kmeans_sweep(scaled, [2, 3, 4], seed=3).collect()
    assert [r["k"] for r in sweep] == [2, 3, 4]
    assert sweep[0]["cost"] > sweep[1]["cost"] and max(sweep, key=lambda r: r["silhouette"])["k"] == 3
    found = segments.kmeans_predict(scaled, 3, seed=3)
    pairs = found.select((F.col("id") % 3).alias("blob"), "prediction").distinct()
    assert pairs.count() == 3
    profile = segments.cluster_profile(found, ["p", "q"])
    assert profile.columns == ["prediction", "typ", "val"] and profile.count() == 6


# rounding of one column

def brute_1col(values, tol=1e-4):
    frac = np.array(values) - np.floor(values)
    cum = np.cumsum(frac)
    need = int(np.ceil(frac.sum() - tol))
    best = None
    for x in itertools.product((0, 1), repeat=len(values)):
        run = np.cumsum(x)
        if sum(x) != need or any(v and f <= tol for v, f in zip(x, frac)):
            continue
        if np.any(run < np.floor(cum - tol)) or np.any(run > np.ceil(cum + tol)):
            continue
        cost = sum(int(np.rint((1 - 2 * f) * 10000)) for v, f in zip(x, frac) if v)
        if best is None or (cost, x) < best:
            best = (cost, x)
    return best


def vector_frame(spark, groups):
    data = [(g, i, float(v)) for g, vs in groups.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(data, "g STRING, i INT, v DOUBLE")


CASES = {
    "fixture": [325.7612, 329.2385, 333.0003, 333.0003], "whole": [1.0, 2.0, 3.0], "half": [0.5] * 10,
    "near": [0.99995, 1.00005, 0.5, 0.5], "one": [7.25],
    **{f"r{k}": np.random.RandomState(k).rand(9).round(4).tolist() for k in range(6)},
}


@pytest.mark.parametrize("limit, partitions", [(None, None), (0, 1), (0, 4), (0, 13), (5, 3)])
def test_round_1col_is_optimal(spark, limit, partitions):
    solved = rounding.controlled_round_1col(
        vector_frame(spark, CASES), ["g"], ["i"], "v", max_group_rows=limit, partitions=partitions)
    got = {}
    for r in solved.orderBy("g", "i").collect():
        got.setdefault(r["g"], []).append(r["x"])
        assert r["rounded"] == np.floor(r["v"]) + r["x"]
    for name, values in CASES.items():
        assert tuple(got[name]) == brute_1col(values)[1], name
    assert 10 * brute_1col(CASES["fixture"])[0] == 47700 and sum(got["fixture"]) == 2


def test_round_1col_long_group_by_blocks(spark):
    values = np.random.RandomState(9).rand(3000).round(4)
    frame = vector_frame(spark, {"a": values})
    plain = rows(rounding.controlled_round_1col(frame, ["g"], ["i"], "v").select("i", "x"), "i")
    blocks = rows(rounding.controlled_round_1col(
        frame, ["g"], ["i"], "v", max_group_rows=0, partitions=16).select("i", "x"), "i")
    assert plain == blocks


def test_round_1col_with_a_null_group(spark):
    frame = vector_frame(spark, CASES).withColumn("g", F.when(F.col("g") != "r0", F.col("g")))
    for limit in (None, 4, 0):
        solved = rounding.controlled_round_1col(frame, ["g"], ["i"], "v", max_group_rows=limit)
        assert solved.count() == frame.count()
        got = [r["x"] for r in solved.filter("g IS NULL").orderBy("i").collect()]
        assert tuple(got) == brute_1col(CASES["r0"])[1]


def test_feasible_start(spark):
    got = rounding.feasible_round_1col(vector_frame(spark, CASES), ["g"], ["i"], "v")
    audit = rounding.rounding_audit(got.withColumn("c", F.lit(0)), ["g"], "i", "c", "v", "x")
    assert audit.filter("NOT bands_met").count() == 0


# rounding of matrices

M22 = [[1.2, 0.7], [0.9, 1.4]]
M42 = [[20397.9652, 15452.0905], [14731.5307, 11159.8797], [14853.5355, 11249.0033], [9025.5454, 6833.4149]]
M52 = [[0.0, 17448.5591], [0.0, 17636.9015], [3452.0535, 914.5394], [13715.8174, 0.0], [18026.1838, 0.0]]
M43 = [[147.2486757, 4328.452971, 10025.0847], [101.4170847, 3154.271113, 7086.26907],
       [104.7075579, 3181.182483, 7021.399741], [62.5189908, 2043.078313, 4343.941698]]


def matrix_frame(spark, **matrices):
    data = [(n, i, j, float(v)) for n, m in matrices.items() for i, r in enumerate(m) for j, v in enumerate(r)]
    return spark.createDataFrame(data, "g STRING, i INT, j INT, v DOUBLE")


def grids(df):
    out, cost = {}, {}
    for r in df.orderBy("g", "i", "j").collect():
        out.setdefault(r["g"], {}).setdefault(r["i"], []).append(r["x"])
        cost[r["g"]] = r["objective"]
    return {g: list(m.values()) for g, m in out.items()}, cost


def test_round_matrices(spark):
    frame = matrix_frame(spark, a=M22, b=M42, c=M52, d=M43)
    solved = rounding.controlled_round(frame, ["g"], "i", "j", "v")
    found, cost = grids(solved)
    assert found["a"] == [[0, 1], [1, 1]]
    assert found["b"] == [[1, 0], [0, 1], [1, 0], [1, 0]]
    assert found["c"] == [[0, 0], [0, 1], [0, 1], [1, 0], [1, 0]]
    assert found["d"] == [[0, 1, 0], [1, 0, 0], [0, 0, 1], [1, 0, 1]] and cost["d"] == 53130510
    audit = {r["g"]: r for r in rounding.rounding_audit(solved, ["g"], "i", "j", "v", "x").collect()}
    for g in "abcd":
        assert audit[g]["total_met"] and audit[g]["bands_met"] and audit[g]["objective"] == cost[g]


def test_round_with_element_term(spark):
    solved = rounding.controlled_round(matrix_frame(spark, d=M43), ["g"], "i", "j", "v", elem_penalty=True)
    found, cost = grids(solved)
    assert found["d"] == [[0, 1, 0], [0, 0, 1], [1, 0, 0], [1, 0, 1]] and cost["d"] == 52753950
    stale = solved.withColumn("x", F.when(F.col("i") == 1, (F.col("j") == 0).cast("int")).when(
        F.col("i") == 2, (F.col("j") == 2).cast("int")).otherwise(F.col("x")))
    audit = rounding.rounding_audit(stale, ["g"], "i", "j", "v", "x", elem_penalty=True).first()
    assert audit["objective"] == 52785900


def test_column_step_ignores_small_deviations(spark):
    plain = rounding.controlled_round(matrix_frame(spark, d=M43), ["g"], "i", "j", "v", col_step_penalty=True)
    audit = rounding.rounding_audit(plain, ["g"], "i", "j", "v", "x", col_step_penalty=True).first()
    assert audit["col_dev"] == 0 and audit["objective"] == plain.first()["objective"]


@pytest.mark.parametrize("steps", [False, True])
@pytest.mark.parametrize("elements", [False, True])
def test_small_matrices_equal_brute_force(steps, elements):
    rng = np.random.default_rng(5)
    for shape in [(1, 1), (1, 5), (5, 1), (2, 3), (3, 3), (4, 2), (2, 5)]:
        for _ in range(6):
            values = np.where(rng.random(shape) < 0.2, rng.integers(0, 3, shape), rng.random(shape) * 3).round(4)
            frac = values - np.floor(values)
            n, m = shape
            options = [np.array(bits).reshape(shape) for bits in itertools.product((0, 1), repeat=n * m)]
            costs = [(c, x.ravel().tolist()) for x in options
                     if (c := rounding._objective(x, frac, rounding.TOL, 1e4, 1e3, 10, steps, elements)) is not None]
            if not costs:
                with pytest.raises(ValueError):
                    rounding._solve_matrix(values, rounding.TOL, 1e4, 1e3, 10, steps, elements)
                continue
            x, cost = rounding._solve_matrix(values, rounding.TOL, 1e4, 1e3, 10, steps, elements)
            assert (cost, x.ravel().tolist()) == min(costs)


def test_large_matrices(spark):
    rng = np.random.default_rng(6)
    grids_ = {f"g{n}": rng.random(shape).round(4).tolist() for n, shape in enumerate([(12, 6), (1, 40), (20, 20), (40, 1)])}
    solved = rounding.controlled_round(matrix_frame(spark, **grids_), ["g"], "i", "j", "v").cache()
    audit = {r["g"]: r for r in rounding.rounding_audit(solved, ["g"], "i", "j", "v", "x").collect()}
    cost = {r["g"]: r["objective"] for r in solved.collect()}
    assert all(audit[g]["total_met"] and audit[g]["bands_met"] and audit[g]["objective"] == cost[g] for g in grids_)


def test_two_rows_for_one_cell_fail(spark):
    frame = matrix_frame(spark, a=[[0.5, 0.5]])
    with pytest.raises(Exception, match="two rows for one cell"):
        rounding.controlled_round(frame.union(frame), ["g"], "i", "j", "v").collect()


def test_infeasible_group_fails(spark):
    # the sum asks for a one that no cell may take
    with pytest.raises(Exception, match="no rounding meets"):
        rounding.controlled_round(matrix_frame(spark, a=[[0.00005, 0.00005]]), ["g"], "i", "j", "v").collect()


@pytest.mark.parametrize("limit", [None, 0])
def test_audit_by_blocks(spark, limit):
    frame = matrix_frame(spark, a=np.random.RandomState(1).rand(60, 3).round(4).tolist()).withColumn("x", (F.col("v") > 0.5).cast("int"))
    got = rounding.rounding_audit(frame, ["g"], "i", "j", "v", "x", max_group_rows=limit).first()
    v = np.random.RandomState(1).rand(60, 3).round(4)
    x = (v > 0.5).astype(int)
    off = lambda a, b: np.abs(a * 10000 - np.rint(b * 10000)).sum()
    assert got["row_dev"] == off(x.sum(1), v.sum(1)) and got["col_dev"] == off(x.sum(0), v.sum(0))
    assert got["elem_dev"] == off(x.cumsum(0), v.cumsum(0))

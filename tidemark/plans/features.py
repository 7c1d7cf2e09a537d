"""Scores for choosing features. Every statistic of the data is a Spark aggregate;
only matrices as large as the number of features reach the driver."""

from __future__ import annotations

import re
from functools import reduce
from operator import add

import numpy as np
from pyspark.ml.classification import GBTClassifier, LinearSVC, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import uniform
from tidemark.session import spread_rows, stored

GROUP_ROWS = 100_000
#: Rows a task of a tree fit keeps; some 250 bytes each for a few features.
FIT_ROWS = 500_000
#: Cells between the thresholds of a forest up to which rows are added up by cell before they are scored.
CELLS = 1 << 17


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _doubles(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) for c in columns])


def f_scores(df: DataFrame, features: list[str], target: str, top: int | None = None) -> DataFrame:
    """F = r^2 / (1 - r^2) * (n - 2) per feature, largest first; infinite for a perfect one.

    One pass: the sums behind every correlation come from a single aggregate.
    """
    data = _doubles(df, [*features, target]).dropna()
    stats = data.agg(F.count(F.lit(1)).alias("_n"), *[F.corr(f, target).alias(f) for f in features])
    squared = {f: F.least(F.col(f) * F.col(f), F.lit(1.0)) for f in features}
    # a correlation of one is only reached up to rounding
    lines = F.array(*[
        F.struct(
            F.lit(f).alias("feature"),
            F.when(1 - squared[f] < 1e-14, F.lit(float("inf")))
            .otherwise(squared[f] / (1 - squared[f]) * (F.col("_n") - 2)).alias("f_score"),
        ) for f in features
    ])
    ordered = stats.select(F.inline(lines)).orderBy(F.desc_nulls_last("f_score"), "feature")
    return ordered if top is None else ordered.limit(top)


def gram(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Sums of products of every pair of columns, from one aggregate over the rows."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    sums = df.agg(*[F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"g{k}") for k, (i, j) in enumerate(pairs)])
    matrix = np.zeros((len(columns), len(columns)))
    for (i, j), value in zip(pairs, sums.first()):
        matrix[i, j] = matrix[j, i] = value or 0.0
    return matrix


def vif(df: DataFrame, features: list[str]) -> DataFrame:
    """Variance inflation factor of each feature from regressions without intercept."""
    g = gram(_doubles(df, features).dropna(), features)
    scale = 1 / np.sqrt(np.diag(g))
    scaled = g * np.outer(scale, scale)
    factors = np.diag(np.linalg.inv(scaled)) * np.diag(scaled)
    return _rows(df.sparkSession, [(f, float(v)) for f, v in zip(features, factors)], "feature STRING, vif DOUBLE")


def equal_width_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin number 0..bins-1 over [low, high]; all 0 when the range is empty."""
    share = (value - low) / (high - low)
    return F.when(high > low, F.least(F.floor(share * bins), F.lit(bins - 1))).otherwise(0).cast("int")


def binned_mutual_info(
    df: DataFrame, features: list[str], target: str, bins: int = 10, discrete_target: bool = False
) -> DataFrame:
    """Mutual information, in nats, of each feature and the target over equal-width bins.

    A different estimator from the nearest-neighbour one. Rows shrink to at most bins x bins
    counts per feature before anything is shuffled; no global ranking is needed.
    """
    named = _doubles(df, features if discrete_target else [*features, target])
    if discrete_target:
        named = df.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(target).alias("_t"))
    else:
        named = named.withColumnRenamed(target, "_t")
    data = named.dropna()
    ranged = features if discrete_target else [*features, "_t"]
    limits = data.agg(*[x for c in ranged for x in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]).first()

    def binned(c: str) -> Column:
        if limits[f"lo_{c}"] is None:
            return F.lit(0)
        return equal_width_bin(F.col(c), F.lit(limits[f"lo_{c}"]), F.lit(limits[f"hi_{c}"]), bins)

    target_bin = F.col("_t").cast("string") if discrete_target else binned("_t").cast("string")
    cells = data.select(
        target_bin.alias("y"),
        F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), binned(f).alias("x")) for f in features])),
    )
    joint = cells.groupBy("feature", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    by_x, by_y = Window.partitionBy("feature", "x"), Window.partitionBy("feature", "y")
    shares = joint.withColumns({
        "nx": F.sum("n").over(by_x), "ny": F.sum("n").over(by_y), "all": F.sum("n").over(Window.partitionBy("feature")),
    })
    part = F.col("n") / F.col("all") * F.log(F.col("n") * F.col("all") / (F.col("nx") * F.col("ny")))
    return shares.groupBy("feature").agg(F.sum(part).alias("mutual_info")).orderBy(F.desc("mutual_info"), "feature")


def rfe(
    df: DataFrame, features: list[str], target: str, n: int, model: str = "linear", max_iter: int = 20
) -> DataFrame:
    """Fit, drop the feature with the smallest |coefficient|, repeat until ``n`` remain.

    Returns (feature, selected, rank), rank 1 for the selected. 'linear' is least squares: the
    matrix of products is summed once and every step solves a part of it. 'svc' fits a linear
    support vector classifier on Spark per step, for a 0/1 target.
    """
    if model not in ("linear", "svc"):
        raise ValueError("model is 'linear' or 'svc'")
    data = _doubles(df, [*features, target]).dropna()
    left, dropped = list(features), []
    if model == "linear":
        means = np.array(data.agg(*[F.avg(c) for c in [*features, target]]).first(), dtype=float)
        centred = data.select(*[(F.col(c) - float(m)).alias(c) for c, m in zip([*features, target], means)])
        g = gram(centred, [*features, target])
        where = {f: i for i, f in enumerate(features)}
    else:
        data = data.persist()
    try:
        while len(left) > n:
            if model == "linear":
                at = [where[f] for f in left]
                weights = np.linalg.lstsq(g[np.ix_(at, at)], g[at, -1], rcond=None)[0]
            else:
                vectors = VectorAssembler(inputCols=left, outputCol="_x").transform(data)
                fitted = LinearSVC(featuresCol="_x", labelCol=target, maxIter=max_iter, tol=1e-3).fit(vectors)
                weights = fitted.coefficients.toArray()
            dropped.append(left.pop(int(np.argmin(np.abs(weights)))))
    finally:
        if model == "svc":
            data.unpersist()
    ranks = {f: 1 for f in left} | {f: i + 2 for i, f in enumerate(reversed(dropped))}
    return _rows(df.sparkSession, [(f, ranks[f] == 1, ranks[f]) for f in features],
                 "feature STRING, selected BOOLEAN, rank INT")


def _vectors(df: DataFrame, features: list[str], target: str) -> DataFrame:
    data = _doubles(df, [*features, target]).dropna()
    return VectorAssembler(inputCols=features, outputCol="_x").transform(data)


def tree_importance(
    df: DataFrame, features: list[str], target: str, task: str = "regression", rounds: int = 20, seed: int = 13
) -> DataFrame:
    """Importance of each feature in boosted trees, largest first. A task of the fit has at most ``FIT_ROWS`` rows, about."""
    booster = GBTRegressor if task == "regression" else GBTClassifier
    rows = spread_rows(_doubles(df, [*features, target]), FIT_ROWS)
    model = booster(featuresCol="_x", labelCol=target, maxIter=rounds, seed=seed).fit(_vectors(rows, features, target))
    lines = sorted(zip(features, model.featureImportances.toArray().tolist()), key=lambda p: (-p[1], p[0]))
    return _rows(df.sparkSession, lines, "feature STRING, importance DOUBLE")


def _intervals(model, features: list[str]) -> dict[str, list[float]]:
    """Per feature the upper ends of the intervals between the thresholds of all trees; every tree treats the values of one alike."""
    cuts = {f: set() for f in features}
    for i, cut in re.findall(r"If \(feature (\d+) <= (\S+)\)", model.toDebugString):
        cuts[features[int(i)]].add(float(cut))
    return {f: [*sorted(c), float("inf")] for f, c in cuts.items()}


class _Cells:
    """Cells of the intervals of several features, numbered by one digit per feature."""

    def __init__(self, ends: dict[str, list[float]]):
        self.ends, self.steps, self.count = ends, {}, 1
        for f, held in ends.items():
            self.steps[f] = self.count
            self.count *= len(held)

    def number(self) -> Column:
        """The cell of a row, from its features."""
        def place(f: str, first: int, last: int) -> Column:
            if first == last:
                return F.lit(first * self.steps[f]).cast("long")
            half = (first + last) // 2
            return F.when(F.col(f) <= self.ends[f][half], place(f, first, half)).otherwise(place(f, half + 1, last))

        return reduce(add, [place(f, 0, len(held) - 1) for f, held in self.ends.items()])

    def digit(self, cell: str, f: str) -> Column:
        return F.expr(f"({cell} div {self.steps[f]}L) % {len(self.ends[f])}L")

    def values(self, cell: str) -> dict[str, Column]:
        """Per feature a value of the cell."""
        return {f: F.element_at(F.array(*map(F.lit, held)), (self.digit(cell, f) + 1).cast("int")) for f, held in self.ends.items()}


def permutation_importance(
    df: DataFrame, features: list[str], target: str, repeats: int = 10, seed: int = 13,
    trees: int = 100, task: str = "regression", depth: int = 5,
) -> DataFrame:
    """Loss of score when one feature is shuffled: mean and deviation over ``repeats``, sorted.

    The forest is fitted once. To shuffle, rows fall into random groups of bounded size and pass
    their values on to the next row of a random order, the last to the first, so each value is used
    once and no task ranks the whole frame. The groups go by a stored row number, so copies of a row
    spread evenly and a retry draws the same groups. The score is R^2, or accuracy for classes.

    A forest sees only between which of its thresholds a value lies. Where these intervals form at most ``CELLS`` cells, rows are
    added up by cell and the forest scores cells; else it scores every row.
    """
    spread = spread_rows(_doubles(df, [*features, target]), FIT_ROWS)
    rows = stored(spread.dropna().withColumn("_row", F.monotonically_increasing_id()))
    vectors = VectorAssembler(inputCols=features, outputCol="_x").transform(rows)
    forest = RandomForestRegressor if task == "regression" else RandomForestClassifier
    model = forest(featuresCol="_x", labelCol=target, numTrees=trees, maxDepth=depth, seed=seed).fit(vectors)
    size, mean = rows.agg(F.count(F.lit(1)), F.avg(target)).first()
    groups = max(1, -(-size // GROUP_ROWS))
    cells = _Cells(_intervals(model, features))
    few = cells.count <= CELLS
    # what passes from row to row: a cell, or all features
    value = cells.number() if few else F.struct(*features)
    drawn = rows.select(F.col(target).alias("_t"), value.alias("_own"), "_row")

    def shuffled(repeat: int) -> DataFrame:
        placed = drawn.withColumns({
            "_g": F.floor(uniform(F.col("_row"), F.lit(seed), F.lit(repeat), F.lit("g")) * groups),
            "_o": uniform(F.col("_row"), F.lit(seed), F.lit(repeat), F.lit("o")),
        })
        ring = Window.partitionBy("_g").orderBy("_o")
        first = F.first("_own").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        moved = placed.withColumn("_next", F.coalesce(F.lead("_own").over(ring), first))
        # one copy of a row per feature, with that feature taken from the next row
        copies = F.array(*[
            F.col("_own") + (cells.digit("_next", f) - cells.digit("_own", f)) * cells.steps[f] if few
            else F.struct(*[F.col(f"{'_next' if c == f else '_own'}.{c}").alias(c) for c in features]) for f in features
        ])
        return moved.select("_t", F.posexplode(copies).alias("_f", "_own")).withColumn("_repeat", F.lit(repeat))

    def scored(copies: DataFrame) -> DataFrame:
        """The score by number of the feature and repeat."""
        # a target from its mean keeps the squares small; a class is told by its value
        lines = copies.withColumn("_t", F.col("_t") - F.lit(float(mean))) if task == "regression" else copies
        sums = {"_n": F.lit(1.0), "_s": F.col("_t"), "_q": F.col("_t") * F.col("_t")}
        if few:
            keys = ["_f", "_repeat", "_own", *([] if task == "regression" else ["_t"])]
            lines = lines.groupBy(*keys).agg(*[F.sum(v).alias(c) for c, v in sums.items()]).withColumns(cells.values("_own"))
        else:
            lines = lines.select("*", "_own.*").withColumns(sums)
        found = model.transform(VectorAssembler(inputCols=features, outputCol="_x").transform(lines))
        if task != "regression":
            score = F.sum(F.when(F.col("prediction") == F.col("_t"), F.col("_n")).otherwise(0.0)) / F.sum("_n")
        else:
            guess = F.col("prediction") - F.lit(float(mean))
            score = 1 - F.sum(F.col("_q") - 2 * guess * F.col("_s") + guess * guess * F.col("_n")) / F.sum("_q")
        return found.groupBy("_f", "_repeat").agg(score.alias("score"))

    base = scored(drawn.withColumns({"_f": F.lit(0), "_repeat": F.lit(0)})).first()["score"]
    union = shuffled(0)
    for r in range(1, repeats):
        union = union.unionByName(shuffled(r))
    named = F.element_at(F.array(*map(F.lit, features)), F.col("_f") + 1)
    drops = scored(union).groupBy(named.alias("feature")).agg(
        F.avg(F.lit(float(base)) - F.col("score")).alias("perm_score"),
        F.stddev_pop(F.lit(float(base)) - F.col("score")).alias("perm_score_std"),
    )
    lines = [tuple(r) for r in drops.orderBy(F.desc("perm_score"), "feature").collect()]
    return _rows(df.sparkSession, lines, "feature STRING, perm_score DOUBLE, perm_score_std DOUBLE")


def lasso(df: DataFrame, features: list[str], target: str, alpha: float = 0.01) -> DataFrame:
    """Coefficients of a least-squares fit with an L1 penalty; zero marks an unimportant feature."""
    fit = LinearRegression(featuresCol="_x", labelCol=target, elasticNetParam=1.0, regParam=alpha,
                           standardization=False, maxIter=1000, tol=1e-10).fit(_vectors(df, features, target))
    lines = [(f, float(c)) for f, c in zip(features, fit.coefficients)]
    return _rows(df.sparkSession, lines, "feature STRING, coefficient DOUBLE")

"""Segments, feature scores, distances and controlled rounding."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import ORACLES, query, table
from tidemark.catalog.relational import PER_CUSTOMER, _rfm
from tidemark.operators import distance, rounding
from tidemark.plans import features, neighbours, rfm as segments, sweep, wide
from tidemark.session import spread, stored

RFM_COLUMNS = ["recency", "frequency", "monetary_value"]
FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
TARGET = "l_extendedprice"


def _scaled(spark, sf):
    # one line per customer, read by the fit and again by the scaling
    return segments.standardize(stored(_rfm(spark, sf, True)), RFM_COLUMNS)


@query(PER_CUSTOMER + "SELECT customer, " + ", ".join(
    f"round({c} / stddev_samp({c}) OVER (), 6) AS {c}_scaled" for c in RFM_COLUMNS) + " FROM r")
def rfm_standardized(spark, sf):
    parts = segments.scaled_columns(_scaled(spark, sf), RFM_COLUMNS)
    return parts.select("customer", *[F.round(f"{c}_scaled", 6).alias(f"{c}_scaled") for c in RFM_COLUMNS])


# four far-apart groups of orders: the cluster of an order follows from its customer
PLANTED_SQL = """
WITH p AS (SELECT o_orderkey, o_custkey % 4 AS g, CAST((o_custkey % 4) * 1000 + o_orderkey % 7 AS DOUBLE) AS x,
                  CAST((o_custkey % 4) * (o_custkey % 4) * 700 + o_orderkey % 11 AS DOUBLE) AS y FROM orders),
s AS (SELECT *, x / stddev_samp(x) OVER () AS sx, y / stddev_samp(y) OVER () AS sy FROM p)
"""


def _planted(spark, sf):
    group = F.col("o_custkey") % 4
    points = table(spark, sf, "orders").select(
        "o_orderkey", (group * 1000 + F.col("o_orderkey") % 7).alias("x"), (group * group * 700 + F.col("o_orderkey") % 11).alias("y"))
    return segments.standardize(stored(points), ["x", "y"])


@query(PLANTED_SQL + "SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY g) AS first_of_cluster FROM s")
def kmeans_planted(spark, sf):
    """The clusters of four planted groups, each named by its smallest order."""
    found = segments.kmeans_predict(_planted(spark, sf), k=4)
    firsts = found.groupBy("prediction").agg(F.min("o_orderkey").alias("first_of_cluster"))
    return found.join(F.broadcast(firsts), "prediction").select("o_orderkey", "first_of_cluster")  # a line per cluster


@query(PLANTED_SQL + """
, c AS (SELECT g AS h, CAST(count(*) AS DOUBLE) AS n, sum(sx) AS tx, sum(sy) AS ty, sum(sx * sx + sy * sy) AS q FROM s GROUP BY g),
d AS (SELECT o_orderkey, g, h, n, sx * sx + sy * sy + q / n - 2 * (sx * tx + sy * ty) / n AS far FROM s, c),
b AS (SELECT o_orderkey, max(far * n / (n - 1)) FILTER (g = h) AS own, min(far) FILTER (g <> h) AS other FROM d GROUP BY o_orderkey)
SELECT CAST(4 AS INTEGER) AS k, round((SELECT sum(q - (tx * tx + ty * ty) / n) FROM c), 4) AS cost,
       round(avg((other - own) / greatest(other, own)), 6) AS silhouette FROM b
""")
def kmeans_planted_score(spark, sf):
    """Training cost and silhouette of the planted groups."""
    found = segments.kmeans_sweep(_planted(spark, sf), [4])
    return found.select("k", F.round("cost", 4).alias("cost"), F.round("silhouette", 6).alias("silhouette"))


@query()
def rfm_clusters(spark, sf):
    found = segments.kmeans_predict(_scaled(spark, sf), k=5)
    return found.select("customer", *RFM_COLUMNS, "prediction")


@query()
def kmeans_sweep(spark, sf):
    return segments.kmeans_sweep(_scaled(spark, sf), range(2, 10))


# nine groups of orders at distances that triple: with k clusters the nearest ones, 0 to 9 - k, are one cluster
SWEEP_SQL = """
WITH p AS (SELECT o_orderkey AS id, o_custkey % 9 AS g, pow(3, o_custkey % 9) + (o_orderkey % 7) / 100.0 AS x, (o_orderkey % 11) / 100.0 AS y FROM orders),
a AS (SELECT k, id, greatest(g - (9 - k), 0) AS c, x, y FROM p, (SELECT unnest(range(2, 10)) AS k)),
m AS (SELECT k, c, count(*) AS n, avg(x) AS mx, avg(y) AS my FROM a GROUP BY k, c),
s AS (SELECT k, c, any_value(n) AS n, any_value(mx) AS mx, any_value(my) AS my, sum((x - mx) * (x - mx) + (y - my) * (y - my)) AS ss
      FROM a JOIN m USING (k, c) GROUP BY k, c),
d AS (SELECT a.k, id, a.c, s.c AS h, n, (x - mx) * (x - mx) + (y - my) * (y - my) + ss / n AS far FROM a JOIN s ON a.k = s.k),
b AS (SELECT k, id, max(far * n / (n - 1)) FILTER (c = h) AS own, min(far) FILTER (c <> h) AS other FROM d GROUP BY k, id),
v AS (SELECT k, avg((other - own) / greatest(other, own)) AS silhouette FROM b GROUP BY k)
SELECT CAST(k AS INTEGER) AS k, round(ln(sum(ss)), 6) AS log_cost, round(any_value(silhouette), 6) AS silhouette FROM s JOIN v USING (k) GROUP BY k
"""


@query(SWEEP_SQL)
def kmeans_sweep_shared(spark, sf):
    """Costs and silhouettes of 2 to 9 clusters from shared passes."""
    points = table(spark, sf, "orders").select(F.array(
        F.pow(F.lit(3.0), F.col("o_custkey") % 9) + (F.col("o_orderkey") % 7) / 100, (F.col("o_orderkey") % 11) / 100).alias("v"))
    found = sweep.kmeans_sweep_shared(points, features="v")
    return found.select("k", F.round(F.log("cost"), 6).alias("log_cost"), F.round("silhouette", 6).alias("silhouette"))


@query(PER_CUSTOMER + ", c AS (SELECT *, customer % 5 AS prediction FROM r) " + " UNION ALL ".join(
    f"SELECT prediction, '{c}' AS typ, round(avg({c}), 4) AS val FROM c GROUP BY prediction" for c in RFM_COLUMNS))
def cluster_profile(spark, sf):
    grouped = _rfm(spark, sf, True).withColumn("prediction", F.col("customer") % 5)
    return segments.cluster_profile(grouped, RFM_COLUMNS).withColumn("val", F.round("val", 4))


@query(" UNION ALL ".join(
    f"SELECT '{f}' AS feature, round(r * r / (1 - r * r) * (n - 2), 4) AS f_score FROM "
    f"(SELECT corr({f}, {TARGET}) AS r, count(*) AS n FROM lineitem)" for f in FEATURES))
def f_scores(spark, sf):
    return features.f_scores(table(spark, sf, "lineitem"), FEATURES, TARGET).withColumn("f_score", F.round("f_score", 4))


def _mi_sql(feature):
    return f"""
SELECT '{feature}' AS feature, round(sum(n / total * ln(n * total / (nx * ny))), 6) AS mutual_info FROM (
  SELECT n, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER () AS total FROM (
    SELECT least(floor((f - lf) / (hf - lf) * 10), 9) AS x, least(floor((t - lt) / (ht - lt) * 10), 9) AS y, CAST(count(*) AS DOUBLE) AS n
    FROM (SELECT CAST({feature} AS DOUBLE) AS f, {TARGET} AS t FROM lineitem),
         (SELECT CAST(min({feature}) AS DOUBLE) AS lf, CAST(max({feature}) AS DOUBLE) AS hf, min({TARGET}) AS lt, max({TARGET}) AS ht FROM lineitem)
    GROUP BY 1, 2))"""


@query(" UNION ALL ".join(_mi_sql(f) for f in FEATURES))
def binned_mutual_info(spark, sf):
    found = features.binned_mutual_info(table(spark, sf, "lineitem"), FEATURES, TARGET)
    return found.withColumn("mutual_info", F.round("mutual_info", 6))


def _eliminated(name, source, left, right):
    """SQL of Gauss-Jordan steps: from columns ``left`` x ``left`` and ``right``, as a function of (row, column), to the solved right side."""
    rows, cols = range(len(left)), [*left, *right]
    steps, at = [f"{name}0 AS (SELECT " + ", ".join(f"{source(r, c)} AS m{i}_{j}" for i, r in enumerate(left) for j, c in enumerate(cols)) + " FROM sums)"], 0
    for k in rows:
        new = ", ".join(
            (f"m{k}_{j} / m{k}_{k}" if i == k else f"m{i}_{j} - m{i}_{k} * m{k}_{j} / m{k}_{k}") + f" AS m{i}_{j}"
            for i in rows for j in range(len(cols)))
        steps.append(f"{name}{at + 1} AS (SELECT {new} FROM {name}{at})")
        at += 1
    return steps, f"{name}{at}"


def _vif_sql(columns):
    sums = ", ".join(f"sum(CAST({a} AS DOUBLE) * {b}) AS s_{i}_{j}" for i, a in enumerate(columns) for j, b in enumerate(columns))
    n = len(columns)
    steps, last = _eliminated("e", lambda r, c: f"s_{r}_{c}" if c < n else ("1.0" if c - n == r else "0.0"), list(range(n)), [n + k for k in range(n)])
    lines = " UNION ALL ".join(f"SELECT '{f}' AS feature, round(s_{i}_{i} * m{i}_{n + i}, 4) AS vif FROM sums, {last}" for i, f in enumerate(columns))
    return f"WITH sums AS (SELECT {sums} FROM lineitem), " + ", ".join(steps) + " " + lines


@query(_vif_sql([*FEATURES, TARGET]))
def vif(spark, sf):
    return features.vif(table(spark, sf, "lineitem"), [*FEATURES, TARGET]).withColumn("vif", F.round("vif", 4))


@query("""
WITH g AS (SELECT sum(q * q) AS qq, sum(q * d) AS qd, sum(q * t) AS qt, sum(d * d) AS dd, sum(d * t) AS dt, sum(t * t) AS tt
           FROM (SELECT l_quantity AS q, l_discount AS d, l_tax AS t FROM lineitem)),
x AS (SELECT *, qq * (dd * tt - dt * dt) - qd * (qd * tt - dt * qt) + qt * (qd * dt - dd * qt) AS det FROM g)
SELECT 'l_quantity' AS feature, round(qq * (dd * tt - dt * dt) / det, 4) AS vif FROM x
UNION ALL SELECT 'l_discount', round(dd * (qq * tt - qt * qt) / det, 4) FROM x
UNION ALL SELECT 'l_tax', round(tt * (qq * dd - qd * qd) / det, 4) FROM x
""")
def vif_of_three(spark, sf):
    """Three features, for which the inverse has a short closed form."""
    return features.vif(table(spark, sf, "lineitem"), FEATURES[:3]).withColumn("vif", F.round("vif", 4))


@query(ORACLES["vif"])
def wide_vif(spark, sf):
    """The same factors from products of blocks of rows."""
    return wide.wide_vif(table(spark, sf, "lineitem"), [*FEATURES, TARGET]).withColumn("vif", F.round("vif", 4))


@query("""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
x AS (SELECT vec_id, CAST(i AS INTEGER) AS i, CASE WHEN i < 64 THEN e[i + 1] ELSE e[i % 64 + 1] * e[(i * 7 + i // 64) % 64 + 1] END AS v
      FROM e, (SELECT unnest(range(300)) AS i))
SELECT a.i, b.i AS j, round(corr(a.v, b.v), 6) AS corr FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY a.i, b.i
""")
def wide_corr(spark, sf):
    """Correlations of 300 columns: the components of a vector and products of two of them."""
    whole = table(spark, sf, "embeddings").select(F.col("embedding").cast("array<double>").alias("e"))
    columns = whole.select(F.transform(F.sequence(F.lit(0), F.lit(299)), lambda i: F.when(
        i < 64, F.get("e", i)).otherwise(F.get("e", i % 64) * F.get("e", (i * 7 + F.floor(i / 64).cast("int")) % 64))).alias("v"))
    return wide.wide_corr(columns, "v").withColumn("corr", F.round("corr", 6))


def _psi_sql(n):
    """The digamma function of a count."""
    m = f"({n} + 6.0)"
    return (f"(ln({m}) - 1 / (2 * {m}) - 1 / (12 * pow({m}, 2)) + 1 / (120 * pow({m}, 4)) - 1 / (252 * pow({m}, 6)) + 1 / (240 * pow({m}, 8))"
            + "".join(f" - 1.0 / ({n} + {i})" for i in range(6)) + ")")


def _neighbour_sql(feature, name):
    """All pairs of orders: the third nearest distance, then the orders nearer than it on each axis."""
    return f"""
SELECT '{name}' AS feature, round(greatest(avg({_psi_sql("k")} - {_psi_sql("nx")} - {_psi_sql("ny")}) + {_psi_sql("count(*)")}, 0), 6) AS mutual_info FROM (
  WITH v AS (SELECT o_orderkey AS id, CAST({feature} AS DOUBLE) AS x, o_totalprice AS y FROM orders),
  s AS (SELECT CAST(format('{{:.5e}}', stddev_samp(x)) AS DOUBLE) AS sx, CAST(format('{{:.5e}}', stddev_samp(y)) AS DOUBLE) AS sy FROM v),
  p AS (SELECT id, CAST(floor(x / sx * 1048576 + 0.5) AS BIGINT) AS x, CAST(floor(y / sy * 1048576 + 0.5) AS BIGINT) AS y FROM v, s),
  e AS (SELECT a.id, any_value(a.x) AS x, any_value(a.y) AS y, list_max(min(greatest(abs(a.x - b.x), abs(a.y - b.y)), 3)) AS eps
        FROM p a JOIN p b ON a.id <> b.id GROUP BY a.id),
  c AS (SELECT e.id, any_value(eps) AS eps, count(*) FILTER (e.x = p.x AND e.y = p.y) AS same,
               count(*) FILTER (abs(e.x - p.x) < greatest(eps, 1)) AS nx, count(*) FILTER (abs(e.y - p.y) < greatest(eps, 1)) AS ny
        FROM e, p GROUP BY e.id)
  SELECT CASE WHEN eps = 0 THEN same ELSE 3 END AS k, nx, ny FROM c)"""


@query(_neighbour_sql("o_custkey", "customer") + " UNION ALL " + _neighbour_sql("date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE))", "day"))
def neighbour_mutual_info(spark, sf):
    """Mutual information of the price of an order with its customer and its day."""
    orders = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("customer"), F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).alias("day"),
        "o_totalprice")
    found = neighbours.neighbour_mutual_info(orders, ["customer", "day"], "o_totalprice")
    return found.withColumn("mutual_info", F.round("mutual_info", 6))


def _rfe_linear_sql():
    """All fits that the elimination of two of four features can need, then the two choices."""
    names = [*FEATURES, TARGET]
    sums = ", ".join(f"covar_pop({a}, {b}) AS s_{i}_{j}" for i, a in enumerate(names) for j, b in enumerate(names))
    steps, y = [], len(FEATURES)
    four, last = _eliminated("f", lambda r, c: f"s_{r}_{c}", list(range(y)), [y])
    steps += [*four, "w AS (SELECT " + ", ".join(f"abs(m{i}_{y}) AS w{i}" for i in range(y)) + f" FROM {last})"]
    first = "CASE " + " ".join(f"WHEN w{i} = least(w0, w1, w2, w3) THEN {i}" for i in range(y)) + " END"
    for gone in range(y):
        left = [i for i in range(y) if i != gone]
        three, end = _eliminated(f"t{gone}_", lambda r, c: f"s_{r}_{c}", left, [y])
        least = f"least({', '.join(f'abs(m{k}_3)' for k in range(3))})"
        second = "CASE " + " ".join(f"WHEN abs(m{k}_3) = {least} THEN {i}" for k, i in enumerate(left)) + " END"
        steps += [*three, f"d{gone} AS (SELECT {second} AS second FROM {end})"]
    steps.append(f"one AS (SELECT {first} AS first FROM w)")
    pick = "CASE first " + " ".join(f"WHEN {g} THEN (SELECT second FROM d{g})" for g in range(y)) + " END"
    steps.append(f"two AS (SELECT first, {pick} AS second FROM one)")
    rank = lambda i: f"CASE WHEN first = {i} THEN 3 WHEN second = {i} THEN 2 ELSE 1 END"
    lines = " UNION ALL ".join(f"SELECT '{f}' AS feature, {rank(i)} = 1 AS selected, CAST({rank(i)} AS INTEGER) AS rank FROM two" for i, f in enumerate(FEATURES))
    return f"WITH sums AS (SELECT {sums} FROM lineitem), " + ", ".join(steps) + " " + lines


@query(_rfe_linear_sql())
def rfe_linear(spark, sf):
    return features.rfe(table(spark, sf, "lineitem"), FEATURES, TARGET, 2)


@query(f"""
WITH s AS (SELECT covar_pop(l_quantity, {TARGET}) AS qy, covar_pop(l_discount, {TARGET}) AS dy, covar_pop(l_quantity, l_discount) AS qd,
                  var_pop(l_quantity) AS qq, var_pop(l_discount) AS dd FROM lineitem),
w AS (SELECT abs((qy * dd - dy * qd) / (qq * dd - qd * qd)) AS q, abs((dy * qq - qy * qd) / (qq * dd - qd * qd)) AS d FROM s)
SELECT 'l_quantity' AS feature, q >= d AS selected, CAST(CASE WHEN q >= d THEN 1 ELSE 2 END AS INTEGER) AS rank FROM w
UNION ALL SELECT 'l_discount', d > q, CAST(CASE WHEN d > q THEN 1 ELSE 2 END AS INTEGER) FROM w
""")
def rfe_of_two(spark, sf):
    """Two features, for which the coefficients have a short closed form."""
    return features.rfe(table(spark, sf, "lineitem"), FEATURES[:2], TARGET, 1)


def _training(spark, sf):
    """Features and target on all cores, for the iterative fits."""
    return spread(table(spark, sf, "lineitem").select(*FEATURES, TARGET))


# the feature that goes furthest with the class, as the others are drawn apart from it
@query("""
WITH c AS (SELECT CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS many, l_quantity AS q, l_discount * 500 AS d, l_tax * 600 AS t, l_linenumber * 7 AS n FROM lineitem),
r AS (SELECT unnest(['l_quantity', 'l_discount', 'l_tax', 'l_linenumber']) AS feature,
             unnest([abs(corr(q, many)), abs(corr(d, many)), abs(corr(t, many)), abs(corr(n, many))]) AS r FROM c)
SELECT feature, r = (SELECT max(r) FROM r) AS selected FROM r
""")
def rfe_svc(spark, sf):
    """The class is whether the quantity is above 25, so the quantity must be the one that stays.

    Coefficients are compared as they are, so the features are brought to one scale, 0 to 50.
    """
    many = _training(spark, sf).withColumns({
        "many": (F.col("l_quantity") > 25).cast("double"), "l_discount": F.col("l_discount") * 500,
        "l_tax": F.col("l_tax") * 600, "l_linenumber": F.col("l_linenumber") * 7})
    return features.rfe(many, FEATURES, "many", 1, model="svc").select("feature", "selected")


def _lasso_sql(alpha, sweeps):
    """Coordinate descent over the covariances, each new coefficient using those before it."""
    names = [*FEATURES, TARGET]
    y = len(FEATURES)
    sums = ", ".join(f"covar_pop({a}, {b}) AS s_{i}_{j}" for i, a in enumerate(names) for j, b in enumerate(names))
    inner = "SELECT d.*, s.* FROM d, sums s WHERE i < " + str(sweeps)
    for j in range(y):
        rest = " - ".join([f"s_{j}_{y}", *[f"s_{j}_{k} * {'n' if k < j else 'w'}{k}" for k in range(y) if k != j]])
        inner = f"SELECT *, sign({rest}) * greatest(abs({rest}) - {alpha}, 0) / s_{j}_{j} AS n{j} FROM ({inner})"
    lines = " UNION ALL ".join(f"SELECT '{f}' AS feature, round(w{k}, 2) AS coefficient FROM d WHERE i = {sweeps}" for k, f in enumerate(FEATURES))
    start = ", ".join(f"CAST(0 AS DOUBLE) AS w{k}" for k in range(y))
    return (f"WITH RECURSIVE sums AS (SELECT {sums} FROM lineitem), d AS (SELECT 0 AS i, {start} UNION ALL "
            f"SELECT i + 1, {', '.join(f'n{k}' for k in range(y))} FROM ({inner})) {lines}")


@query(_lasso_sql(0.01, 40))
def lasso(spark, sf):
    found = features.lasso(_training(spark, sf), FEATURES, TARGET, 0.01)
    return found.withColumn("coefficient", F.round("coefficient", 2))


@query(f"""
SELECT 'l_quantity' AS feature, round(sign(c) * greatest(abs(c) - 200, 0) / v, 3) AS coefficient
FROM (SELECT covar_pop(l_quantity, {TARGET}) AS c, var_pop(l_quantity) AS v FROM lineitem)
""")
def lasso_of_one(spark, sf):
    """One feature, for which the penalty just shortens the covariance."""
    found = features.lasso(table(spark, sf, "lineitem"), FEATURES[:1], TARGET, 200.0)
    return found.withColumn("coefficient", F.round("coefficient", 3))


@query()
def tree_importance(spark, sf):
    return features.tree_importance(table(spark, sf, "lineitem"), FEATURES, TARGET, rounds=5)


@query()
def permutation_importance(spark, sf):
    return features.permutation_importance(_training(spark, sf), FEATURES, TARGET, repeats=3, trees=20)


# the planted target is a step of one feature; which one, the correlations tell
STEP_SQL = """
WITH c AS (SELECT *, CASE WHEN {decides} THEN 10.0 ELSE 0.0 END AS step FROM lineitem),
r AS (SELECT unnest(['l_quantity', 'l_discount', 'l_tax', 'l_linenumber']) AS feature,
             unnest([abs(corr(l_quantity, step)), abs(corr(l_discount, step)), abs(corr(l_tax, step)), abs(corr(l_linenumber, step))]) AS r FROM c)
SELECT feature, r = (SELECT max(r) FROM r) AS leads FROM r
"""


def _stepped(spark, sf, decides):
    return table(spark, sf, "lineitem").withColumn("step", F.when(F.expr(decides), 10.0).otherwise(0.0))


def _leads(found, value):
    """Which feature holds nine tenths of all importance."""
    total = found.agg(F.sum(F.greatest(F.col(value), F.lit(0.0))).alias("all"))
    return found.join(F.broadcast(total)).select("feature", (F.col(value) > 0.9 * F.col("all")).alias("leads"))  # a line per feature, and one


@query(STEP_SQL.format(decides="l_discount > 0.045"))
def tree_importance_planted(spark, sf):
    """A target that the discount alone decides: boosted trees must give it nine tenths of the importance."""
    found = features.tree_importance(_stepped(spark, sf, "l_discount > 0.045"), FEATURES, "step", rounds=3)
    return _leads(found, "importance")


@query(STEP_SQL.format(decides="l_tax > 0.035"))
def permutation_importance_planted(spark, sf):
    """A target that the tax alone decides: only shuffling the tax may cost score."""
    found = features.permutation_importance(_stepped(spark, sf, "l_tax > 0.035"), FEATURES, "step", repeats=2, trees=10)
    return _leads(found, "perm_score")


DISTANCE_SQL = """
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT x.label, x.vec_id AS a, y.vec_id AS b,
        list_sum(list_transform(list_zip(x.e, y.e), lambda z: abs(z[1] - z[2]))) AS d
      FROM v x JOIN v y ON x.label = y.label AND {pairs})
"""


@query(DISTANCE_SQL.format(pairs="x.vec_id <> y.vec_id") + """
SELECT label, a, b, round(d, 4) AS distance, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rank FROM p
QUALIFY rank <= 5
""")
def pairwise_l1_nearest(spark, sf):
    found = distance.pairwise_l1(table(spark, sf, "embeddings"), "vec_id", "embedding", key="label", top=5)
    return found.withColumn("distance", F.round("distance", 4))


@query(ORACLES["pairwise_l1_nearest"])
def nearest_l1(spark, sf):
    """The same neighbours by distances to pivots and the triangle inequality."""
    found = distance.nearest_l1(table(spark, sf, "embeddings"), "vec_id", "embedding", 5, key="label")
    return found.withColumn("distance", F.round("distance", 4))


@query(DISTANCE_SQL.format(pairs="x.vec_id < y.vec_id") + "SELECT label, a, b, round(d, 4) AS distance FROM p")
def pairwise_l1(spark, sf):
    """The distance matrix within each label: its cells below the diagonal."""
    found = distance.pairwise_l1(table(spark, sf, "embeddings"), "vec_id", "embedding", key="label", mirrored=False)
    return found.withColumn("distance", F.round("distance", 4))


def _monthly(spark, sf):
    """Quantity-weighted totals per month and status of each return flag, in thousands."""
    total = F.sum(F.col("l_extendedprice").cast("decimal(14,2)")).cast("double") / 1000
    return table(spark, sf, "lineitem").groupBy(
        "l_returnflag", "l_linestatus", F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(total.alias("total"))


def _quarterly(spark, sf):
    """Totals of a supplier per quarter and status: a small matrix each."""
    total = F.sum(F.col("l_extendedprice").cast("decimal(14,2)")).cast("double") / 1000
    return table(spark, sf, "lineitem").groupBy(
        "l_suppkey", "l_linestatus", F.quarter("l_shipdate").alias("quarter")).agg(total.alias("total"))


# any allowed rounding meets the total and the bands: the line per group says whether this one does
ROUND_CHECK_SQL = """
WITH m AS (SELECT l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m') AS month,
                  CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS DOUBLE) / 1000 AS total
           FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS months,
       CAST(sum(floor(total)) + ceil(sum(total - floor(total)) - 1e-4) AS BIGINT) AS rounded, true AS bands_met
FROM m GROUP BY ALL
"""


def _round_1col(spark, sf, limit):
    keys = ["l_returnflag", "l_linestatus"]
    solved = rounding.controlled_round_1col(_monthly(spark, sf), keys, ["month"], "total", max_group_rows=limit)
    solved = stored(solved)
    audit = rounding.rounding_audit(solved.withColumn("one", F.lit(1)), keys, "month", "one", "total", "x")
    totals = solved.groupBy(*keys).agg(F.count(F.lit(1)).alias("months"), F.sum("rounded").alias("rounded"))
    return totals.join(audit, keys).select(*keys, "months", "rounded", "bands_met")


@query(ROUND_CHECK_SQL)
def round_1col(spark, sf):
    return _round_1col(spark, sf, None)


@query(ROUND_CHECK_SQL)
def round_1col_blocks(spark, sf):
    """The same by blocks, the plan for a group too large for one task."""
    return _round_1col(spark, sf, 0)


def _round_2d_sql():
    """The least cost over all 256 choices of a 4 x 2 matrix: totals, bands and deviations written out for each choice."""
    cells = [(i, j) for i in range(4) for j in range(2)]
    f = lambda i, j: f"f{i}{j}"
    x = lambda i, j: f"x{i}{j}"
    add = lambda name, ij: " + ".join(name(i, j) for i, j in ij)
    off = lambda ij: f"abs(({add(x, ij)}) * 10000 - round_even(({add(f, ij)}) * 10000, 0))"
    grid = ", ".join(f"coalesce(max(v - floor(v)) FILTER (quarter = {i + 1} AND l_linestatus = '{s}'), 0) AS f{i}{j}"
                     for i in range(4) for j, s in enumerate("FO"))
    bits = ", ".join(f"(b >> {2 * i + j}) & 1 AS x{i}{j}" for i, j in cells)
    runs = [[(k, j) for k in range(i + 1) for j in range(2)] for i in range(4)]
    bands = " AND ".join(f"{add(x, r)} BETWEEN floor({add(f, r)} - 1e-4) AND ceil({add(f, r)} + 1e-4)" for r in runs)
    open_ = " AND ".join(f"({x(i, j)} = 0 OR {f(i, j)} > 1e-4)" for i, j in cells)
    col_dev = " + ".join(off([(i, j) for i in range(4)]) for j in range(2))
    row_dev = " + ".join(off([(i, j) for j in range(2)]) for i in range(4))
    elem_dev = " + ".join(off([(k, j) for k in range(i + 1)]) for i, j in cells)
    return f"""
WITH m AS (SELECT l_suppkey, l_linestatus, quarter(l_shipdate) AS quarter,
                  floor(CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS DOUBLE) / 1000 * 1024) / 1024 AS v
           FROM lineitem GROUP BY ALL),
g AS (SELECT l_suppkey, sum(floor(v)) AS down, {grid} FROM m GROUP BY l_suppkey),
c AS (SELECT *, {bits} FROM g, (SELECT unnest(generate_series(0, 255)) AS b)),
d AS (SELECT l_suppkey, down + {add(x, cells)} AS rounded, ({col_dev}) * 10000 + ({row_dev}) * 1000 + ({elem_dev}) * 10 AS cost
      FROM c WHERE {add(x, cells)} = ceil({add(f, cells)}) AND {bands} AND {open_})
SELECT l_suppkey, CAST(min(rounded) AS BIGINT) AS rounded, CAST(min(cost) AS BIGINT) AS objective, CAST(min(cost) AS DOUBLE) AS audited
FROM d GROUP BY l_suppkey
"""


@query(_round_2d_sql())
def round_2d(spark, sf):
    """A matrix per supplier, in steps of 1/1024 so that sums are exact; its least cost, as solved and as audited."""
    steps = F.floor(F.col("total") * 1024) / 1024
    totals = _quarterly(spark, sf).withColumn("total", steps)
    solved = stored(rounding.controlled_round(totals, ["l_suppkey"], "quarter", "l_linestatus", "total"))
    audit = rounding.rounding_audit(solved, ["l_suppkey"], "quarter", "l_linestatus", "total", "x").filter(
        "total_met AND bands_met").select("l_suppkey", F.col("objective").alias("audited"))
    found = solved.groupBy("l_suppkey").agg(F.sum("rounded").alias("rounded"), F.max("objective").alias("objective"))
    return found.join(audit, "l_suppkey")


@query("""
WITH m AS (SELECT l_returnflag AS g, strftime(l_shipdate, '%Y-%m') AS r, l_linestatus AS c,
                  CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS DOUBLE) / 1000 AS v FROM lineitem GROUP BY ALL),
d AS (SELECT g, r, c, v - floor(v) AS fd, CAST(v - floor(v) AS DECIMAL(38,12)) AS f FROM m),
f AS (SELECT *, CAST(sum(f) OVER (PARTITION BY g ORDER BY r, c ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS cum FROM d),
x AS (SELECT g, r, c, f, ceil(cum - 1e-4) - greatest(ceil(cum - fd - 1e-4), 0) AS x FROM f),
br AS (SELECT g, r, sum(f) AS f, sum(x) AS x FROM x GROUP BY g, r),
rr AS (SELECT *, CAST(sum(f) OVER w AS DOUBLE) AS cf, sum(x) OVER w AS cx FROM br WINDOW w AS (PARTITION BY g ORDER BY r ROWS UNBOUNDED PRECEDING)),
ra AS (SELECT g, sum(x) = ceil(sum(f)) AS total_met, bool_and(cx BETWEEN floor(cf - 1e-4) AND ceil(cf + 1e-4)) AS bands_met,
              sum(abs(x * 10000 - round_even(CAST(f AS DOUBLE) * 10000, 0))) AS row_dev FROM rr GROUP BY g),
ca AS (SELECT g, sum(d) AS col_dev FROM (SELECT g, c, abs(sum(x) * 10000 - round_even(CAST(sum(f) AS DOUBLE) * 10000, 0)) AS d FROM x GROUP BY g, c) GROUP BY g),
ea AS (SELECT g, sum(abs(cx * 10000 - round_even(cf * 10000, 0))) AS elem_dev FROM (
         SELECT g, sum(x) OVER w AS cx, CAST(sum(f) OVER w AS DOUBLE) AS cf FROM x WINDOW w AS (PARTITION BY g, c ORDER BY r ROWS UNBOUNDED PRECEDING)) GROUP BY g)
SELECT ra.g AS l_returnflag, total_met, bands_met, row_dev, col_dev, elem_dev,
       col_dev * 10000 + row_dev * 1000 + elem_dev * 10 AS objective
FROM ra JOIN ca ON ra.g = ca.g JOIN ea ON ra.g = ea.g
""")
def rounding_audit(spark, sf):
    feasible = rounding.feasible_round_1col(_monthly(spark, sf), ["l_returnflag"], ["month", "l_linestatus"], "total")
    return rounding.rounding_audit(feasible, ["l_returnflag"], "month", "l_linestatus", "total", "x")


@query("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, round(r * r / (1 - r * r) * (n - 2), 4) AS f_score FROM "
    f"(SELECT corr({f}, {TARGET}) AS r, count(*) AS n FROM lineitem)" for f in FEATURES) + ") ORDER BY f_score DESC LIMIT 2")
def f_scores_top(spark, sf):
    """The two features that explain most."""
    return features.f_scores(table(spark, sf, "lineitem"), FEATURES, TARGET, top=2).withColumn("f_score", F.round("f_score", 4))


@query(" UNION ALL ".join(f"""
SELECT '{f}' AS feature, round(sum(n / total * ln(n * total / (nx * ny))), 6) AS mutual_info FROM (
  SELECT n, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER () AS total FROM (
    SELECT least(floor((f - lf) / (hf - lf) * 10), 9) AS x, y, CAST(count(*) AS DOUBLE) AS n
    FROM (SELECT CAST({f} AS DOUBLE) AS f, l_returnflag AS y FROM lineitem),
         (SELECT CAST(min({f}) AS DOUBLE) AS lf, CAST(max({f}) AS DOUBLE) AS hf FROM lineitem) GROUP BY 1, 2))""" for f in FEATURES))
def binned_mutual_info_classes(spark, sf):
    """Mutual information with the classes of the return flag."""
    found = features.binned_mutual_info(table(spark, sf, "lineitem"), FEATURES, "l_returnflag", discrete_target=True)
    return found.withColumn("mutual_info", F.round("mutual_info", 6))

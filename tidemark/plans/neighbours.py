"""Mutual information from nearest neighbours, by range-cut strips of points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import stored

#: Lattice points per standard deviation.
STEPS = 1 << 20
#: Distinct points of a strip: never fewer than this, and otherwise this many times the root of all points.
STRIP_ROWS, STRIP_ROOT = 5_000, 4
#: Rows that may meet one strip in one task.
GUEST_ROWS = 200_000
LEAF = 64
FAR = 1 << 62


def digamma(n: Column) -> Column:
    """The digamma function of a count of one or more, to about twelve digits."""
    m = n.cast("double") + 6
    series = F.log(m) - 1 / (2 * m) - 1 / (12 * m * m) + 1 / (120 * m ** 4) - 1 / (252 * m ** 6) + 1 / (240 * m ** 8)
    for i in range(6):
        series = series - 1 / (n.cast("double") + i)
    return series


def _leaves(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Row numbers in groups of at most ``LEAF``, cut at the median of the wider side."""
    todo, done = [np.arange(len(x))], []
    while todo:
        at = todo.pop()
        if len(at) <= LEAF:
            done.append(at)
            continue
        side = x[at] if np.ptp(x[at]) >= np.ptp(y[at]) else y[at]
        half = len(at) // 2
        order = np.argpartition(side, half)
        todo += [at[order[:half]], at[order[half:]]]
    return done


def _boxes(x: np.ndarray, y: np.ndarray, groups: list[np.ndarray]) -> np.ndarray:
    """(least x, largest x, least y, largest y) of each group."""
    return np.array([[x[g].min(), x[g].max(), y[g].min(), y[g].max()] for g in groups])


def _gaps(box: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Max-norm distance of one box to others, 0 where they meet."""
    return np.maximum(np.maximum(others[:, 0] - box[1], box[0] - others[:, 1]),
                      np.maximum(np.maximum(others[:, 2] - box[3], box[2] - others[:, 3]), 0))


def _nearest(qx, qy, reach, px, py, pw, k: int):
    """Distances and weights of the ``k`` points nearest to each query and unequal to it, as lists in query order.

    ``reach`` is a distance beyond which a query needs no point. Leaves of queries are set against the leaves of points that
    their reach, or the k-th distance in the two nearest leaves, can meet.
    """
    leaves = _leaves(px, py)
    boxes = _boxes(px, py, leaves)
    far, heavy = [None] * len(qx), [None] * len(qx)

    def cells(rows, chosen):
        at = np.concatenate([leaves[i] for i in chosen])
        d = np.maximum(np.abs(qx[rows][:, None] - px[at]), np.abs(qy[rows][:, None] - py[at]))
        d[d == 0] = FAR
        return at, d

    for rows in _leaves(qx, qy):
        gap = _gaps(_boxes(qx, qy, [rows])[0], boxes)
        first = np.argpartition(gap, 1)[:2] if len(gap) > 2 else np.arange(len(gap))
        _, d = cells(rows, first)
        limit = reach[rows]
        if d.shape[1] >= k:
            limit = np.minimum(limit, np.partition(d, k - 1, axis=1)[:, k - 1])
        chosen = np.flatnonzero(gap <= limit.max())
        if not len(chosen):
            chosen = first
        at, d = cells(rows, chosen)
        near = np.argpartition(d, k - 1, axis=1)[:, :k] if d.shape[1] > k else np.tile(np.arange(d.shape[1]), (len(rows), 1))
        found, weight = np.take_along_axis(d, near, 1), pw[at[near]]
        for row, fs, ws in zip(rows, found, weight):
            keep = fs < FAR
            far[row], heavy[row] = fs[keep], ws[keep]
    return far, heavy


def _reached(x, y, reach, box: np.ndarray, names: np.ndarray) -> list[list[int]]:
    """The strips that hold points nearer than its reach, for each point."""
    out: list[list[int]] = [[] for _ in x]
    for rows in _leaves(x, y):
        gap = _gaps(_boxes(x, y, [rows])[0], box)
        close = np.flatnonzero(gap < reach[rows].max())
        for i in close:
            b = box[i]
            own = np.maximum(np.maximum(b[0] - x[rows], x[rows] - b[1]), np.maximum(b[2] - y[rows], y[rows] - b[3]))
            for row in rows[np.maximum(own, 0) < reach[rows]]:
                out[row].append(int(names[i]))
    return out


def _strips(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` cut by range of the keys into strips of a bounded number of rows, as a stored frame."""
    df = stored(df)
    rows = df.count()
    size = max(STRIP_ROWS, int(STRIP_ROOT * rows ** 0.5))
    return stored(df.repartitionByRange(max(1, -(-rows // size)), *keys).withColumn("strip", F.spark_partition_id()))


def _met(guests: DataFrame, hosts: DataFrame, key: str):
    """Guests cogrouped with the strip that they ask, in parts of about ``GUEST_ROWS``; each part meets a copy of the strip.

    A strip holds a bounded number of rows, but any number may ask it: an axis of few values is one strip, asked by every point.
    """
    guests = stored(guests)
    asked = stored(guests.groupBy(F.col(key).alias("_k"), F.col("strip").alias("_s")).agg(
        F.ceil(F.count(F.lit(1)) / GUEST_ROWS).cast("int").alias("_n")))
    same = (F.col(key) == F.col("_k")) & (F.col("strip") == F.col("_s"))
    part = F.pmod(F.xxhash64("x", "y", "v") if "v" in guests.columns else F.xxhash64("x", "y"), F.col("_n")).cast("int")
    numbers = F.broadcast(asked)  # a line per strip
    cut = guests.join(numbers, same).withColumn("part", part).drop("_k", "_s", "_n")
    copies = hosts.join(numbers, same).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_k", "_s", "_n")
    return cut.groupBy(key, "strip", "part").cogroup(copies.groupBy(key, "strip", "part"))


def neighbour_mutual_info(df: DataFrame, features: list[str], target: str, k: int = 3) -> DataFrame:
    """Mutual information, in nats, of each feature and a continuous target, from the ``k`` nearest neighbours of each row.

    With eps the max-norm distance of a row to its k-th nearest other row, and nx, ny the rows, itself included, nearer than eps on
    one axis, the estimate is psi(n) + mean(psi(k) - psi(nx) - psi(ny)), never below 0. A row that has ``k`` others exactly on
    it takes their number, itself included, for k and the rows of equal x and y for nx and ny. Each axis is measured in its
    standard deviation, rounded to six digits, and put on a lattice of ``STEPS`` points a deviation, so no sum depends on the
    partitioning. Rows with a null, NaN or infinite value are left out; ``k`` rows or
    fewer give null.

    Equal points are counted before anything moves. Distinct ones are cut by range of (feature, x, y) into strips of bounded size whose boxes
    form a small directory; a strip finds the neighbours among its own points, and only points whose distance so far reaches
    into another strip visit it. The counts on one axis are differences of running counts, looked up in range-cut blocks.
    Points that ask one strip or block come in parts of bounded size.
    """
    if k < 1 or not features:
        raise ValueError("k is 1 or more, and there is a feature")
    spark = df.sparkSession
    cols = [f"c{i}" for i in range(len(features))] + ["t"]
    data = df.select(*[F.col(c).cast("double").alias(n) for c, n in zip([*features, target], cols)])
    for n in cols:
        data = data.where(F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf")))
    first = data.agg(F.count(F.lit(1)), *[F.stddev_samp(n) for n in cols]).first()
    total, sd = first[0], [float(f"{s or 0.0:.5e}") or 1.0 for s in first[1:]]
    empty = total <= k
    on = {n: F.floor(F.col(n) / s * STEPS + 0.5).cast("long") for n, s in zip(cols, sd)}
    cells = F.array(*[F.struct(F.lit(i).alias("f"), on[f"c{i}"].alias("x"), on["t"].alias("y")) for i in range(len(features))])
    if empty:
        return spark.createDataFrame([(f, None) for f in features], "feature STRING, mutual_info DOUBLE")
    points = _strips(data.select(F.inline(cells)).groupBy("f", "x", "y").agg(F.count(F.lit(1)).alias("w")), ["f", "x", "y"])
    boxes = points.groupBy("f", "strip").agg(*[g(c).alias(g.__name__ + c) for c in "xy" for g in (F.min, F.max)]).toPandas()
    sent = spark.sparkContext.broadcast(boxes)  # a line per strip, at most the root of the points
    shape = "f INT, x LONG, y LONG, w LONG, near ARRAY<STRUCT<d: LONG, w: LONG>>"

    def pairs(far, heavy):
        return [[{"d": int(a), "w": int(b)} for a, b in zip(d, w)] for d, w in zip(far, heavy)]

    def own(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, w = (pdf[c].to_numpy() for c in "xyw")
        far, heavy = _nearest(x, y, np.full(len(x), FAR), x, y, w, k)
        reach = np.where(w > k, 0, np.array([max(d) if len(d) >= k else FAR for d in far], dtype=np.int64))
        others = sent.value[(sent.value["f"] == key[0]) & (sent.value["strip"] != key[1])]
        to = _reached(x, y, reach, others[["minx", "maxx", "miny", "maxy"]].to_numpy(), others["strip"].to_numpy())
        return pd.DataFrame({"f": key[0], "x": x, "y": y, "w": w, "near": pairs(far, heavy), "reach": reach, "to": to})

    def visit(key, guests: pd.DataFrame, hosts: pd.DataFrame) -> pd.DataFrame:
        if guests.empty or hosts.empty:
            return pd.DataFrame(columns=["f", "x", "y", "w", "near"])
        far, heavy = _nearest(*(guests[c].to_numpy() for c in ("x", "y", "reach")), *(hosts[c].to_numpy() for c in "xyw"), k)
        return pd.DataFrame({"f": key[0], "x": guests["x"], "y": guests["y"], "w": guests["w"], "near": pairs(far, heavy)})

    home = stored(points.groupBy("f", "strip").applyInPandas(own, shape + ", reach LONG, `to` ARRAY<INT>"))
    guests = home.select("f", F.explode("to").alias("strip"), "x", "y", "w", "reach")
    visits = _met(guests, points, "f").applyInPandas(visit, shape)
    lists = home.select("f", "x", "y", "w", "near").union(visits).groupBy("f", "x", "y").agg(
        F.first("w").alias("w"), F.array_sort(F.flatten(F.collect_list("near"))).alias("near"))
    # the distance at which the weights, with the point's own copies, add up to k others
    step = F.aggregate("near", F.struct((F.col("w") - 1).alias("n"), F.lit(0).cast("long").alias("d")), lambda a, e: F.when(
        a["n"] >= k, a).otherwise(F.struct((a["n"] + e["w"]).alias("n"), e["d"].alias("d"))))
    reached = stored(lists.select("f", "x", "y", "w", step["d"].alias("eps")))

    axes = lambda f: F.array(*[F.struct((F.col("f") * 2 + i).alias("a"), F.col(c).alias("v")) for i, c in enumerate(f)])
    values = _strips(points.select("w", F.inline(axes("xy"))).groupBy("a", "v").agg(F.sum("w").alias("w")), ["a", "v"])
    ends = values.groupBy("a", "strip").agg(F.min("v").alias("lo"), F.sum("w").alias("n")).toPandas().sort_values(["a", "lo"])
    ends["before"] = ends.groupby("a")["n"].cumsum() - ends["n"]
    blocks = spark.sparkContext.broadcast(ends)  # a line per block
    # rows up to v + eps - 1, less rows up to v - eps; where eps is 0, rows up to v, less rows up to v - 1
    asked = F.inline(F.array(*[F.struct((F.col("f") * 2 + i).alias("a"), F.lit(sign).alias("sign"), (F.col(c) + (
        F.greatest(F.col("eps") - 1, F.lit(0)) if sign > 0 else -F.greatest(F.col("eps"), F.lit(1)))).alias("v"))
        for i, c in enumerate("xy") for sign in (1, -1)]))

    def place(batches):
        for pdf in batches:
            pdf["strip"] = -1
            for a, rows in pdf.groupby("a").groups.items():
                held = blocks.value[blocks.value["a"] == a]
                at = np.searchsorted(held["lo"].to_numpy(), pdf.loc[rows, "v"].to_numpy(), side="right") - 1
                pdf.loc[rows, "strip"] = np.where(at < 0, -1, held["strip"].to_numpy()[np.maximum(at, 0)])
            yield pdf

    def look_up(key, queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or held.empty:
            return pd.DataFrame(columns=["f", "x", "y", "axis", "n"])
        held = held.sort_values("v")
        line = blocks.value[(blocks.value["a"] == key[0]) & (blocks.value["strip"] == key[1])]
        sums = np.concatenate([[0], held["w"].to_numpy().cumsum()]) + line["before"].iloc[0]
        n = sums[np.searchsorted(held["v"].to_numpy(), queries["v"].to_numpy(), side="right")] * queries["sign"].to_numpy()
        return pd.DataFrame({"f": key[0] // 2, "x": queries["x"], "y": queries["y"], "axis": key[0] % 2, "n": n})

    queries = reached.select("x", "y", asked).mapInPandas(place, "x LONG, y LONG, a INT, sign INT, v LONG, strip INT").where("strip >= 0")
    counted = _met(queries, values, "a").applyInPandas(
        look_up, "f INT, x LONG, y LONG, axis INT, n LONG")
    zero = F.lit(0).cast("long")
    both = counted.select("f", "x", "y", *[F.when(F.col("axis") == i, F.col("n")).otherwise(zero).alias(n) for i, n in enumerate(("nx", "ny"))],
                          zero.alias("w"), zero.alias("eps"))
    each = reached.select("f", "x", "y", zero.alias("nx"), zero.alias("ny"), "w", "eps").unionByName(both).groupBy("f", "x", "y").agg(
        *[F.sum(c).alias(c) for c in ("nx", "ny", "w", "eps")])
    inner = digamma(F.when(F.col("eps") == 0, F.col("w")).otherwise(F.lit(k)))
    share = F.sum(F.col("w") * (inner - digamma(F.col("nx")) - digamma(F.col("ny")))) / total
    named = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("f") + 1)
    return each.groupBy("f").agg(share.alias("share")).select(
        named.alias("feature"), F.greatest(F.col("share") + digamma(F.lit(total)), F.lit(0.0)).alias("mutual_info"))

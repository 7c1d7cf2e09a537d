"""K-means for many numbers of clusters at once: every pass over the vectors serves all of them."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import stored

#: Passes that draw candidates; draws among them per k; how many of those go on to all vectors; candidates a pass, per largest k.
ROUNDS, RESTARTS, STARTS, OVER = 4, 24, 4, 10
#: Numbers of a stored block.
BLOCK = 1 << 16


def _distances(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared distance of each row to ``centre``, one component after the other: rows have few components, and columns are read fast."""
    d = np.zeros(len(x))
    for column, c in zip(x.T, centre, strict=True):
        off = column - c
        off *= off
        d += off
    return d


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre and squared distance to it, for each row."""
    best, at = np.full(len(x), np.inf), np.zeros(len(x), dtype=np.int64)
    for i, c in enumerate(centres):
        d = _distances(x, c)
        # the first of equal distances stays
        np.copyto(at, i, where=d < best)
        np.minimum(best, d, out=best)
    return at, best


def _pack(batches):
    """Vectors as blocks of doubles, component by component, with the number of vectors."""
    for batch in batches:
        held = batch.column(0)
        sizes = pc.unique(pc.list_value_length(held)).to_pylist()
        if len(sizes) > 1:
            raise ValueError("vectors of several lengths")
        rows = max(1, BLOCK // max(sizes[0], 1)) if sizes else 1
        for at in range(0, len(held), rows):
            part = held.slice(at, rows)
            x = part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
            yield pa.RecordBatch.from_arrays([pa.array([len(part)], pa.int32()), pa.array([np.ascontiguousarray(x.T).tobytes()], pa.binary())], ["n", "b"])


def _blocks(batches):
    """The blocks of ``_pack`` as matrices of a row per vector."""
    for batch in batches:
        for n, b in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield np.frombuffer(b.as_buffer()).reshape(-1, n).T


def _lines(names: list[str], lines: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*lines)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if name == "v" else pa.int32()) for name, c in zip(names, columns)], names)


def _seeds(points: np.ndarray, weight: np.ndarray, k: int, draw: np.random.Generator) -> list[np.ndarray]:
    """The ``STARTS`` best of several weighted draws of ``k`` of the candidate points, each improved among the candidates."""
    found = []
    for _ in range(RESTARTS):
        centres = points[[draw.choice(len(points), p=weight / weight.sum())]]
        while len(centres) < min(k, len(points)):
            cost = _nearest(points, centres)[1] * weight
            if cost.sum() == 0:
                break
            centres = np.vstack([centres, points[draw.choice(len(points), p=cost / cost.sum())]])
        for _ in range(10):
            at, cost = _nearest(points, centres)
            heavy = np.bincount(at, weight, len(centres))
            sums = np.stack([np.bincount(at, weight * points[:, j], len(centres)) for j in range(points.shape[1])], axis=1)
            centres = np.where(heavy[:, None] > 0, sums / np.maximum(heavy, 1e-300)[:, None], centres)
        found.append((float((_nearest(points, centres)[1] * weight).sum()), centres))
    return [centres for _, centres in sorted(found, key=lambda pair: pair[0])[:STARTS]]


class _Passes:
    """Passes over stored blocks of vectors; each sums by (k, cluster) inside the tasks, so a model's worth of numbers returns."""

    def __init__(self, vectors: DataFrame):
        self.vectors, self.count = vectors, 0

    def sums(self, centres: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """Per k a line per cluster: rows, squared distance to the centre, sum of the offsets from it."""
        self.count += 1

        def add_up(batches):
            totals = {k: np.zeros((len(c), c.shape[1] + 2)) for k, c in centres.items()}
            for x in _blocks(batches):
                for k, c in centres.items():
                    at, cost = _nearest(x, c)
                    part = [np.ones(len(x)), cost, *(x[:, j] - c[at, j] for j in range(c.shape[1]))]
                    totals[k] += np.stack([np.bincount(at, p, len(c)) for p in part], axis=1)
            yield _lines(["k", "c", "j", "v"], [(k, i, j, v) for k, t in totals.items() for (i, j), v in np.ndenumerate(t) if v])

        found = self.vectors.mapInArrow(add_up, "k INT, c INT, j INT, v DOUBLE").groupBy("k", "c", "j").agg(F.sum("v").alias("v"))
        out = {k: np.zeros((len(c), c.shape[1] + 2)) for k, c in centres.items()}
        for r in found.collect():
            out[r.k][r.c, r.j] = r.v
        return out

    def drawn(self, centres: np.ndarray, share: float, seed: int) -> np.ndarray:
        """Rows drawn with a chance of ``share`` times the squared distance to the nearest centre."""
        self.count += 1

        def draw(batches):
            chance = np.random.default_rng([seed, TaskContext.get().partitionId()])
            for x in _blocks(batches):
                chosen = x[chance.random(len(x)) < share * _nearest(x, centres)[1]]
                yield pa.RecordBatch.from_arrays([pa.array(chosen.tolist(), pa.list_(pa.float64()))], ["_v"])

        rows = [r[0] for r in self.vectors.mapInArrow(draw, "_v ARRAY<DOUBLE>").collect()]
        return np.array(rows).reshape(len(rows), centres.shape[1])

    def silhouettes(self, means: dict[int, np.ndarray], spread: dict[int, np.ndarray], rows: dict[int, np.ndarray],
                    centres: dict[int, np.ndarray]) -> dict[int, float]:
        """Mean silhouette per k by squared distances: those to a cluster average the one to its mean plus its variance."""
        self.count += 1

        def judge(batches):
            totals = dict.fromkeys(means, 0.0)
            for x in _blocks(batches):
                for k, m in means.items():
                    at, n = _nearest(x, centres[k])[0], rows[k]
                    far = np.stack([_distances(x, c) + s for c, s in zip(m, spread[k])])
                    far[n == 0] = np.inf
                    each, size = np.arange(len(x)), n[at]
                    own = far[at, each] * size / np.maximum(size - 1, 1)
                    far[at, each] = np.inf
                    other = far.min(axis=0)
                    most = np.maximum(own, other)
                    with np.errstate(invalid="ignore"):
                        value = np.where((size > 1) & (most > 0), (other - own) / most, 0.0)
                    totals[k] += float(value.sum())
            yield _lines(["k", "v"], list(totals.items()))

        found = self.vectors.mapInArrow(judge, "k INT, v DOUBLE").groupBy("k").agg(F.sum("v").alias("v")).collect()
        return {r.k: r.v for r in found}


def kmeans_sweep_shared(
    df: DataFrame, ks: Iterable[int] = range(2, 10), seed: int = 1, features: str = "standardized", max_iter: int = 40,
    tol: float = 1e-6, passes: list[int] | None = None,
) -> DataFrame:
    """(k, cost, silhouette) for each number of clusters, as ``kmeans_sweep`` gives, with passes shared by all k.

    Candidates for the first centres are drawn in a few passes with chances by distance, about ten times the largest k in each,
    and weighted by the rows nearest to them; every k picks several starts among them. Then each pass moves the centres of
    every start that is not yet at rest, the cheapest of each k counts, and the last two give costs and silhouettes. ``passes`` receives their number, which
    does not grow with the number of k.

    ``features`` is a vector or an array column. Null vectors are left out; an empty frame has no lines. With fewer distinct vectors
    than k some clusters stay empty; the silhouette is null when fewer than two are used.
    """
    ks = sorted({int(k) for k in ks})
    if not ks or ks[0] < 1:
        raise ValueError("every k is 1 or more")
    shape = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("cost", T.DoubleType()), T.StructField("silhouette", T.DoubleType())])
    column = F.col(features) if isinstance(df.schema[features].dataType, T.ArrayType) else vector_to_array(features)
    vectors = df.where(F.col(features).isNotNull()).select(column.cast("array<double>").alias("_v"))
    # a pass reads blocks: a row per vector would cost it more than the distances
    blocks = stored(vectors.mapInArrow(_pack, "n INT, b BINARY").repartition(df.sparkSession.sparkContext.defaultParallelism))
    first = blocks.first()
    if first is None:
        return df.sparkSession.createDataFrame([], shape)
    job = _Passes(blocks)
    points = np.frombuffer(first.b).reshape(-1, first.n)[:, :1].T
    for i in range(ROUNDS):
        cost = job.sums({1: points})[1][:, 1].sum()
        if cost == 0:
            break
        points = np.unique(np.vstack([points, job.drawn(points, OVER * ks[-1] / cost, seed + i)]), axis=0)
    weight = job.sums({1: points})[1][:, 0]
    draw = np.random.default_rng(seed)
    runs = [(k, centres) for k in ks for centres in _seeds(points, weight, k, draw)]
    centres = {i: c for i, (_, c) in enumerate(runs)}
    moving = list(centres)
    for _ in range(max_iter):
        totals = job.sums({i: centres[i] for i in moving})
        for i in list(moving):
            step = totals[i][:, 2:] / np.maximum(totals[i][:, :1], 1)
            centres[i] = centres[i] + step
            scale = max(float((centres[i] ** 2).sum(axis=1).max()), 1e-300)
            if float((step ** 2).sum(axis=1).max()) <= tol * tol * scale:
                moving.remove(i)
        if not moving:
            break
    ended = job.sums(centres)
    best = {k: min((i for i, run in enumerate(runs) if run[0] == k), key=lambda i: (ended[i][:, 1].sum(), i)) for k in ks}
    centres, last = {k: centres[i] for k, i in best.items()}, {k: ended[i] for k, i in best.items()}
    cost = {k: float(t[:, 1].sum()) for k, t in last.items()}
    rows = {k: t[:, 0] for k, t in last.items()}
    offset = {k: t[:, 2:] / np.maximum(t[:, :1], 1) for k, t in last.items()}
    means = {k: centres[k] + offset[k] for k in ks}
    spread = {k: t[:, 1] / np.maximum(t[:, 0], 1) - (offset[k] ** 2).sum(axis=1) for k, t in last.items()}
    several = [k for k in ks if (rows[k] > 0).sum() > 1]
    pick = lambda held: {k: held[k] for k in several}
    found = job.silhouettes(pick(means), pick(spread), pick(rows), pick(centres)) if several else {}
    if passes is not None:
        passes.append(job.count)
    lines = [(k, cost[k], found[k] / float(rows[k].sum()) if k in found else None) for k in ks]
    return df.sparkSession.createDataFrame(lines, shape)

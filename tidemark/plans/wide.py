"""Correlations and inflation factors of hundreds of columns, from products of blocks of rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def wide_gram(df: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, a shift, and the sums of products of an array column of doubles less that shift.

    The matrix has a leading column for the constant one, so its first line holds n and the sums. Each task multiplies its batches
    as matrices and passes on one line per row of the matrix; lines are added in two steps, the first over the
    root of the tasks, so no task adds more than that many. Only the matrix reaches the driver. Vectors that are null or hold a
    null, NaN or infinite value are left out; vectors of differing length are an error.
    """
    rows = df.select(F.col(vector).cast("array<double>").alias("_v")).where(
        F.col("_v").isNotNull() & F.forall("_v", lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False)) & ~F.isnan(e)))
    first = rows.first()
    if first is None:
        return 0, np.zeros(0), np.zeros((1, 1))
    shift = np.array(first[0])  # near the data, so that the sums keep their digits

    def products(batches):
        total = np.zeros((len(shift) + 1, len(shift) + 1))
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["_v"]) - shift
                x = np.hstack([np.ones((len(x), 1)), x])
                total += x.T @ x
        yield pd.DataFrame({"i": np.arange(len(total), dtype=np.int32), "line": list(total)})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": pdf["i"].iloc[:1], "line": [np.sum(np.stack(pdf["line"]), axis=0)]})

    shape = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("line", T.ArrayType(T.DoubleType()))])
    parts = rows.mapInPandas(products, shape).withColumn("_task", F.spark_partition_id())
    tasks = max(1, int(np.sqrt(rows.rdd.getNumPartitions())))
    half = parts.groupBy("i", F.pmod(F.col("_task"), F.lit(tasks)).alias("_part")).applyInPandas(lambda pdf: added(pdf), shape)
    whole = half.groupBy("i").applyInPandas(lambda pdf: added(pdf), shape)
    matrix = np.zeros((len(shift) + 1, len(shift) + 1))
    for r in whole.collect():
        matrix[r.i] = r.line
    return int(round(matrix[0, 0])), shift, matrix


def _columns(df: DataFrame, columns: list[str] | str) -> tuple[DataFrame, str, list[str] | None]:
    if isinstance(columns, str):
        return df, columns, None
    return df.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("_vector")), "_vector", list(columns)


def wide_corr(df: DataFrame, columns: list[str] | str) -> DataFrame:
    """(i, j, corr) for each pair i < j of the columns, or of the places of one array column, counted from 0.

    A constant column has null correlations. A row with a missing or non-finite value in any column is left out; no rows, no lines.
    """
    source, vector, _ = _columns(df, columns)
    n, shift, g = wide_gram(source, vector)
    spark, shape = df.sparkSession, "i INT, j INT, corr DOUBLE"
    if not n:
        return spark.createDataFrame([], shape)
    centred = g[1:, 1:] - np.outer(g[0, 1:], g[0, 1:]) / n
    noise = np.maximum(g.diagonal()[1:], 0) * 1e-13
    sd = np.where(centred.diagonal() > noise, np.sqrt(np.maximum(centred.diagonal(), 0)), np.nan)
    corr = np.clip(centred / np.outer(sd, sd), -1, 1)
    i, j = np.triu_indices(len(shift), 1)
    lines = pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "corr": corr[i, j]})
    return spark.createDataFrame(lines, shape).withColumn("corr", F.nanvl("corr", F.lit(None).cast("double")))


def wide_vif(df: DataFrame, columns: list[str] | str) -> DataFrame:
    """(feature, vif) from regressions without intercept, for any number of columns; places of an array column are named by number.

    Columns that depend on each other exactly have no factor: an error, as the matrix has no inverse. No rows, no lines.
    """
    source, vector, names = _columns(df, columns)
    n, shift, g = wide_gram(source, vector)
    spark, shape = df.sparkSession, "feature STRING, vif DOUBLE"
    if not n:
        return spark.createDataFrame([], shape)
    sums = g[0, 1:]
    raw = g[1:, 1:] + np.outer(sums, shift) + np.outer(shift, sums) + n * np.outer(shift, shift)
    scale = 1 / np.sqrt(raw.diagonal())
    scaled = raw * np.outer(scale, scale)
    factors = np.linalg.inv(scaled).diagonal() * scaled.diagonal()
    return spark.createDataFrame([(str(f), float(v)) for f, v in zip(names or range(len(shift)), factors)], shape)

"""Exact quartiles: more rows than a sketch keeps apart, repeated values, nulls and empty columns."""

import math

from pyspark.sql import functions as F

from __spark_entry__ import queries
from tidemark.operators.aggregate import exact_quartiles
from tests.conftest import rows


def test_quartiles_of_many_rows_cut_off_exact_ranks(spark, tmp_path):
    n, buyers = 900_000, 90_001
    orders = spark.range(0, n, 1, 6).select(
        (F.xxhash64("id") % buyers).alias("o_custkey"), F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(10 ** 9)).cast("double").alias("o_totalprice"))
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    found = {r[0]: list(r)[1:] for r in queries()["orders_summary_ranks"](spark, str(tmp_path)).collect()}
    held = spark.read.parquet(str(tmp_path / "orders.parquet")).toPandas()
    for c in ("o_custkey", "o_totalprice"):
        values = held[c].sort_values().to_numpy()
        marks = [values[math.ceil(n * q) - 1] for q in (0.25, 0.5, 0.75)]
        assert found[c] == [int((values <= m).sum()) for m in marks]


def test_few_rows_nulls_and_empty_columns(spark):
    df = spark.createDataFrame([(1, 5.0, None), (1, None, None), (2, -1.0, None), (9, 2.0, None), (None, 2.0, None)], "a INT, b DOUBLE, c DOUBLE")
    assert rows(exact_quartiles(df, ["a", "b", "c"]), "column") == [("a", 1.0, 1.0, 2.0), ("b", -1.0, 2.0, 2.0), ("c", None, None, None)]
    assert rows(exact_quartiles(df.limit(0), ["a"])) == [("a", None, None, None)]

"""Filters and choices of a faceted table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def facet_filter(df: DataFrame, chosen: dict[str, object]) -> DataFrame:
    """Rows equal to every chosen value; None and '' leave a column free."""
    for name, value in chosen.items():
        if value is not None and value != "":
            df = df.filter(F.col(name) == F.lit(value))
    return df


def facet_options(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values per column as (facet, value), from one pass.

    Each row becomes one cell per column and equal cells merge before the shuffle.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(cells)).distinct()


def cascade_options(df: DataFrame, parent: str, value: object, child: str, selection: list) -> DataFrame:
    """Sorted choices of ``child`` under one parent, and which of them stay selected."""
    under = df.filter(F.col(parent) == F.lit(value)).select(F.col(child).alias("option")).distinct()
    kept = F.col("option").isin(list(selection)) if selection else F.lit(False)
    return under.withColumn("selected", F.coalesce(kept, F.lit(False))).orderBy("option")

"""Projection, filters and cleaning."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numeric import bin_values as _bins
from tidemark.functions.text import first_match

OPERATORS = {
    "==": lambda c, v: c == v, "=": lambda c, v: c == v, "!=": lambda c, v: c != v,
    "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v,
    "in": lambda c, v: c.isin(list(v)), "not in": lambda c, v: ~c.isin(list(v)),
    "between": lambda c, v: c.between(v[0], v[1]),
    "is null": lambda c, v: c.isNull(), "not null": lambda c, v: c.isNotNull(),
}


def cast_columns(df: DataFrame, types: dict[str, str | tuple[str, str]]) -> DataFrame:
    """Cast several columns; what does not fit becomes null.

    A type is a Spark type name, or ('timestamp', pattern) / ('date', pattern).
    """
    def one(name: str, target: str | tuple[str, str]) -> Column:
        if isinstance(target, str):
            return F.col(name).try_cast(target)
        kind, pattern = target
        return F.try_to_timestamp(F.col(name), F.lit(pattern)).cast(kind)

    return df.withColumns({name: one(name, target) for name, target in types.items()})


def case_when(df: DataFrame, name: str, column: str, values: list, then: Column, other: Column) -> DataFrame:
    """``then`` where the column, as a string, is one of ``values``, else ``other``."""
    hit = F.col(column).cast("string").isin([str(v) for v in values])
    return df.withColumn(name, F.when(hit, then).otherwise(other))


def pick(df: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns in that order; an unknown name is an error."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.select(*columns)


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """All but the named columns."""
    return df.drop(*columns)


def lower_names(df: DataFrame) -> DataFrame:
    """Column names in lower case; two names that become one are an error."""
    names = [c.lower() for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"names collide in lower case: {names}")
    return df.toDF(*names)


def conditions_column(conditions: list[tuple]) -> Column:
    """(column, operator, value) tuples joined by AND."""
    tests = []
    for condition in conditions:
        name, op, *value = condition
        if op not in OPERATORS:
            raise ValueError(f"unknown operator: {op}")
        tests.append(OPERATORS[op](F.col(name), value[0] if value else None))
    return reduce(and_, tests, F.lit(True))


def where_conditions(df: DataFrame, conditions: Column | str | list[tuple] | None) -> DataFrame:
    """Filter by an expression or by (column, operator, value) tuples."""
    if conditions is None:
        return df
    return df.filter(conditions_column(conditions) if isinstance(conditions, list) else conditions)


def drop_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that have a value in all the columns."""
    return df.dropna(subset=columns)


def fill_missing(df: DataFrame, num: float = 0, text: str | None = None) -> DataFrame:
    """Nulls and NaN in numeric columns become ``num``; nulls in strings ``text`` unless None."""
    filled = df.fillna(num)
    return filled if text is None else filled.fillna(text)


def map_values(df: DataFrame, mapping: dict[str, dict]) -> DataFrame:
    """Replace literal values per column; other values stay."""
    new = {}
    for name, pairs in mapping.items():
        kind = df.schema[name].dataType
        value = F.col(name)
        for old, changed in pairs.items():
            value = F.when(F.col(name) == F.lit(old), F.lit(changed).cast(kind)).otherwise(value)
        new[name] = value
    return df.withColumns(new)


def with_constant(df: DataFrame, name: str, value: object) -> DataFrame:
    """A literal column, such as the day of a snapshot."""
    return df.withColumn(name, F.lit(value))


def derive(df: DataFrame, **columns: Column) -> DataFrame:
    """Several columns at once, all computed from the input columns."""
    return df.withColumns(columns)


def keyword_grade(df: DataFrame, name: str, column: str, ladder: list[tuple], default: object) -> DataFrame:
    """First rung of a keyword ladder that occurs in the lower-cased column."""
    return df.withColumn(name, first_match(F.col(column), ladder, default))


def bin_values(df: DataFrame, name: str, column: str, edges: list[float], labels: list[str]) -> DataFrame:
    """Right-closed bins, the lowest edge included."""
    return df.withColumn(name, _bins(F.col(column), edges, labels))


def drop_constant(df: DataFrame) -> DataFrame:
    """Columns with more than one distinct value, null counting as a value.

    One pass of min, max and null counts; no distinct set is built.
    """
    stats = df.agg(*[
        x for c in df.columns
        for x in (F.coalesce(F.min(c) != F.max(c), F.lit(False)).alias(f"d_{c}"),
                  (F.count(c) > 0).alias(f"v_{c}"), (F.count(F.lit(1)) > F.count(c)).alias(f"n_{c}"))
    ]).first()
    return df.select(*[c for c in df.columns if stats[f"d_{c}"] or (stats[f"v_{c}"] and stats[f"n_{c}"])])


def variances(df: DataFrame, columns: list[str] | None = None, sample: bool = True) -> DataFrame:
    """One row of variances, of the sample or of the population."""
    kinds = (T.NumericType,)
    names = columns or [f.name for f in df.schema if isinstance(f.dataType, kinds)]
    variance = F.var_samp if sample else F.var_pop
    return df.agg(*[variance(c).alias(c) for c in names])


def drop_low_variance(df: DataFrame, threshold: float = 0.0, sample: bool = True) -> DataFrame:
    """Columns whose variance is above the threshold; non-numeric columns go."""
    stats = variances(df, sample=sample).first().asDict()
    return df.select(*[c for c in df.columns if stats.get(c) is not None and stats[c] > threshold])

"""Repeatable synthetic columns and tables."""

from __future__ import annotations

import random
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numeric import uniform

DEFAULT_POOL = 10
DEFAULT_LENGTH = (5, 5)
# fixed values: unit and length of the steps
FREQUENCIES = {"D": ("DAY", 1), "H": ("HOUR", 1), "30min": ("MINUTE", 30), "MS": ("MONTH", 1)}


def _spread(spec: dict | int | None, prefix: str) -> list[dict]:
    """One dict per column: lists give one value per column, other values serve all."""
    if spec is None:
        return []
    spec = {"count": spec} if isinstance(spec, int) else dict(spec)
    count = spec.pop("count")
    names = spec.pop("name", None)
    columns = []
    for i in range(count):
        column = {k: ((v[i] if i < len(v) else None) if isinstance(v, list) else v) for k, v in spec.items()}
        given = names[i] if isinstance(names, list) and i < len(names) else names if isinstance(names, str) else None
        column["name"] = given or f"{prefix}{i + 1}"
        columns.append(column)
    return columns


def _pool(seed: str, size: int | None, length: int | tuple[int, int] | None, chars: str | None) -> list[str]:
    rng = random.Random(seed)
    low, high = (length, length) if isinstance(length, int) else (length or DEFAULT_LENGTH)
    alphabet = chars or string.ascii_letters + string.digits
    return ["".join(rng.choices(alphabet, k=rng.randint(low, high))) for _ in range(size or DEFAULT_POOL)]


def _pick(options: list[str], draw: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (F.floor(draw * len(options)) + 1).cast("int"))


def _grid(spec: dict) -> tuple[Column, str, int, Column]:
    """First timestamp, unit, length and number of the steps in [start, end)."""
    unit, length = FREQUENCIES[spec.get("freq") or "D"]
    first = F.lit(spec.get("start_date") or "2024-01-01").cast("timestamp")
    end = F.lit(spec.get("end_date") or "2025-01-01").cast("timestamp")
    if unit == "MONTH":
        month = F.date_trunc("month", first)
        first = F.when(month < first, F.timestamp_add("MONTH", F.lit(1), month)).otherwise(month)
    whole = F.timestamp_diff(unit, first, end)
    exact = F.timestamp_add(unit, whole, first) == end
    steps = F.when(exact, F.ceil(whole / length)).otherwise(F.floor(whole / length) + 1)
    return first, unit, length, steps.cast("bigint")


def random_columns(
    df: DataFrame,
    key: str,
    str_cols: dict | int | None = None,
    ts_cols: dict | int | None = None,
    int_cols: dict | int | None = None,
    float_cols: dict | int | None = None,
    rand_seed: int = 11,
) -> DataFrame:
    """Attach synthetic columns drawn from the hash of ``key``.

    Options per column: ``str_count``, ``str_len``, ``str_chars``, ``col_strs`` for strings;
    ``start_date``, ``end_date``, ``freq`` for sampled timestamps in [start, end);
    ``low`` and an exclusive ``high`` for numbers; ``missing_pct`` for all.
    """
    new: dict[str, Column] = {}

    def draw(name: str, purpose: str = "value") -> Column:
        return uniform(F.col(key), F.lit(rand_seed), F.lit(name), F.lit(purpose))

    def put(spec: dict, value: Column) -> None:
        share = spec.get("missing_pct")
        if share is not None and 0 < share < 1:
            value = F.when(draw(spec["name"], "missing") > share, value)
        new[spec["name"]] = value

    for spec in _spread(str_cols, "s"):
        pool = spec.get("col_strs") or _pool(
            f"{rand_seed}/{spec['name']}", spec.get("str_count"), spec.get("str_len"), spec.get("str_chars"))
        put(spec, _pick(pool, draw(spec["name"])))
    for spec in _spread(ts_cols, "t"):
        first, unit, length, steps = _grid(spec)
        put(spec, F.timestamp_add(unit, (F.floor(draw(spec["name"]) * steps) * length).cast("int"), first))
    for spec in _spread(int_cols, "i"):
        low, high = spec.get("low") or 0, 2 if spec.get("high") is None else spec["high"]
        put(spec, (F.floor(draw(spec["name"]) * (high - low)) + low).cast("bigint"))
    for spec in _spread(float_cols, "f"):
        low, high = spec.get("low") or 0, 2 if spec.get("high") is None else spec["high"]
        put(spec, draw(spec["name"]) * float(high - low) + float(low))
    return df.withColumns(new)


def random_table(
    spark: SparkSession,
    nrow: int,
    str_cols: dict | int | None = None,
    ts_cols: dict | int | None = None,
    int_cols: dict | int | None = None,
    float_cols: dict | int | None = None,
    rand_seed: int = 11,
) -> DataFrame:
    """``nrow`` rows of synthetic columns.

    A timestamp column without ``random`` runs through its range in row order; a range with
    fewer steps than rows is an error. The same seed gives the same rows on any cluster.
    """
    sampled, running = [], []
    for spec in _spread(ts_cols, "t"):
        (sampled if spec.get("random") else running).append(spec)
    rows = spark.range(nrow).withColumnRenamed("id", "_row")
    frame = random_columns(rows, "_row", str_cols, None, int_cols, float_cols, rand_seed)
    for spec in sampled:
        frame = random_columns(frame, "_row", None, {"count": 1, **spec}, rand_seed=rand_seed)
    for spec in running:
        first, unit, length, count = _grid(spec)
        steps = spark.range(1).select(count).first()[0]
        if steps < nrow:
            raise ValueError(f"{spec['name']}: {steps} timestamps for {nrow} rows")
        value = F.timestamp_add(unit, (F.col("_row") * length).cast("int"), first)
        share = spec.get("missing_pct")
        if share is not None and 0 < share < 1:
            gap = uniform(F.col("_row"), F.lit(rand_seed), F.lit(spec["name"]), F.lit("missing"))
            value = F.when(gap > share, value)
        frame = frame.withColumn(spec["name"], value)
    order = [s["name"] for s in (_spread(str_cols, "s") + _spread(ts_cols, "t") + _spread(int_cols, "i")
                                 + _spread(float_cols, "f"))]
    return frame.select(*order)

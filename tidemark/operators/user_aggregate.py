"""User-defined aggregates with partial states: rows are reduced where they lie, and one shuffle moves states only."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Keys a task holds before it passes their states on.
HELD = 10_000
#: States of a key that are merged at once.
RUN = 64


@dataclass(frozen=True)
class UserAggregate:
    """An aggregate over ``columns``.

    ``reduce`` turns the rows of one key within a batch, never none, into a state: a dict of the fields that ``state`` declares.
    ``merge`` makes one state of several, in any order and grouping. ``finish`` gives the value, of type ``result``.
    """

    columns: list[str]
    state: str
    result: str
    reduce: Callable[[pa.RecordBatch], dict]
    merge: Callable[[list[dict]], dict]
    finish: Callable[[dict], object]


def aggregate_by(df: DataFrame, keys: list[str], **aggregates: UserAggregate) -> DataFrame:
    """The keys and a column per aggregate, all from one pass.

    Each task reduces its batches and merges the states it holds, so a key that holds a third of all rows sends a state per task (or
    per 10,000 keys that a task meets) and not its rows. States are then dealt by key, sorted, and merged as a stream: a task holds
    64 states of one key. Keys are of atomic types; null and NaN are keys like any other, -0.0 is 0.0. Without keys there
    is one line, and none for a frame without rows. A name that is also a key is an error.
    """
    clash = set(keys) & set(aggregates)
    if clash:
        raise ValueError(f"named as keys: {sorted(clash)}")
    names = [f"k{i}" for i in range(len(keys))]
    users = list(aggregates.values())
    states = _states(df, keys, users)
    ends = [T._parse_datatype_string(a.result) for a in users]
    kinds = [to_arrow_type(e) for e in ends]
    shape = T.StructType([states.schema[n] for n in names] + [T.StructField(f"s{i}", e) for i, e in enumerate(ends)])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, run, done, types = None, [], [], None

        def ended():
            return (*key[1], *[a.finish(a.merge([s[i] for s in run])) for i, a in enumerate(users)])

        for batch in batches:
            types = [batch.schema.field(n).type for n in names] + kinds
            for row in zip(*[c.to_pylist() for c in batch.columns]) if batch.num_columns else ():
                values, state = row[:len(names)], row[len(names):]
                same = _token(values)
                if key is not None and key[0] != same:
                    done.append(ended())
                    run = []
                key = (same, values)
                run.append(state)
                if len(run) == RUN:
                    run = [tuple(a.merge([s[i] for s in run]) for i, a in enumerate(users))]
                if len(done) == HELD:
                    yield _batch(done, shape.names, types)
                    done = []
        if key is not None:
            yield _batch([*done, ended()], shape.names, types)

    dealt = states.repartition(*names).sortWithinPartitions(*names) if names else states.repartition(1)
    found = dealt.mapInArrow(close, shape)
    return found.select(*[F.col(n).alias(k) for n, k in zip(names, keys)],
                        *[F.col(f"s{i}").alias(n) for i, n in enumerate(aggregates)])


def _states(df: DataFrame, keys: list[str], users: list[UserAggregate]) -> DataFrame:
    """(k0 and more, s0 and more): the states that tasks pass on."""
    names = [f"k{i}" for i in range(len(keys))]
    read = sorted({c for a in users for c in a.columns})
    floating = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    one = lambda c: F.when(F.isnan(c), F.lit(float("nan"))).otherwise(F.col(c) + F.lit(0.0)) if c in floating else F.col(c)
    rows = df.select(*[one(c).alias(n) for c, n in zip(keys, names)], *[F.col(c).alias(f"v{i}") for i, c in enumerate(read)],
                     *([] if read else [F.lit(True).alias("v0")]))
    starts = [T._parse_datatype_string(a.state) for a in users]
    kinds = [to_arrow_type(s) for s in starts]
    shape = T.StructType([rows.schema[n] for n in names] + [T.StructField(f"s{i}", s) for i, s in enumerate(starts)])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, types = {}, None

        def passed_on():
            return _batch([(*k, *[a.merge([s[i] for s in run]) for i, a in enumerate(users)]) for k, run in held.values()], shape.names, types)

        for batch in batches:
            types = [batch.schema.field(n).type for n in names] + kinds
            for part in _groups(batch, names):
                key = tuple(part.column(i)[0].as_py() for i in range(len(names)))
                inputs = {c: part.column(len(names) + i) for i, c in enumerate(read)}
                state = tuple(a.reduce(pa.RecordBatch.from_pydict({c: inputs[c] for c in a.columns})) for a in users)
                run = held.setdefault(_token(key), (key, []))[1]
                run.append(state)
                if len(run) == RUN:
                    run[:] = [tuple(a.merge([s[i] for s in run]) for i, a in enumerate(users))]
            if len(held) > HELD:
                yield passed_on()
                held = {}
        if held:
            yield passed_on()

    return rows.mapInArrow(partial, shape)


def _groups(batch: pa.RecordBatch, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of each key of a batch, in their order."""
    if not batch.num_rows:
        return
    code = np.zeros(batch.num_rows, np.int64)
    for name in names:
        own = batch.column(name).dictionary_encode(null_encoding="encode")
        code = np.unique(code * len(own.dictionary) + own.indices.to_numpy(), return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    ordered, cuts = batch.take(pa.array(order)), np.flatnonzero(np.diff(code[order])) + 1
    for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        yield ordered.slice(start, end - start)


def _token(key: tuple) -> tuple:
    """A key that equals itself also where it holds NaN."""
    return tuple(("NaN",) if v != v else v for v in key)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def distinct_texts(column: str, sep: str = "/") -> UserAggregate:
    """The distinct values as text, sorted and joined by ``sep``; nulls are left out. The state is the set of values."""
    def texts(batch):
        found = batch.column(0).cast(pa.string()).unique().drop_null()
        return {"texts": found.to_pylist()}

    return UserAggregate([column], "texts ARRAY<STRING>", "STRING", texts,
                         lambda states: {"texts": list({t for s in states for t in s["texts"]})},
                         lambda state: sep.join(sorted(state["texts"])))


def skewness(column: str) -> UserAggregate:
    """Third central moment over the 1.5th power of the second; null if all values are equal. Nulls, NaN and infinite values are left out.

    The state holds count, mean and sums of squared and cubed deviations, each from its own mean, so far-off means cost no digits.
    """
    def moments(x):
        if not len(x):
            return {"n": 0, "mean": 0.0, "m2": 0.0, "m3": 0.0}
        mean = float(x.mean())
        away = x - mean
        return {"n": len(x), "mean": mean, "m2": float((away ** 2).sum()), "m3": float((away ** 3).sum())}

    def reduced(batch):
        x = batch.column(0).cast(pa.float64()).drop_null().to_numpy(zero_copy_only=False)
        return moments(x[np.isfinite(x)])

    def merged(states):
        n = sum(s["n"] for s in states)
        if not n:
            return states[0]
        mean = sum(s["n"] * s["mean"] for s in states) / n
        m2 = m3 = 0.0
        for s in states:
            d = s["mean"] - mean
            m2 += s["m2"] + s["n"] * d * d
            m3 += s["m3"] + 3 * d * s["m2"] + s["n"] * d ** 3
        return {"n": n, "mean": mean, "m2": m2, "m3": m3}

    def finished(state):
        return state["m3"] / state["n"] / (state["m2"] / state["n"]) ** 1.5 if state["m2"] > 0 else None

    return UserAggregate([column], "n BIGINT, mean DOUBLE, m2 DOUBLE, m3 DOUBLE", "DOUBLE", reduced, merged, finished)

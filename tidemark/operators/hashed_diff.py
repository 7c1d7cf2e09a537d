"""Comparison of two frames by digests of their parts: only parts that differ are joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.compare import frame_diffs
from tidemark.session import stored

#: Parts of a level.
PARTS = 4096
#: Rows of both frames whose hashes a task sums by fine part.
FINE_ROWS = 500_000


def _hash(columns: list[str], salt: int) -> Column:
    """A hash of columns that tells null from absent, over the texts that the comparison reads."""
    parts = [x for c in columns for x in (F.col(c).isNull(), F.col(c).cast("string"))]
    return F.xxhash64(F.lit(salt), *parts)


def _unequal(a: DataFrame, b: DataFrame, part: Column, columns: list[str], tasks: int | None = None) -> DataFrame:
    """The parts whose digests differ, as (part, rows).

    A digest is the number of rows and the sums of the halves of two hashes: the same in any row order, and changed by a repeated
    row. Rows of ``b`` count negative, so a part is equal when its sums are 0, and one aggregate serves both frames. With ``tasks``
    the hashes are dealt to so many tasks before they are summed, for parts of so few rows that sums inside the tasks do not shrink them.
    """
    sides = [
        df.select(part.alias("part"), F.lit(sign).cast("long").alias("n"), *[_hash(columns, salt).alias(f"h{salt}") for salt in (1, 2)])
        for df, sign in ((a, 1), (b, -1))
    ]
    signed = sides[0].union(sides[1])
    if tasks is not None:
        signed = signed.repartition(tasks, "part")
    # halves, as sums of whole hashes would not fit a long
    halves = {f"{h}{side}": half for h in ("h1", "h2") for side, half in (
        ("low", F.col(h).bitwiseAND(F.lit((1 << 32) - 1))), ("high", F.shiftright(h, 32)))}
    sums = {"n": F.col("n"), **{name: F.col("n") * half for name, half in halves.items()}}
    told = signed.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), *[F.sum(v).alias(f"sum_{c}") for c, v in sums.items()])
    return told.where(" OR ".join(f"sum_{c} <> 0" for c in sums)).select("part", "rows")


def frame_diffs_hashed(a: DataFrame, b: DataFrame, keys: list[str], joined: list[int] | None = None) -> DataFrame:
    """The rows of ``frame_diffs``, without a shuffle of the frames where they agree.

    Rows fall into parts by a hash of their keys. One aggregate digests ``PARTS`` parts of each frame, summed inside the tasks; the
    rows of parts that differ are digested again in ``PARTS`` finer parts each, and only the rows of fine parts that differ are
    joined. Each frame is read three times; what moves is the digests of coarse parts, the hashes of rows of those that differ, in tasks
    of about ``FINE_ROWS`` rows, and about a fine part per changed row. Digests are two sums of
    64-bit hashes and a count, so a changed part is missed with a chance near 2^-128. ``joined`` receives the
    number of rows joined. Key columns of one name need one type. Keys are meant to be unique: where both frames hold the same rows of
    a repeated key, nothing is reported.
    """
    for k in keys:
        if a.schema[k].dataType != b.schema[k].dataType:
            raise ValueError(f"key {k} has two types")
    columns = [*keys, *[c for c in a.columns if c in b.columns and c not in keys]]
    coarse = F.pmod(_hash(keys, 0), F.lit(PARTS))
    fine = coarse * PARTS + F.pmod(F.shiftright(_hash(keys, 0), 20), F.lit(PARTS))
    found = _unequal(a, b, coarse, columns).collect()  # at most PARTS lines
    parts = [r.part for r in found]
    tasks = max(a.sparkSession.sparkContext.defaultParallelism, -(-sum(r.rows for r in found) // FINE_ROWS))
    a, b = (df.where(coarse.isin(parts) if parts else F.lit(False)) for df in (a, b))
    changed = stored(_unequal(a, b, fine, columns, tasks).select("part"))
    a, b = (df.join(changed, fine == F.col("part"), "left_semi") for df in (a, b))
    if joined is not None:
        joined.append(a.count() + b.count())
    return frame_diffs(a, b, keys)

"""A history of snapshots fed by file streams."""

from __future__ import annotations

import threading
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.compare import append_history

STREAM, BATCH, STORED = "stream", "batch", "_stored"


def stream_history(
    spark: SparkSession, source: str, history: str, schema: T.StructType | str, *,
    checkpoint: str, fmt: str = "parquet", files_per_batch: int | None = None, **options: str,
) -> StreamingQuery:
    """Append what is new in ``source`` to the history, one folder per stream and micro-batch.

    Stops when the files present at the start are read. The stream's id belongs to its checkpoint, so two checkpoints never
    share a folder, and a batch that is run again after a failure replaces its own folder only. Nothing else that is
    stored is rewritten: the duplicates of older batches are removed on reading, see ``read_history``.
    """
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    known = threading.Event()
    name: list[str] = []

    def store(batch: DataFrame, number: int) -> None:
        known.wait()
        stamped = batch.withColumn(STORED, F.current_timestamp())
        stamped.write.mode("overwrite").parquet(f"{history}/{STREAM}={name[0]}/{BATCH}={number}")

    query = (
        reader.load(source).writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    name.append(str(query.id))
    known.set()
    return query


def read_history(spark: SparkSession, history: str, dedup_old: bool = True) -> DataFrame:
    """The history: distinct rows of the earlier batches, then the batch stored last as it came."""
    place = [STORED, STREAM, BATCH]
    stored = spark.read.option("basePath", history).parquet(history)
    last = stored.agg(F.max(F.struct(*place)).alias("at")).first()["at"]
    is_last = (F.col(STREAM) == F.lit(last[STREAM])) & (F.col(BATCH) == F.lit(last[BATCH]))
    return append_history(stored.filter(~is_last).drop(*place), stored.filter(is_last).drop(*place), dedup_old)


FIRST, COPIES = "_first", "_copies"
#: Groups of rows with one state each; fixed for the life of a checkpoint.
BUCKETS = 256
_DIGEST = np.dtype([("h1", "<i8"), ("h2", "<i8")])


def _digests(pdf: pd.DataFrame) -> np.ndarray:
    found = np.empty(len(pdf), _DIGEST)
    found["h1"], found["h2"] = pdf["_h1"], pdf["_h2"]
    return found


def _first_seen(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The rows of one bucket in a micro-batch, a line per distinct one: their number, and whether an earlier micro-batch had them.

    The state is the sorted digests of all rows so far. The batch is read as a stream, of which the distinct rows are kept.
    """
    old = np.frombuffer(state.get[0], _DIGEST) if state.exists else np.empty(0, _DIGEST)
    rows, digest, copies = None, np.empty(0, _DIGEST), np.empty(0, np.int64)
    for pdf in batches:
        if pdf.empty:
            continue
        rows = pdf if rows is None else pd.concat([rows, pdf], ignore_index=True)
        digest, at, which = np.unique(np.concatenate([digest, _digests(pdf)]), return_index=True, return_inverse=True)
        copies = np.bincount(which, np.concatenate([copies, np.ones(len(pdf))]), len(digest)).astype(np.int64)
        rows = rows.iloc[at]
    if rows is None:
        return
    first = ~np.isin(digest, old)
    yield rows.assign(**{FIRST: first, COPIES: copies})
    if first.any():
        state.update((np.sort(np.concatenate([old, digest[first]])).tobytes(),))


def stream_distinct_history(
    spark: SparkSession, source: str, history: str, schema: T.StructType | str, *,
    checkpoint: str, fmt: str = "parquet", files_per_batch: int | None = None, **options: str,
) -> StreamingQuery:
    """A history of one stream that knows its old rows: keyed state tells which rows of a micro-batch are new.

    Rows are told apart by two hashes of all their columns, and ``BUCKETS`` groups of rows hold the hashes seen as a state each, so a
    micro-batch of any size calls Python at most that often and reads and writes the states of the buckets it meets. A micro-batch is stored as one line per distinct row with the number of its copies and whether
    it is the first of its kind, so ``read_distinct_history`` finds the distinct old rows by a filter. The state lives in the
    checkpoint: a query that starts again goes on from there, and a micro-batch that is run again replaces its own folder.
    """
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.load(source)
    columns = rows.columns
    keyed = rows.select("*", F.xxhash64(F.to_json(F.struct(*columns))).alias("_h1"), F.xxhash64(F.lit(1), F.to_json(F.struct(*columns))).alias("_h2")).withColumn("_bucket", F.pmod("_h1", F.lit(BUCKETS)))
    # as text, since pandas makes floats of whole numbers beside a null, and a null of NaN
    plain = {f.name: f.dataType for f in rows.schema if isinstance(f.dataType, (T.NumericType, T.BooleanType))}
    keyed = keyed.withColumns({c: F.col(c).cast("string") for c in plain})
    kept = T.StructType([*keyed.schema.fields, T.StructField(FIRST, T.BooleanType()), T.StructField(COPIES, T.LongType())])
    told = keyed.groupBy("_bucket").applyInPandasWithState(
        _first_seen, kept, T.StructType([T.StructField("seen", T.BinaryType())]), "append", GroupStateTimeout.NoTimeout)

    def store(batch: DataFrame, number: int) -> None:
        typed = batch.withColumns({c: F.col(c).cast(t) for c, t in plain.items()})
        typed.drop("_h1", "_h2", "_bucket").write.mode("overwrite").parquet(f"{history}/{BATCH}={number}")

    return (told.writeStream.foreachBatch(store).outputMode("append").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_distinct_history(spark: SparkSession, history: str) -> DataFrame:
    """Distinct rows of the earlier micro-batches, then the last one as it came; nothing is shuffled or compared."""
    kept = spark.read.option("basePath", history).parquet(history)
    last = kept.agg(F.max(BATCH)).first()[0]
    old, new = kept.where((F.col(BATCH) < last) & F.col(FIRST)), kept.where(F.col(BATCH) == last)
    again = new.withColumn(COPIES, F.explode(F.sequence(F.lit(1).cast("long"), F.col(COPIES))))
    return old.unionByName(again).drop(FIRST, COPIES, BATCH)

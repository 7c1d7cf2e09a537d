"""Session settings and the shared folder used for checkpoints and written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.checkpoint.compress": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE and skew-join handling on; ``conf`` wins over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster each
    machine would see its own one, so an unset folder is an error there.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="tidemark-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a table written by one job."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder, for plans that read it several times.

    It survives the loss of executors, and everything behind it is planned once.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Stored bytes behind a task of ``spread``.
SPREAD_BYTES = 8 << 20


def bounded_tasks(df: DataFrame) -> int:
    """As many tasks as cores, or more where a task would have over ``SPREAD_BYTES`` of the stored input of ``df``."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-size // SPREAD_BYTES))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, in tasks of a bounded share of its input, when it would be read in fewer.

    For work that costs far more per row than a shuffle, such as parsing pages or fitting models. Input
    that is split as finely already is returned as it is.
    """
    spark = df.sparkSession
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes"))
    tasks = bounded_tasks(df)
    return df.repartition(tasks) if size < tasks * split else df


def spread_rows(df: DataFrame, rows: int) -> DataFrame:
    """``df`` over all cores, in tasks of at most about ``rows`` rows: one count, and a shuffle.

    For fits that keep an object per row in memory, which says nothing of the bytes a row is stored in.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)))

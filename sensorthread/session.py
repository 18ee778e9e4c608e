"""Session settings and durable intermediate results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings the plans count on: adaptive execution splits the partitions of a hot join key, also where
# that costs one more shuffle further down. Small partitions are merged with restraint, as joins here may widen them.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128KB",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}

# What a task reads at most, in bytes, of files and of shuffles: rows here are wider than in files, so a task must hold many
# times that. Sessions may ask for less.
_READ_AT_ONCE = {
    "spark.sql.files.maxPartitionBytes": 16 << 20,
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": 24 << 20,
}


def apply_session_defaults(spark: SparkSession) -> SparkSession:
    for name, value in _DEFAULTS.items():
        spark.conf.set(name, value)
    settings = spark._jsparkSession.sessionState().conf()
    for name, most in _READ_AT_ONCE.items():
        if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(settings.getConfString(name)) > most:
            spark.conf.set(name, most)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see. Local sessions that name none get a scratch folder."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="sensorthread-")
    context.setCheckpointDir(folder)
    return folder


# Paths given out within the innermost `temporary` of this thread.
_given: ContextVar[list[str] | None] = ContextVar("_given", default=None)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other call has been given."""
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    given = _given.get()
    if given is not None:
        given.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Removes the intermediates of what runs within when it ends, also by an error. Only for work whose results are
    saved elsewhere by then. Other threads keep theirs."""
    own: list[str] = []
    token = _given.set(own)
    try:
        yield
    finally:
        _given.reset(token)
        for path in own:
            remove(spark, path)


def freeze(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later plans read the saved rows, so a lost executor cannot change them."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, for plans that read them more than once: they are computed
    once, each reader takes only its columns, and a lost executor costs a read. Runs a job."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

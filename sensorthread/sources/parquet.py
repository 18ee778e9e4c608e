"""Parquet files of conformed and combined readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorthread.functions.folders import type_folder
from sensorthread.operators.combine import combine
from sensorthread.operators.maps import source_iot
from sensorthread.schema import TYPE_FOLDER

PLACE = ["device_type", "device_id", "location"]


def write_adjusted(df: DataFrame, path: str) -> None:
    """One conformed source."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_combined(df: DataFrame, path: str) -> None:
    """The combined readings; writing nothing is an error. Rows are dealt by ranges of device type, device and time, which
    split a hot type among tasks, into folders by type: a reader of one type lists one folder, and skips what is
    of other types or devices there by its statistics."""
    if df.isEmpty():
        raise ValueError("the combined dataset is empty; check that the sources hold data")
    if "device_type" not in df.columns:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return
    order = [TYPE_FOLDER, *[c for c in ("device_type", "device_id", "result_time") if c in df.columns]]
    placed = df.withColumn(TYPE_FOLDER, type_folder(F.col("device_type")))
    arranged = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    arranged.write.mode("overwrite").option("compression", "zstd").partitionBy(TYPE_FOLDER).parquet(path)


def read_combined(spark: SparkSession, paths: list[str], device_type: str | None = None) -> DataFrame:
    """Conformed or combined readings from several paths, united by column name; of one device type if it is given, which
    opens only the folder of that type."""
    frames = [spark.read.parquet(p) for p in paths]
    if device_type is not None:
        frames = [source_iot(df, device_type) for df in frames]
    return combine([df.drop(TYPE_FOLDER) for df in frames])


def add_places(readings: DataFrame, path: str) -> DataFrame:
    """The table of distinct (device_type, device_id, location) beside the combined readings, with what these readings add
    to it. It is all that the maps need of readings, and grows with devices and places, not with readings."""
    spark = readings.sparkSession
    found = readings.select(*PLACE).distinct()
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        known = spark.read.parquet(path)
        same = [found[c].eqNullSafe(known[c]) for c in PLACE]
        found = found.join(known, same, "left_anti")
    found.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)

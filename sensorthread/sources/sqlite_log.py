"""Event logs in SQLite files, read by ranges of row numbers.

The file must lie where every executor can open it. Each task opens it read-only and streams one range.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from datetime import datetime, timezone
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import (
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

from sensorthread.operators.log import EventLog

ROWS_PER_TASK = 500_000
ROWS_PER_BATCH = 20_000


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"{Path(path).absolute().as_uri()}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _column_type(declared: str):
    """Spark type for a declared column type, by the file format's own affinity rules, plus times."""
    name = declared.upper()
    if "TIME" in name or "DATE" in name:
        return TimestampNTZType()
    if "INT" in name:
        return LongType()
    if any(part in name for part in ("REAL", "FLOA", "DOUB", "NUMERIC", "DECIMAL")):
        return DoubleType()
    return StringType()


def _time(value: str) -> datetime:
    parsed = datetime.fromisoformat(str(value).strip())
    return parsed.astimezone(timezone.utc).replace(tzinfo=None) if parsed.tzinfo else parsed


def _whole(value) -> int:
    whole = int(value)
    if whole != value and str(whole) != str(value).strip():
        raise ValueError(f"{value!r} in a column of whole numbers")
    return whole


_CONVERT = {
    TimestampNTZType: (_time, pa.timestamp("us")),
    LongType: (_whole, pa.int64()),
    DoubleType: (float, pa.float64()),
    StringType: (str, pa.string()),
}


class RowRange(InputPartition):
    def __init__(self, first: int | None, last: int | None):
        self.first = first
        self.last = last


class SqliteTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> StructType:
        with _open(self.options["path"]) as connection:
            columns = connection.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        return StructType([StructField(c[1], _column_type(c[2] or "")) for c in columns])

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(self.options, schema)


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path = options["path"]
        self.table = options["table"]
        self.rows_per_task = int(options.get("rowsPerTask", ROWS_PER_TASK))
        self.columns = schema

    def partitions(self) -> list[InputPartition]:
        with _open(self.path) as connection:
            try:
                low, high = connection.execute(
                    f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}"
                ).fetchone()
            except sqlite3.OperationalError:
                # A table declared WITHOUT ROWID has no numbers to cut by.
                return [RowRange(None, None)]
        if low is None:
            return [RowRange(1, 0)]
        step = self.rows_per_task
        return [RowRange(at, min(at + step - 1, high)) for at in range(low, high + 1, step)]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        names = ", ".join(_quoted(f.name) for f in self.columns)
        query, bounds = f"SELECT {names} FROM {_quoted(self.table)}", ()
        if partition.first is not None:
            query, bounds = f"{query} WHERE rowid BETWEEN ? AND ?", (partition.first, partition.last)
        converters = [_CONVERT[type(f.dataType)] for f in self.columns]
        arrow = pa.schema([(f.name, kind) for f, (_, kind) in zip(self.columns, converters)])
        with _open(self.path) as connection:
            cursor = connection.execute(query, bounds)
            while rows := cursor.fetchmany(ROWS_PER_BATCH):
                arrays = [
                    pa.array([None if v is None else convert(v) for v in column], kind)
                    for column, (convert, kind) in zip(zip(*rows), converters)
                ]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)


def read_sqlite_log(spark: SparkSession, path: str, rows_per_task: int = ROWS_PER_TASK) -> EventLog:
    """All tables of a log file, by name."""
    spark.dataSource.register(SqliteTable)
    with _open(path) as connection:
        tables = connection.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name").fetchall()
    reader = spark.read.format("sqlite_table").option("path", path).option("rowsPerTask", rows_per_task)
    return EventLog({name: reader.option("table", name).load() for (name,) in tables if not name.startswith("sqlite_")})

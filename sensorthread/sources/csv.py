"""CSV files of readings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorthread.functions.clock import read_time, read_time_as
from sensorthread.schema import TYPE_LABELS
from sensorthread.session import written
from sensorthread.sources.csv_records import csv_records

# Texts that are a date, or a date and a time.
_DATE_LIKE = r"^\s*\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?\s*$"


def _header(spark: SparkSession, path: str, multi_line: bool) -> list[str]:
    # Without inference only the first record is looked at.
    return spark.read.options(header=True, multiLine=multi_line, escape='"').csv(path).columns


def csv_columns(spark: SparkSession, path: str) -> list[str]:
    return _header(spark, path, False)


def _as_text(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """All columns as text. Quoted line breaks need `multi_line`: records are then put together first."""
    if not multi_line:
        return spark.read.options(header=True, escape='"').csv(path)
    names = _header(spark, path, True)
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    fields = F.from_csv("record", schema, {"escape": '"', "multiLine": "true"})
    return csv_records(spark, path).select(fields.alias("r")).select("r.*").toDF(*names)


def parsed_once(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """The columns as text in a Parquet table of the shared folder, which all later jobs read in place of the CSV."""
    text = _as_text(spark, path, multi_line)
    # By number: names of CSV columns may be any text.
    return written(text.toDF(*map(str, range(len(text.columns)))), "csv-text").toDF(*text.columns) if text.columns else text


def _type_tests(columns: list[str]) -> list[Column]:
    """Aggregates per column and type label: whether every value can be read as that type."""

    def all_read(readable: Column, value: Column) -> Column:
        return F.bool_and(F.when(value.isNotNull(), readable))

    tests = []
    for i, name in enumerate(columns):
        value = F.col(f"`{name}`")
        whole = value.rlike(r"^\s*[+-]?\d+\s*$") & value.try_cast("long").isNotNull()
        number = value.try_cast("double").isNotNull() & value.rlike(r"\d|(?i)nan|inf")
        flag = F.lower(F.trim(value)).isin("true", "false")
        time = value.rlike(_DATE_LIKE) & read_time(F.trim(value)).isNotNull()
        tests += [
            all_read(test, value).alias(f"{label}_{i}")
            for label, test in (("Int64", whole), ("Float64", number), ("Boolean", flag), ("Datetime", time))
        ]
    return tests


def _tested_types(columns: list[str], found: Row) -> dict[str, T.DataType]:
    # A column without values reads as anything; it stays text.
    labels = ("Int64", "Float64", "Boolean", "Datetime")
    return {
        name: TYPE_LABELS[next((t for t in labels if found[f"{t}_{i}"]), "Utf8")] for i, name in enumerate(columns)
    }


def infer_types(text: DataFrame) -> T.StructType:
    """The narrowest type that every value can be read as. One aggregate over all rows, so no later value can differ."""
    types = _tested_types(text.columns, text.agg(*_type_tests(text.columns)).first())
    return T.StructType([T.StructField(name, dtype) for name, dtype in types.items()])


def _typed(name: str, dtype: T.DataType) -> Column:
    value = F.col(f"`{name}`")
    if isinstance(dtype, T.StringType):
        return value
    if isinstance(dtype, T.TimestampNTZType):
        return read_time(F.trim(value)).alias(name)
    return F.trim(value).cast(dtype).alias(name)


def read_iot_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """A CSV with types inferred from all of its rows."""
    text = parsed_once(spark, path, multi_line)
    return text.select(*[_typed(f.name, f.dataType) for f in infer_types(text)]) if text.columns else text


def _given(columns: list[str], dtypes: dict[str, str]) -> dict[str, str]:
    given = {c: label for c, label in dtypes.items() if c in columns}
    for label in given.values():
        if label not in TYPE_LABELS:
            raise ValueError(f"unsupported type {label!r}; use one of {', '.join(TYPE_LABELS)}")
    return given


def read_with_times(
    spark: SparkSession, path: str, dtypes: dict[str, str], formats: Iterable[str] = (), multi_line: bool = False
) -> tuple[DataFrame, list[str]]:
    """A CSV with the labelled columns of the given types and the others inferred. Columns labelled Datetime are read
    in ISO forms, then in the given ones; those without a single time stay text and are named in the second result,
    unless there are no rows. Labels of columns the file lacks are ignored.

    The file is parsed once, and one aggregate settles all types and times."""
    formats = tuple(formats)
    names = _header(spark, path, multi_line)
    given = _given(names, dtypes)
    times = [c for c in names if given.get(c) == "Datetime"]
    rest = [c for c in names if c not in given]
    text = parsed_once(spark, path, multi_line)
    if not names or not (times or rest):
        return text.select(*[_typed(c, TYPE_LABELS[given[c]]) for c in names]), []
    seen = [F.count(read_time_as(F.col(f"`{c}`"), formats)).alias(f"times_{i}") for i, c in enumerate(times)]
    found = text.agg(F.count(F.lit(1)).alias("rows"), *_type_tests(rest), *seen).first()
    types = _tested_types(rest, found) | {c: TYPE_LABELS[label] for c, label in given.items()}
    without = [c for i, c in enumerate(times) if found["rows"] and not found[f"times_{i}"]]

    def column(c: str) -> Column:
        if c in without:
            return F.col(f"`{c}`")
        return read_time_as(F.col(f"`{c}`"), formats).alias(c) if c in times else _typed(c, types[c])

    return text.select(*map(column, names)), without


def read_with_overrides(
    spark: SparkSession,
    path: str,
    dtypes: dict[str, str],
    multi_line: bool = False,
) -> tuple[DataFrame, list[str]]:
    """A CSV with the labelled columns of the given types and the others inferred. Columns labelled Datetime come
    as text and are named in the second result; labels of columns the file lacks are ignored."""
    text = parsed_once(spark, path, multi_line)
    given = _given(text.columns, dtypes)
    rest = [c for c in text.columns if c not in given]
    inferred = infer_types(text.select(*[F.col(f"`{c}`") for c in rest])) if rest else []
    types = {f.name: f.dataType for f in inferred}
    times = [c for c in text.columns if given.get(c) == "Datetime"]
    for c, label in given.items():
        types[c] = T.StringType() if label == "Datetime" else TYPE_LABELS[label]
    return text.select(*[_typed(c, types[c]) for c in text.columns]), times

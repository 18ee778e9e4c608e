"""Type labels, and the type that can hold two others."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import types as T


def type_label(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "Int64"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "Float64"
    if isinstance(dtype, T.BooleanType):
        return "Boolean"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "Datetime"
    return "Utf8"


_TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def widen(first: T.DataType, second: T.DataType) -> T.DataType:
    """The narrowest type that keeps the values of both; text where nothing else does."""
    if first == second:
        return first
    if isinstance(first, T.NullType):
        return second
    if isinstance(second, T.NullType):
        return first
    if isinstance(first, T.NumericType) and isinstance(second, T.NumericType):
        labels = {type_label(first), type_label(second)}
        if labels == {"Int64"}:
            return T.LongType()
        return T.DoubleType()
    if isinstance(first, _TIMES) and isinstance(second, _TIMES):
        return T.TimestampNTZType()
    return T.StringType()


def common_type(dtypes: Iterable[T.DataType]) -> T.DataType:
    result: T.DataType = T.NullType()
    for dtype in dtypes:
        result = widen(result, dtype)
    return T.StringType() if isinstance(result, T.NullType) else result

from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorthread.functions.aggregates import aggregate_name
from sensorthread.functions.clock import micros, time_bucket
from sensorthread.functions.conditions import Bound, Condition, threshold_predicate, value_predicate
from sensorthread.functions.labels import common_type, type_label, widen

TIMES = [
    datetime(1969, 12, 31, 23, 59, 59, 999999),
    datetime(1970, 1, 1),
    datetime(2000, 1, 3),
    datetime(2024, 3, 31, 2, 30, 0, 1),
    datetime(2024, 10, 27, 2, 59, 59, 999999),
]


@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin"])
def test_micros_do_not_depend_on_the_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(t,) for t in TIMES], "t timestamp_ntz")
        got = [r[0] for r in df.select(micros("t")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [round((t - datetime(1970, 1, 1)).total_seconds() * 10**6) for t in TIMES]


@pytest.mark.parametrize("width", [1, 7, 60, 1440, 10080])
def test_buckets_start_where_duckdb_starts_them(spark, width):
    df = spark.createDataFrame([(t,) for t in [*TIMES, None]], "t timestamp_ntz")
    got = [r[0] for r in df.select(time_bucket("t", width)).collect()]
    want = [
        duckdb.execute(f"SELECT time_bucket(INTERVAL {width} MINUTE, CAST(? AS TIMESTAMP))", [t]).fetchone()[0]
        for t in TIMES
    ]
    assert got == [*want, None]


def test_bucket_needs_a_width():
    with pytest.raises(ValueError):
        time_bucket(None, 0)


@pytest.fixture(scope="module")
def values(spark):
    rows = [("a", "1"), ("a", "5"), ("b", "0"), ("b", "5"), ("c", "-1"), ("c", "bad"), (None, "7"), ("a", None)]
    return spark.createDataFrame(rows, "property string, property_value string")


def kept(df, predicate):
    return sorted((r.property or "", r.property_value or "") for r in df.where(predicate).collect())


def test_and_binds_tighter_than_or(values):
    chain = [Condition("a"), Condition("b", upper=Bound(3)), Condition("b", lower=Bound(1), logic="AND")]
    assert kept(values, threshold_predicate(chain)) == [("a", ""), ("a", "1"), ("a", "5")]


def test_bounds(values):
    assert kept(values, threshold_predicate([Condition("a", lower=Bound(1))])) == [("a", "1"), ("a", "5")]
    assert kept(values, threshold_predicate([Condition("a", lower=Bound(1, strict=True))])) == [("a", "5")]
    assert kept(values, threshold_predicate([Condition("b", upper=Bound(0))])) == [("b", "0")]
    assert kept(values, threshold_predicate([Condition("b", upper=Bound("0", strict=True))])) == []
    assert kept(values, threshold_predicate([Condition("c", upper=Bound(0))])) == [("c", "-1")]


def test_conditions_without_a_property_are_skipped(values):
    chain = [Condition(None, lower=Bound(9)), Condition("b", lower=Bound(5), logic="AND")]
    assert kept(values, threshold_predicate(chain)) == [("b", "5")]
    assert len(kept(values, threshold_predicate([]))) == 8


def test_one_range_for_all(values):
    assert kept(values, value_predicate(Bound(5))) == [("", "7"), ("a", "5"), ("b", "5")]
    assert len(kept(values, value_predicate())) == 8


def test_labels():
    assert type_label(T.ShortType()) == "Int64"
    assert type_label(T.FloatType()) == "Float64"
    assert type_label(T.DateType()) == "Datetime"
    assert type_label(T.BinaryType()) == "Utf8"


def test_widening():
    assert widen(T.LongType(), T.DoubleType()) == T.DoubleType()
    assert widen(T.IntegerType(), T.LongType()) == T.LongType()
    assert widen(T.DoubleType(), T.StringType()) == T.StringType()
    assert widen(T.BooleanType(), T.LongType()) == T.StringType()
    assert common_type([T.NullType(), T.LongType()]) == T.LongType()
    assert common_type([]) == T.StringType()


def test_aggregate_names():
    assert aggregate_name("Mean") == "avg"
    with pytest.raises(ValueError):
        aggregate_name("drop table")


def test_predicate_leaves_text_that_is_no_number(values):
    assert values.where(F.col("property") == "c").count() == 2

import random
from csv import writer as csv_writer
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sensorthread.operators.combine import combine
from sensorthread.operators.profile import column_profile, preview, query_dataset, table_summary
from sensorthread.operators.reshape import pivot_first, stack_properties
from sensorthread.functions.clock import read_time
from sensorthread.plans.conform import Notice, Mapping, conform, ensure_location, parse_times, select_allowed, validate_mapping
from sensorthread.schema import CANONICAL_NAMES
from sensorthread.sources.csv import csv_columns, parsed_once, read_iot_csv, read_with_overrides, read_with_times
from sensorthread.sources.csv_records import _scanned
from sensorthread.sources.parquet import add_places, read_combined, write_adjusted, write_combined

CSV = """id,kind,at,spot,temp,hum,state,note
d1,t,2024-01-01 00:00:00,o1,20.5,40,true,x
d1,t,2024-01-01T01:00:00,o1,,41,false,y
d2,t,not a time,,21.0,42,,"a, b"
"""

NAMES = {"id": "device_id", "kind": "device_type", "at": "result_time", "spot": "location"}


@pytest.fixture()
def csv(tmp_path):
    path = tmp_path / "r.csv"
    path.write_text(CSV)
    return str(path)


def test_columns_and_inferred_types(spark, csv):
    assert csv_columns(spark, csv) == ["id", "kind", "at", "spot", "temp", "hum", "state", "note"]
    types = dict(read_iot_csv(spark, csv).dtypes)
    assert types["temp"] == "double" and types["hum"] == "bigint" and types["state"] == "boolean"
    assert types["at"] == "string" and types["note"] == "string"


def test_types_come_from_all_rows(spark, tmp_path):
    lines = "".join(f"{i},2024-01-01 10:00:00\n" for i in range(6_000))
    (tmp_path / "t.csv").write_text(f"a,b\n{lines}1.5,2024-01-01T10:00:00+02:00\n")
    df = read_iot_csv(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {"a": "double", "b": "timestamp_ntz"}
    assert df.where("a = 1.5 AND b = timestamp_ntz'2024-01-01 08:00:00'").count() == 1


def test_offsets_and_zones(spark):
    texts = ["2024-01-01T10:00:00+02:00", "2024-01-01T08:00:00Z", "2024-01-01 08:00:00", "2024-01-01 06:30:00-0130", "x"]
    df = spark.createDataFrame([(x,) for x in texts], "a string")
    got = [r[0] for r in df.select(read_time(F.col("a"))).collect()]
    assert got == [datetime(2024, 1, 1, 8)] * 4 + [None]


def test_a_column_without_values_is_text(spark, tmp_path):
    (tmp_path / "e.csv").write_text("a,b\n1,\n2,\n")
    assert dict(read_iot_csv(spark, str(tmp_path / "e.csv")).dtypes) == {"a": "bigint", "b": "string"}


def test_a_file_with_a_header_only(spark, tmp_path):
    (tmp_path / "e.csv").write_text("a,b\n")
    df = read_iot_csv(spark, str(tmp_path / "e.csv"))
    assert df.columns == ["a", "b"] and df.count() == 0


def test_overrides(spark, csv):
    df, times = read_with_overrides(spark, csv, {"hum": "Float64", "at": "Datetime", "absent": "Int64"})
    assert dict(df.dtypes)["hum"] == "double" and dict(df.dtypes)["at"] == "string"
    assert times == ["at"]
    with pytest.raises(ValueError):
        read_with_overrides(spark, csv, {"hum": "Decimal"})
    with pytest.raises(Exception):
        read_with_overrides(spark, csv, {"note": "Int64"})[0].collect()


def test_conform_keeps_nulls_and_widens(spark, csv):
    mapping = Mapping(NAMES | {"temp": "property", "hum": "property", "gone": "property"}, {"at": "Datetime"})
    df, warnings = conform(spark, csv, mapping)
    assert set(df.columns) == {*CANONICAL_NAMES, "property_value"}
    assert dict(df.dtypes)["property_value"] == "double"
    assert df.count() == 6 and df.where("property_value IS NULL").count() == 1
    assert df.where("result_time IS NULL").count() == 2
    assert Notice("absent_properties", ("gone",)) in warnings


def test_text_among_the_properties_makes_all_values_text(spark, csv):
    df, _ = conform(spark, csv, Mapping(NAMES | {"temp": "property", "note": "property"}))
    assert dict(df.dtypes)["property_value"] == "string" and df.count() == 6


def test_times_that_never_parse_stay_text(spark):
    df = spark.createDataFrame([("x", "31.12.2024 10:00"), ("y", None)], "a string, b string")
    out, warnings = parse_times(df, ["a", "b"])
    assert dict(out.dtypes)["a"] == "string" and warnings == [Notice("unread_times", ("a", "b"))]
    out, warnings = parse_times(df, ["b"], ["dd.MM.yyyy HH:mm"])
    assert not warnings and [r.b for r in out.collect()] == [datetime(2024, 12, 31, 10), None]


def test_mapping_must_cover_the_schema():
    full = NAMES | {"temp": "property"}
    validate_mapping(Mapping(full))
    with pytest.raises(ValueError, match="property"):
        validate_mapping(Mapping(NAMES))
    no_place = {k: v for k, v in full.items() if v != "location"}
    with pytest.raises(ValueError, match="location"):
        validate_mapping(Mapping(no_place))
    validate_mapping(Mapping(no_place, null_location=True))


def test_null_location(spark, csv):
    names = {k: v for k, v in NAMES.items() if v != "location"} | {"temp": "property"}
    df, warnings = conform(spark, csv, Mapping(names, null_location=True))
    assert df.where("location IS NULL").count() == 3 and warnings == [Notice("null_location", ("location",))]
    assert ensure_location(df, True)[1] == []


def test_long_layout_passes_through(spark, tmp_path):
    (tmp_path / "l.csv").write_text("id,kind,at,p,v\nd,t,2024-01-01 00:00:00,temp,1.5\n")
    names = {"id": "device_id", "kind": "device_type", "at": "result_time", "p": "property", "v": "property_value"}
    df, _ = conform(spark, str(tmp_path / "l.csv"), Mapping(names, null_location=True, layout="long"))
    row = df.first()
    assert (row.property, row.property_value) == ("temp", 1.5)


def test_select_keeps_input_order(spark):
    df = spark.createDataFrame([(1, 2, 3)], "location int, extra int, device_id int")
    assert select_allowed(df, CANONICAL_NAMES).columns == ["location", "device_id"]


def test_stack_and_pivot_are_inverse(spark):
    rows = [("o1", "d1", 1.0, 2.0), ("o2", "d2", None, 4.0), ("o3", "d3", 5.0, None)]
    wide = spark.createDataFrame(rows, "location string, device_id string, a double, b double")
    long = stack_properties(wide, ["a", "b"], ["location", "device_id"])
    back = pivot_first(long, ["location"])
    assert sorted(tuple(r) for r in back.collect()) == sorted((r[0], r[2], r[3]) for r in rows)


def test_combine_fills_and_widens(spark, tmp_path):
    one = spark.createDataFrame([("d1", 1)], "device_id string, property_value bigint")
    two = spark.createDataFrame([(2.5, "x")], "property_value double, note string")
    three = spark.createDataFrame([("z",)], "property_value string")
    df = combine([one, two])
    assert df.columns == ["device_id", "property_value", "note"]
    assert sorted(df.collect(), key=repr) == sorted([("d1", 1.0, None), (None, 2.5, "x")], key=repr)
    assert dict(combine([one, three]).dtypes)["property_value"] == "string"
    for i, source in enumerate([one, two]):
        write_adjusted(source, str(tmp_path / f"s{i}"))
    united = read_combined(spark, [str(tmp_path / "s0"), str(tmp_path / "s1")])
    write_combined(united, str(tmp_path / "all"))
    assert spark.read.parquet(str(tmp_path / "all")).count() == 2
    with pytest.raises(ValueError):
        combine([])
    with pytest.raises(ValueError):
        write_combined(one.where("false"), str(tmp_path / "none"))


def test_combined_readings_of_one_type_are_in_few_files(spark, tmp_path):
    rows = [(f"d{i % 37}", f"type{i % 100}" if i % 10 else None, i) for i in range(5000)]
    rows += [("hot", "type3", i) for i in range(5000)] + [("e", "", 1), ("n", "07", 2)]
    df = spark.createDataFrame(rows, "device_id string, device_type string, result_time long")
    path = str(tmp_path / "all")
    write_combined(df, path)
    back = read_combined(spark, [path])
    assert back.columns == df.columns and sorted(map(tuple, back.collect()), key=repr) == sorted(rows, key=repr)
    every = len({r[0] for r in back.select(F.input_file_name()).distinct().collect()})
    for kind in ("type7", "type3", "", "07", "absent"):
        one = read_combined(spark, [path], kind)
        assert sorted(map(tuple, one.collect())) == sorted(r for r in rows if r[1] == kind)
        plan = one._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(type_folder" in plan
        if kind == "type7":
            folders = {r[0].split("/")[-2] for r in one.select(F.input_file_name()).distinct().collect()}
            assert len(folders) == 1 and every > 60


def test_places_are_kept_up_to_date(spark, tmp_path):
    schema = "device_id string, device_type string, location string, x int"
    path = str(tmp_path / "places")
    first = [("d1", "a", "p", 1), ("d1", "a", "p", 2), ("d2", "a", None, 1), (None, None, None, 1)]
    assert add_places(spark.createDataFrame(first, schema), path).count() == 3
    more = [("d1", "a", "p", 3), (None, None, None, 2), ("d2", "a", "q", 1)]
    for _ in range(2):
        places = add_places(spark.createDataFrame(more, schema), path)
        assert sorted(map(tuple, places.collect()), key=repr) == sorted(
            [("a", "d1", "p"), ("a", "d2", None), (None, None, None), ("a", "d2", "q")], key=repr
        )


def test_profile_and_summary(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, `b c` string")
    rows = {r.name: (r.row_count, r.proposed_dtype, r.nulls) for r in column_profile(df).collect()}
    assert rows == {"a": (2, "Int64", 0), "b c": (2, "Utf8", 1)}
    summary = table_summary(df, 1)
    assert (summary["nrows"], summary["ncols"], len(summary["head"])) == (2, 2, 1)
    assert preview(df, 1).count() == 1


def test_adhoc_queries(spark):
    df = spark.range(20)
    assert query_dataset(df, "SELECT * FROM dataset", 5).count() == 5
    assert query_dataset(df, " with t as (select id from dataset where id < 3) select * from t limit 2;").count() == 2
    for bad in ("DROP VIEW dataset", "INSERT INTO x VALUES (1)"):
        with pytest.raises(ValueError):
            query_dataset(df, bad)
    with pytest.raises(Exception):
        query_dataset(df, "SELECT 1) AS q; DROP VIEW dataset; SELECT (1").collect()
    assert df.agg(F.count("id")).first()[0] == 20
    assert not spark.catalog.tableExists("dataset")


BROKEN = [
    'a,b,c\n1,"x\ny",2\n3,"say ""hi""\n\n, there",4\n5,,"\n"\n',  # breaks, doubled quotes, empty lines within
    '﻿"a\nb","c"\n"1","x"\n"2","\r\ny"\n',  # a header over lines, after a mark of the byte order
    'a,b\r\n1,"x\r\ny"\r\n\r\n2,z\r\n',
    'a,b\n1,5" pipe\n2,"q"\n3,6"\n"4\n","7"" "\n',  # quotes within unquoted fields open nothing
    'a,b\n1,"' + "\n".join(f"line {i}" for i in range(200)) + '"\n2,y',  # a record over many splits
    "a,b\n",
]


@pytest.mark.parametrize("content", BROKEN)
@pytest.mark.parametrize("split", [1 << 20, 64])
def test_quoted_line_breaks_in_many_tasks(spark, tmp_path, content, split):
    for i in range(2):
        (tmp_path / f"f{i}.csv").write_bytes(content.encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        df = parsed_once(spark, str(tmp_path), True)
        want = spark.read.options(header=True, multiLine=True, escape='"').csv(str(tmp_path))
        assert df.columns == want.columns
        # In files of \r\n lines, the reader to compare with changes those within quotes too.
        rows = [tuple(v and v.replace("\r\n", "\n") for v in r) for r in df.collect()]
        others = [tuple(v and v.replace("\r\n", "\n") for v in r) for r in want.collect()]
        assert sorted(rows, key=repr) == sorted(others, key=repr)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_random_records_in_many_tasks(spark, tmp_path):
    rng = random.Random(7)
    rows = [
        [str(i)] + ["".join(rng.choice(['"', "\n", ",", "x", "é", '""', "\r\n"]) for _ in range(rng.randrange(9))) for _ in "bc"]
        for i in range(400)
    ]
    with open(tmp_path / "r.csv", "w", newline="") as out:
        csv_writer(out, lineterminator="\n").writerows([["a", "b", "c"], *rows])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 200)
        lines = _scanned(spark, str(tmp_path / "r.csv"))
        assert lines.select("block").distinct().count() > 5
        got = parsed_once(spark, str(tmp_path / "r.csv"), True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.a, r.b or "", r.c or "") for r in got) == sorted(map(tuple, rows))


def test_a_file_is_parsed_once(spark, csv):
    df, unread = read_with_times(spark, csv, {"at": "Datetime", "kind": "Datetime", "hum": "Float64"}, ["dd.MM.yyyy"])
    assert unread == ["kind"] and dict(df.dtypes)["at"] == "timestamp_ntz" and dict(df.dtypes)["temp"] == "double"
    assert df.where("at IS NULL").count() == 1
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "FileScan csv" not in plan

import os
import sqlite3
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sensorthread.operators import persist
from sensorthread.operators.persist import Association
from sensorthread.plans.integrate import AGGREGATE, FILTER, Config, integrate
from sensorthread.functions.conditions import Bound
from sensorthread.schema import EVENT_LINK, EVENT_LINK_SCHEMA, LEDGER, OBJECT_LINK, OBJECT_LINK_SCHEMA, WORK_TABLES
from sensorthread.session import shared_folder
from sensorthread.sources.parquet import add_places
from sensorthread.sources.sqlite_log import read_sqlite_log
from sensorthread.sources.workspace import Conflict, Workspace, export_ocel, init_workspace
from tests.test_scenarios import READINGS, T0, at, make_log

PAYLOAD = "device_id string, location string, property string, property_value double, ocel_event_id string, result_time timestamp_ntz"
CHANGES = "ocel_id string, ocel_time timestamp_ntz, ocel_changed_field string, temp double"


def counts(write):
    return tuple(write.counts.first())


def test_object_attributes_are_inserted_once(spark):
    payload = spark.createDataFrame(
        [
            ("d2", "o1", "temp", 5.0, None, T0),
            ("d1", "o1", "temp", 7.0, None, T0),
            ("d1", "o1", "Hum", 1.0, None, T0),
            ("d1", "o2", "temp", None, None, T0),
            ("d1", "o2", None, 3.0, None, T0),
            ("d1", "o3", "temp", 9.0, None, T0),
        ],
        PAYLOAD,
    )
    table = spark.createDataFrame([("o3", T0, "temp", 1.0), ("o1", T0, None, None)], CHANGES)
    first = persist.insert_object_attributes(table, payload)
    assert counts(first) == (2, 1)
    assert first.table.columns == ["ocel_id", "ocel_time", "ocel_changed_field", "temp", "Hum"]
    new = {(r.ocel_id, r.ocel_changed_field): (r.temp, r.Hum) for r in first.table.collect()}
    assert new == {("o3", "temp"): (1.0, None), ("o1", None): (None, None), ("o1", "temp"): (7.0, None), ("o1", "Hum"): (None, 1.0)}
    again = persist.insert_object_attributes(first.table, payload)
    assert counts(again) == (0, 3) and again.table.count() == first.table.count()


def test_a_null_place_is_never_there_yet(spark):
    payload = spark.createDataFrame([("d1", None, "temp", 5.0, None, T0)], PAYLOAD)
    table = persist.insert_object_attributes(spark.createDataFrame([], CHANGES), payload).table
    assert counts(persist.insert_object_attributes(table, payload)) == (1, 0)


def test_property_columns_match_without_case(spark):
    payload = spark.createDataFrame([("d1", "o1", "TEMP", 5.0, None, T0)], PAYLOAD)
    out = persist.insert_object_attributes(spark.createDataFrame([], CHANGES), payload).table
    assert out.columns == ["ocel_id", "ocel_time", "ocel_changed_field", "temp"]
    assert tuple(out.first())[2:] == ("TEMP", 5.0)


def test_event_attributes_fill_empty_cells(spark):
    payload = spark.createDataFrame(
        [
            ("d1", "o", "temp", 5.0, "e1", T0),
            ("d1", "o", "hum", 6.0, "e1", T0),
            ("d1", "o", "temp", 7.0, "e2", T0),
            ("d1", "o", "temp", 8.0, "gone", T0),
        ],
        PAYLOAD,
    )
    table = spark.createDataFrame([("e1", 1.0), ("e2", 2.0), ("e3", None)], "ocel_id string, temp double")
    write = persist.fill_event_attributes(table, payload)
    assert sorted(map(tuple, write.table.select("ocel_id", "temp", "hum").collect())) == [
        ("e1", 1.0, 6.0),
        ("e2", 2.0, None),
        ("e3", None, None),
    ]
    assert counts(write) == (1, 1)
    again = persist.fill_event_attributes(write.table, payload)
    assert counts(again) == (0, 2) and again.table.count() == 3


def test_event_links(spark):
    payload = spark.createDataFrame(
        [("d1", "o", "temp", 5.0, "e1", T0), ("d1", "o", "hum", 5.0, "e1", T0), ("d2", "o", "x", 1.0, None, T0)], PAYLOAD
    )
    links = spark.createDataFrame([], EVENT_LINK_SCHEMA)
    write = persist.event_links(links, payload, "q")
    assert list(map(tuple, write.table.collect())) == [("e1", "d1", "q")] and counts(write) == (1, 0)
    assert counts(persist.event_links(write.table, payload, "q")) == (0, 1)
    assert counts(persist.event_links(write.table, payload, "other")) == (1, 0)


def test_object_links_by_association(spark):
    events = spark.createDataFrame([("e1", "go"), ("e2", "stop")], "ocel_id string, ocel_type string")
    payload = spark.createDataFrame(
        [("d1", "o1", "x", 1.0, "e1", T0), ("d1", "o1", "y", 1.0, "e1", T0), ("d2", "o1", "x", 1.0, "e2", T0)], PAYLOAD
    )
    links = spark.createDataFrame([], OBJECT_LINK_SCHEMA)
    write = persist.object_links(links, payload, [Association("a", "go"), Association("b")], events)
    got = sorted((r.ocel_IoT_object_id, r.ocel_qualifier) for r in write.table.collect())
    assert got == [("d1", "a"), ("d1", "b"), ("d2", "b")] and counts(write) == (3, 0)
    same = persist.object_links(links, payload, [Association("a", "go"), Association("a")], events)
    assert counts(same) == (2, 1) and same.table.count() == 2
    plain = persist.object_links(links, payload, [])
    assert counts(plain) == (2, 0)
    assert counts(persist.object_links(plain.table, payload, [])) == (0, 2)


@pytest.fixture()
def small(spark):
    log = make_log(
        spark,
        [("e1", "go", 60), ("e2", "go", 120)],
        [("e1", "o1"), ("e2", "o2")],
        [("o1", "truck"), ("o2", "truck"), ("o3", "yard")],
    )
    rows = [
        ("d1", "gauge", "o1", "temp", 5.0, at(60)),
        ("d1", "gauge", "o1", "temp", 6.0, at(70)),
        ("d2", "gauge", "o2", "temp", 7.0, at(100)),
        ("d2", "gauge", "o2", "hum", 8.0, at(10)),
        ("d3", "cam", None, "seen", 1.0, at(60)),
    ]
    return log, spark.createDataFrame(rows, READINGS)


def workspace(spark, tmp_path, log):
    ws = Workspace(spark, str(tmp_path / "ws"))
    assert init_workspace(log, ws) and not init_workspace(log, ws)
    return ws


def test_a_run_leaves_no_intermediates(spark, tmp_path, small):
    log, readings = small
    ws = workspace(spark, tmp_path, log)
    folder = shared_folder(spark)

    def tables():
        return {p for p in os.listdir(folder) if "-" in p and not p.count("-") == 4}

    before = tables()
    integrate(readings, ws, Config("gauge", "truck", associations=(Association("on", "go"),)))
    integrate(readings, ws, Config("gauge", "go", attribute_type="2"))
    assert tables() == before


def test_a_failed_write_does_no_harm(spark, tmp_path, small):
    log, _ = small
    ws = workspace(spark, tmp_path, log)
    bad = spark.createDataFrame([("x",)], "a string").select(F.col("a").cast("int"))
    with pytest.raises(Exception):
        ws.commit({"extra": bad})
    good = spark.createDataFrame([(1,)], "a int")
    assert ws.commit({"extra": good})["extra"].count() == 1


def folders(ws):
    return {os.path.join(d, f) for kind in ("tables", "cells") for d, fs, _ in os.walk(f"{ws.root}/{kind}") for f in fs}


def test_a_run_that_fails_halfway_leaves_the_log_as_it_was(spark, tmp_path, small, monkeypatch):
    log, readings = small
    ws = workspace(spark, tmp_path, log)
    before, there = ws._manifest(), {f for f in folders(ws)}

    def fail(*_):
        raise OSError("lost")

    for step in ("event_links", "tick_ledger", "fill_event_attributes"):
        with monkeypatch.context() as m:
            m.setattr(persist, step, fail)
            with pytest.raises(OSError):
                integrate(readings, ws, Config("gauge", "go", attribute_type="2"))
        assert ws._manifest() == before and {f for f in folders(ws) if "/" in f and len(os.path.basename(f)) == 32} == {
            f for f in there if len(os.path.basename(f)) == 32
        }
    assert integrate(readings, ws, Config("gauge", "go", attribute_type="2")).main_inserted == 2
    assert ws._manifest()[0] == before[0] + 1


def test_a_run_is_one_version(spark, tmp_path, small):
    log, readings = small
    ws = workspace(spark, tmp_path, log)
    for n, config in enumerate([Config("gauge", "go", attribute_type="2"), Config("gauge", "truck", selected_type="truck")]):
        integrate(readings, ws, config)
        number, paths = ws._manifest()
        assert number == n + 2 and {"processed_iot_payload", LEDGER} <= set(paths)


def test_a_table_of_places_gives_the_same_runs(spark, tmp_path, small):
    log, readings = small
    places = add_places(readings, str(tmp_path / "places"))
    for i, config in enumerate(
        [
            Config("gauge", "truck", selected_type="truck"),
            Config("gauge", "truck", associations=(Association("on", "go"),)),
            Config("gauge", "go", attribute_type="2", logic=AGGREGATE, func="sum", window=200),
            Config("cam", "go", attribute_type="2"),
        ]
    ):
        results, tables = [], []
        for given in (None, places):
            (tmp_path / f"{i}{given is None}").mkdir()
            ws = workspace(spark, tmp_path / f"{i}{given is None}", log)
            results.append(integrate(readings, ws, config, given))
            tables.append({n: sorted(map(tuple, df.collect()), key=repr) for n, df in ws.read().items() if n != LEDGER})
        assert results[0] == results[1] and tables[0] == tables[1]


def test_links_are_looked_up_in_their_folders(spark, tmp_path, small):
    log, _ = small
    ws = workspace(spark, tmp_path, log)
    columns = ["concat('e', id) AS ocel_event_id", "'d' AS ocel_IoT_object_id", "'q' AS ocel_qualifier"]
    ws.commit({}, {EVENT_LINK: spark.range(3000).selectExpr(*columns)})
    links = ws.begin().links(EVENT_LINK)
    payload = spark.createDataFrame([("d", "o", "x", 1.0, e, T0) for e in ("e7", "e8", "new", None)], PAYLOAD)
    write = persist.event_links(links, payload, "q")
    assert counts(write) == (1, 2) and write.table.columns == ["ocel_event_id", "ocel_IoT_object_id", "ocel_qualifier"]
    assert write.table.count() == 3001 and ws.read()[EVENT_LINK].columns == write.table.columns

    def files(df):
        return df.select(F.input_file_name()).distinct().count()

    some = persist.in_folders_of(links, payload.where("ocel_event_id IS NOT NULL"), "ocel_event_id")
    assert files(links) > 200 and files(some) <= 9
    # Links of a log that was not written here have no folders and are all read.
    old = links.drop("key_folder").where("ocel_event_id = 'e8'").withColumn("key_folder", F.lit(None).cast("string"))
    assert counts(persist.event_links(old, payload, "q")) == (2, 1)


def test_of_many_writers_one_wins(spark, tmp_path, small):
    log, _ = small
    ws = workspace(spark, tmp_path, log)
    rows = spark.createDataFrame([(1,)], "a int")
    changes = [Workspace(spark, ws.root).begin() for _ in range(6)]
    for change in changes:
        change.add("extra", rows)

    def commit(change):
        with change:
            try:
                change.commit()
                return True
            except Conflict:
                return False

    with ThreadPoolExecutor(6) as pool:
        assert sum(pool.map(commit, changes)) == 1
    assert ws.read()["extra"].count() == 1 and ws._manifest()[0] == 2
    assert len(os.listdir(f"{ws.root}/tables/extra")) == 1


def test_runs_in_threads_keep_their_intermediates(spark, tmp_path, small):
    log, readings = small
    spaces = []
    for i in range(3):
        (tmp_path / str(i)).mkdir()
        spaces.append(workspace(spark, tmp_path / str(i), log))
    config = Config("gauge", "go", attribute_type="2", logic=AGGREGATE, func="median", window=200)
    with ThreadPoolExecutor(3) as pool:
        results = list(pool.map(lambda ws: integrate(readings, ws, config), spaces))
    assert [r.main_inserted for r in results] == [2, 2, 2]


def test_filled_cells_cost_their_own_size(spark, tmp_path, small):
    log, readings = small
    events = spark.range(200_000).selectExpr("concat('x', id) AS ocel_id", "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS ocel_time", "rand(1) AS weight")
    log["event_go"] = log["event_go"].withColumn("weight", F.lit(1.0)).unionByName(events)
    ws = workspace(spark, tmp_path, log)

    def size():
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(ws.root) for f in fs)

    before = size()
    assert before > 1_000_000
    result = integrate(readings, ws, Config("gauge", "go", attribute_type="2", logic=AGGREGATE, func="max", window=200))
    assert result.main_inserted == 2 and size() - before < 50_000
    table = ws.read()["event_go"]
    assert table.columns == ["ocel_id", "ocel_time", "weight", "hum", "temp"] and table.count() == 200_002
    want = [("e1", 1.0, None, 5.0), ("e2", 1.0, 8.0, 7.0)]
    shown = lambda: sorted(map(tuple, ws.read()["event_go"].where("ocel_id LIKE 'e%'").select("ocel_id", "weight", "hum", "temp").collect()))
    assert shown() == want
    again = integrate(readings, ws, Config("gauge", "go", attribute_type="2", logic=AGGREGATE, func="min", window=200))
    assert (again.main_inserted, again.main_skipped) == (0, 2) and shown() == want
    assert any(p.startswith("cells/") for p in ws._manifest()[1]["event_go"])
    ws.compact()
    assert shown() == want and len(ws._manifest()[1]["event_go"]) == 1


def test_two_writers_and_compaction(spark, tmp_path, small):
    log, _ = small
    ws = workspace(spark, tmp_path, log)
    other = Workspace(spark, ws.root)
    read = ws._manifest()
    rows = spark.createDataFrame([(1,)], "a int")
    other.commit({"extra": rows})
    ws._manifest = iter([read, Workspace(spark, ws.root)._manifest()]).__next__
    with pytest.raises(RuntimeError):
        ws.commit({"extra": rows})
    ws = Workspace(spark, ws.root)
    for _ in range(3):
        ws.commit({}, {"extra": rows})
    assert len(ws._manifest()[1]["extra"]) == 4 and ws.read()["extra"].count() == 4
    assert ws.compact()["extra"].count() == 4 and len(ws._manifest()[1]["extra"]) == 1


def test_readings_at_events_need_an_event(spark, tmp_path, small):
    log, readings = small
    ws = workspace(spark, tmp_path, log)
    before = ws._manifest()
    with pytest.raises(ValueError):
        integrate(readings, ws, Config("cam", "truck", associations=(Association("on", "go"),)))
    assert ws._manifest() == before


def test_object_run_twice(spark, tmp_path, small):
    log, readings = small
    ws = workspace(spark, tmp_path, log)
    config = Config("gauge", "truck", selected_type="truck", qualifier="on")
    first = integrate(readings, ws, config)
    assert (first.status, first.main_inserted, first.links_inserted) == ("success", 4, 4)
    assert not first.all_done
    second = integrate(readings, ws, config)
    assert (second.status, second.main_skipped, second.links_skipped) == ("warning", 4, 4)
    after = ws.read()
    assert after["object_truck"].count() == 2 + 4 and after[OBJECT_LINK].count() == 4
    assert [(r.device_type, r.ocel_type) for r in after[LEDGER].collect()] == [("gauge", "truck")]
    exported = export_ocel(ws, str(tmp_path / "out"))
    assert not set(exported) & set(WORK_TABLES) and exported["object_truck"].count() == 6


def test_at_events_run(spark, tmp_path, small):
    log, readings = small
    ws = workspace(spark, tmp_path, log)
    config = Config("gauge", "truck", associations=(Association("during", "go"),))
    result = integrate(readings, ws, config)
    assert (result.main_inserted, result.links_inserted) == (1, 1)
    link = ws.read()[OBJECT_LINK].first()
    assert tuple(link) == ("o1", "d1", "during", at(60))


def test_event_runs(spark, tmp_path, small):
    log, readings = small
    ws = workspace(spark, tmp_path, log)
    result = integrate(readings, ws, Config("gauge", "go", attribute_type="2", logic=FILTER, lower=Bound(6)))
    assert (result.main_inserted, result.links_inserted) == (1, 1)
    result = integrate(readings, ws, Config("gauge", "go", attribute_type="2", logic=AGGREGATE, func="max", window=200))
    got = sorted(map(tuple, ws.read()["event_go"].select("ocel_id", "temp", "hum").collect()))
    assert got == [("e1", 5.0, None), ("e2", 7.0, 8.0)]
    assert (result.main_inserted, result.main_skipped) == (2, 0)
    assert (result.links_inserted, result.links_skipped) == (1, 1)
    # Cameras have no place, so they meet events by time alone.
    result = integrate(readings, ws, Config("cam", "go", attribute_type="2"))
    assert result.main_inserted == 2 and ws.read()[EVENT_LINK].count() == 4
    last = integrate(readings, ws, Config("gauge", "truck", selected_type="truck"))
    assert last.all_done


def test_a_bad_run_leaves_the_log_alone(spark, tmp_path, small):
    log, readings = small
    ws = workspace(spark, tmp_path, log)
    for config in (
        Config("gauge", "yard"),
        Config("gauge", "absent", attribute_type="2"),
        Config("gauge", "truck", attribute_type="9"),
        Config("gauge", "truck", logic="9"),
        Config("gauge", "truck", logic=AGGREGATE, func="mode", window=5),
        Config("gauge", "truck", logic=AGGREGATE, window=0),
    ):
        with pytest.raises(ValueError):
            integrate(readings, ws, config)
    assert set(ws.read()) == set(log)


def test_overwriting_a_workspace(spark, tmp_path, small):
    log, readings = small
    ws = workspace(spark, tmp_path, log)
    integrate(readings, ws, Config("gauge", "truck"))
    assert init_workspace(log, ws, overwrite=True)
    assert set(ws.read()) == set(log) and ws.read()["object_truck"].count() == 2


def test_sqlite_logs(spark, tmp_path):
    path = str(tmp_path / "log.sqlite")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE event (ocel_id TEXT, ocel_type TEXT)")
        c.executemany("INSERT INTO event VALUES (?, ?)", [(f"e{i}", "go") for i in range(25)])
        c.execute("CREATE TABLE event_go (ocel_id TEXT, ocel_time TIMESTAMP, weight REAL, n INTEGER)")
        c.execute("INSERT INTO event_go VALUES ('e0', '2024-01-01T10:00:00', 1, 2), ('e1', '2024-01-01 11:00:00.5', NULL, NULL)")
        c.execute("CREATE TABLE event_map_type (ocel_type TEXT PRIMARY KEY, ocel_type_map TEXT) WITHOUT ROWID")
        c.execute("INSERT INTO event_map_type VALUES ('go', 'go')")
        c.execute("CREATE TABLE empty (a TEXT)")
    log = read_sqlite_log(spark, path, rows_per_task=10)
    assert set(log) == {"event", "event_go", "event_map_type", "empty"}
    assert log["event"].rdd.getNumPartitions() == 3
    assert {r.ocel_id for r in log["event"].collect()} == {f"e{i}" for i in range(25)}
    assert sorted(map(tuple, log["event_go"].collect())) == [
        ("e0", datetime(2024, 1, 1, 10), 1.0, 2),
        ("e1", datetime(2024, 1, 1, 11, 0, 0, 500000), None, None),
    ]
    assert log["empty"].count() == 0
    assert log.table_name("event", "go") == "event_go"
    ws = Workspace(spark, str(tmp_path / "ws"))
    init_workspace(log, ws)
    assert ws.read()["event"].count() == 25

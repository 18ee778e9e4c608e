"""Every query that is checked, next to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import tables as t
from sensorthread.functions.conditions import Bound, Condition, threshold_predicate, value_predicate
from sensorthread.operators import maps, overview, persist, profile, reshape, scenarios
from sensorthread.operators.persist import Association
from sensorthread.plans.conform import Mapping, conform
from sensorthread.plans.integrate import Config, integrate
from sensorthread.schema import EVENT_LINK, LEDGER, OBJECT_LINK
from sensorthread.session import apply_session_defaults, scratch_path
from sensorthread.sources.csv import csv_columns
from sensorthread.sources.parquet import read_combined, write_adjusted, write_combined
from sensorthread.sources.workspace import Workspace, export_ocel, init_workspace


@dataclass(frozen=True)
class Check:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CHECKS: dict[str, Check] = {}


def check(name: str, sql: str | None):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        def with_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(apply_session_defaults(spark), sf_dir)

        CHECKS[name] = Check(with_settings, sql)
        return run

    return add


def rounded(df: DataFrame) -> DataFrame:
    """Floating sums depend on the order of addition, so values are compared at six decimals."""
    return df.withColumn("property_value", F.round("property_value", 6))


# Profile


@check(
    "column_profile",
    t.with_tables(
        """
SELECT n AS row_count, name, proposed_dtype, nulls FROM (
  SELECT count(*) AS n, 'device_id' AS name, 'Utf8' AS proposed_dtype, count(*) - count(device_id) AS nulls FROM iot_wide
  UNION ALL SELECT count(*), 'device_type', 'Utf8', count(*) - count(device_type) FROM iot_wide
  UNION ALL SELECT count(*), 'location', 'Utf8', count(*) - count(location) FROM iot_wide
  UNION ALL SELECT count(*), 'result_time', 'Datetime', count(*) - count(result_time) FROM iot_wide
  UNION ALL SELECT count(*), 'value', 'Float64', count(*) - count(value) FROM iot_wide
  UNION ALL SELECT count(*), 'k', 'Float64', count(*) - count(k) FROM iot_wide)
"""
    ),
)
def _(spark, sf):
    return profile.column_profile(t.iot_wide(spark, sf))


@check(
    "device_type_stats",
    t.with_tables("SELECT device_type, count(*) AS count FROM iot GROUP BY 1 ORDER BY 2 DESC, 1"),
)
def _(spark, sf):
    return profile.device_type_stats(t.iot(spark, sf))


ADHOC = """
SELECT device_type, property, count(*) AS n, max(property_value) AS high, count(DISTINCT device_id) AS devices
FROM dataset GROUP BY device_type, property ORDER BY device_type, property LIMIT 50
"""


@check("adhoc_query", t.with_tables(f", dataset AS (SELECT * FROM iot) {ADHOC}"))
def _(spark, sf):
    return profile.query_dataset(t.iot(spark, sf), ADHOC)


# Conform and combine


@check(
    "stack_properties",
    t.with_tables(
        """
SELECT device_id, device_type, location, result_time, 'value' AS property, value AS property_value FROM iot_wide
UNION ALL SELECT device_id, device_type, location, result_time, 'k', CAST(CAST(k AS BIGINT) AS DOUBLE) FROM iot_wide
"""
    ),
)
def _(spark, sf):
    wide = t.iot_wide(spark, sf).withColumn("k", F.col("k").cast("long"))
    names = ["device_id", "device_type", "property", "result_time", "location"]
    return reshape.stack_properties(wide, ["value", "k"], names)


@check(
    "conform_csv",
    """
WITH raw AS (
  SELECT 'dev-' || user_id AS device_id, event_type AS device_type, CAST(ts AS TIMESTAMP) AS result_time,
         CASE WHEN event_type <> 'error' THEN 'cust-' || user_id END AS location, value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
  FROM events)
SELECT device_id, device_type, result_time, location, 'value' AS property, value AS property_value FROM raw
UNION ALL SELECT device_id, device_type, result_time, location, 'k', CAST(k AS DOUBLE) FROM raw
""",
)
def _(spark, sf):
    events = t.table(spark, sf, "events")
    raw = events.select(
        F.concat(F.lit("dev-"), F.col("user_id").cast("string")).alias("sensor"),
        F.col("event_type").alias("kind"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("measured at"),
        F.when(F.col("event_type") != "error", F.concat(F.lit("cust-"), F.col("user_id").cast("string"))).alias("place"),
        "value",
        F.regexp_extract("props", r"([0-9]+)", 1).cast("long").alias("k"),
        F.lit("not mapped").alias("note"),
    )
    path = scratch_path(spark, "csv")
    raw.write.option("header", True).csv(path)
    mapping = Mapping(
        names={
            "sensor": "device_id",
            "kind": "device_type",
            "measured at": "result_time",
            "place": "location",
            "value": "property",
            "k": "property",
        },
        dtypes={"measured at": "Datetime", "k": "Int64"},
    )
    return conform(spark, path, mapping)[0]


RAW = """
WITH raw AS (
  SELECT event_id, 'dev-' || user_id AS device_id, event_type AS device_type, CAST(ts AS TIMESTAMP) AS result_time,
         'cust-' || user_id AS location, value, event_id AS n FROM events)
"""
RAW_NAMES = {"sensor": "device_id", "kind": "device_type", "at": "result_time", "place": "location", "v": "property"}


def _raw(spark, sf, value, **columns):
    """Rows of events as a sensor file would have them, with the value and any other columns given."""
    made = {
        "sensor": F.concat(F.lit("dev-"), F.col("user_id").cast("string")),
        "kind": F.col("event_type"),
        "at": F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
        "place": F.concat(F.lit("cust-"), F.col("user_id").cast("string")),
        "v": value,
    }
    return t.table(spark, sf, "events").select(*[c.alias(n) for n, c in (made | columns).items()])


def _csv(spark, df, **options) -> str:
    path = scratch_path(spark, "csv")
    df.write.options(header=True, **options).csv(path)
    return path


@check(
    "conform_csv_late_types",
    RAW
    + """SELECT device_id, device_type, result_time, location, 'v' AS property,
       CAST(CASE WHEN n >= 0.9 * (SELECT max(n) FROM raw) THEN n + 0.5 ELSE n END AS DOUBLE) AS property_value FROM raw""",
)
def _(spark, sf):
    last = t.table(spark, sf, "events").agg(F.max("event_id")).first()[0]
    whole = F.col("event_id").cast("string")
    late = F.when(F.col("event_id") >= 0.9 * last, F.concat(whole, F.lit(".5"))).otherwise(whole)
    path = _csv(spark, _raw(spark, sf, late).coalesce(1))
    return conform(spark, path, Mapping(RAW_NAMES, dtypes={"at": "Datetime"}))[0]


@check(
    "conform_csv_offsets",
    RAW + "SELECT device_id, device_type, result_time, location, 'v' AS property, value AS property_value FROM raw",
)
def _(spark, sf):
    ahead = F.date_format(F.col("ts") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    at = F.when(F.col("event_id") % 2 == 0, F.concat(ahead, F.lit("+02:00"))).otherwise(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    )
    path = _csv(spark, _raw(spark, sf, F.col("value"), at=at))
    return conform(spark, path, Mapping(RAW_NAMES, dtypes={"at": "Datetime"}))[0]


@check(
    "conform_csv_quoted",
    RAW
    + """SELECT device_id || chr(10) || '"line" two' AS device_id, device_type, result_time, location, 'v' AS property,
       value AS property_value FROM raw""",
)
def _(spark, sf):
    sensor = F.concat(F.lit("dev-"), F.col("user_id").cast("string"), F.lit('\n"line" two'))
    path = _csv(spark, _raw(spark, sf, F.col("value"), sensor=sensor), escape='"', quoteAll=True)
    return conform(spark, path, Mapping(RAW_NAMES, dtypes={"at": "Datetime"}, multi_line=True))[0]


@check(
    "conform_csv_null_location",
    RAW
    + """SELECT device_id, device_type, result_time, CAST(NULL AS VARCHAR) AS location, 'v' AS property,
       value AS property_value FROM raw""",
)
def _(spark, sf):
    path = _csv(spark, _raw(spark, sf, F.col("value")).drop("place"))
    names = {c: n for c, n in RAW_NAMES.items() if n != "location"}
    return conform(spark, path, Mapping(names, dtypes={"at": "Datetime"}, null_location=True))[0]


@check(
    "csv_columns",
    "SELECT * FROM (VALUES (0, 'sensor'), (1, 'kind'), (2, 'at'), (3, 'place'), (4, 'v')) AS t(place, name)",
)
def _(spark, sf):
    names = csv_columns(spark, _csv(spark, _raw(spark, sf, F.col("value"))))
    return spark.createDataFrame(list(enumerate(names)), "place int, name string")


@check(
    "conform_notices",
    "SELECT * FROM (VALUES ('absent_properties', 'gone'), ('unread_times', 'kind')) AS t(kind, columns)",
)
def _(spark, sf):
    path = _csv(spark, _raw(spark, sf, F.col("value")))
    names = RAW_NAMES | {"gone": "property"}
    _, notices = conform(spark, path, Mapping(names, dtypes={"at": "Datetime", "kind": "Datetime"}))
    return spark.createDataFrame([(n.kind, ",".join(n.columns)) for n in notices], "kind string, columns string")


@check("adhoc_query_all_rows", t.with_tables(", dataset AS (SELECT * FROM iot) SELECT * FROM dataset"))
def _(spark, sf):
    return profile.query_dataset(t.iot(spark, sf), "SELECT * FROM dataset")


@check(
    "table_summary",
    t.with_tables(
        """SELECT (SELECT count(*) FROM iot_wide) AS nrows, 6::BIGINT AS ncols, least(20, (SELECT count(*) FROM iot_wide)) AS head,
       'device_id:Utf8,device_type:Utf8,location:Utf8,result_time:Datetime,value:Float64,k:Float64' AS columns"""
    ),
)
def _(spark, sf):
    found = profile.table_summary(t.iot_wide(spark, sf))
    columns = ",".join(f"{c['name']}:{c['dtype']}" for c in found["columns"])
    row = (found["nrows"], found["ncols"], len(found["head"]), columns)
    return spark.createDataFrame([row], "nrows bigint, ncols bigint, head bigint, columns string")


@check("preview", t.with_tables("SELECT least(20, count(*)) AS n, 0::BIGINT AS strange FROM iot"))
def _(spark, sf):
    readings = t.iot(spark, sf)
    some = profile.preview(readings)
    strange = some.exceptAll(readings).count()
    return some.agg(F.count(F.lit(1)).alias("n"), F.lit(strange).cast("bigint").alias("strange"))


@check(
    "combine_sources",
    t.with_tables(
        """
SELECT device_id, device_type, result_time, location, property, property_value, CAST(NULL AS VARCHAR) AS note
FROM iot WHERE device_type = 'view'
UNION ALL
SELECT device_id, device_type, result_time, location, property, CAST(CAST(floor(property_value) AS BIGINT) AS DOUBLE), NULL
FROM iot WHERE device_type = 'click'
UNION ALL
SELECT device_id, device_type, result_time, NULL, property, property_value, 'faulty'
FROM iot WHERE device_type = 'error'
"""
    ),
)
def _(spark, sf):
    readings = t.iot(spark, sf)

    def of(kind):
        return readings.where(F.col("device_type") == kind)

    base = ["device_id", "device_type", "result_time"]
    sources = [
        of("view").select(*base, "location", "property", "property_value"),
        of("click").select(*base, "location", "property", F.floor("property_value").alias("property_value")),
        of("error").select(*base, "property", "property_value", F.lit("faulty").alias("note")),
    ]
    folder = scratch_path(spark, "adjusted")
    paths = [f"{folder}/{i}" for i in range(len(sources))]
    for df, path in zip(sources, paths):
        write_adjusted(df, path)
    write_combined(read_combined(spark, paths), f"{folder}/combined")
    return read_combined(spark, [f"{folder}/combined"])


@check(
    "union_typed_events",
    t.with_tables("SELECT ocel_id, ocel_time FROM event_time"),
)
def _(spark, sf):
    return t.field_log(spark, sf).event_times().select("ocel_id", "ocel_time")


@check(
    "pivot_object_payload",
    t.with_tables(
        """
SELECT location, result_time,
       first(property_value ORDER BY device_id, property_value) FILTER (WHERE property = 'k' AND property_value IS NOT NULL) AS k,
       first(property_value ORDER BY device_id, property_value) FILTER (WHERE property = 'value' AND property_value IS NOT NULL) AS value
FROM iot GROUP BY location, result_time
"""
    ),
)
def _(spark, sf):
    return reshape.pivot_object_payload(t.iot(spark, sf))


# Maps


@check(
    "device_object_map",
    t.with_tables("SELECT device_id, location, ocel_type, ocel_type_map, object_table_name FROM object_map"),
)
def _(spark, sf):
    log = t.field_log(spark, sf)
    return maps.device_object_map(t.iot(spark, sf), log["object"], log["object_map_type"])


EVENT_MAP = """
SELECT DISTINCT device_id, location, ocel_event_id, ocel_type, ocel_type_map, event_table_name FROM event_map
"""


@check("device_event_map", t.with_tables(EVENT_MAP))
def _(spark, sf):
    log = t.field_log(spark, sf)
    return maps.device_event_map(t.iot(spark, sf), log["event_object"], log["event"], log["event_map_type"])


@check(
    "refine_source",
    t.with_tables(
        """
SELECT device_id, device_type, location, result_time, property, property_value FROM iot
WHERE device_type = 'view' AND device_id IN (
  SELECT p.device_id FROM iot p JOIN object o ON p.location = o.ocel_id
  WHERE p.device_type = 'view' AND o.ocel_type = 'MACHINERY')
"""
    ),
)
def _(spark, sf):
    return maps.refine_source(t.iot(spark, sf), "view", t.field_log(spark, sf)["object"], "MACHINERY")


POTENTIAL = """, potential AS (
  SELECT DISTINCT p.device_type, coalesce(o.ocel_type, 'NONE') AS ocel_type
  FROM iot p LEFT JOIN object o ON p.location = o.ocel_id),
remaining AS (SELECT * FROM potential p WHERE NOT EXISTS (
  SELECT 1 FROM ledger l WHERE l.device_type = p.device_type AND l.ocel_type = p.ocel_type))
"""


@check("potential_pairs", t.with_tables(POTENTIAL + "SELECT * FROM potential"))
def _(spark, sf):
    return maps.potential_pairs(t.iot(spark, sf), t.field_log(spark, sf)["object"])


@check(
    "remaining_device_types",
    t.with_tables(
        POTENTIAL + "SELECT DISTINCT device_type FROM remaining WHERE device_type IS NOT NULL ORDER BY device_type"
    ),
)
def _(spark, sf):
    return maps.remaining_device_types(t.iot(spark, sf), t.field_log(spark, sf)["object"], t.ledger(spark))


@check(
    "remaining_count",
    t.with_tables(
        POTENTIAL
        + "SELECT count(*) AS remaining, count(*) FILTER (WHERE device_type IS NULL) AS without_device_type FROM remaining"
    ),
)
def _(spark, sf):
    return maps.remaining_count(t.iot(spark, sf), t.field_log(spark, sf)["object"], t.ledger(spark))


@check(
    "object_type_status",
    t.with_tables(
        """
SELECT DISTINCT o.ocel_type, CASE WHEN l.ocel_type IS NOT NULL THEN 'integrated' ELSE 'pending' END AS status
FROM iot p JOIN object o ON p.location = o.ocel_id
LEFT JOIN ledger l ON l.device_type = 'view' AND l.ocel_type = o.ocel_type
WHERE p.device_type = 'view' ORDER BY 1
"""
    ),
)
def _(spark, sf):
    log = t.field_log(spark, sf)
    source = maps.source_iot(t.iot(spark, sf), "view")
    object_map = maps.device_object_map(source, log["object"], log["object_map_type"])
    return maps.object_type_status(object_map, t.ledger(spark), "view")


@check(
    "mapped_event_types",
    t.with_tables("SELECT DISTINCT ocel_type FROM event_map WHERE ocel_type IS NOT NULL ORDER BY 1"),
)
def _(spark, sf):
    log = t.field_log(spark, sf)
    return maps.mapped_event_types(t.iot(spark, sf), log["event_object"], log["event"])


@check("valid_event_types", t.with_tables("SELECT DISTINCT ocel_type FROM event ORDER BY 1"))
def _(spark, sf):
    return maps.valid_event_types(t.field_log(spark, sf)["event"])


@check("iot_properties", t.with_tables("SELECT DISTINCT property FROM iot ORDER BY 1"))
def _(spark, sf):
    return maps.iot_properties(t.iot(spark, sf))


# Object attributes


PAYLOAD = "device_id, device_type, location, property, property_value, result_time"


@check("object_payload", t.with_tables(f"SELECT {PAYLOAD} FROM iot"))
def _(spark, sf):
    return scenarios.object_payload(t.iot(spark, sf))


@check(
    "threshold_filter",
    t.with_tables(
        f"""
SELECT {PAYLOAD} FROM iot
WHERE (property = 'value' AND property_value > 30) OR (property = 'k' AND property_value >= 0 AND property_value <= 40)
   OR (property = 'value' AND property_value < 0.5)
"""
    ),
)
def _(spark, sf):
    conditions = [
        Condition("value", lower=Bound(30, strict=True)),
        Condition("k", lower=Bound(0), upper=Bound("40")),
        Condition("value", upper=Bound(0.5, strict=True)),
    ]
    return scenarios.object_payload(t.iot(spark, sf), threshold_predicate(conditions))


@check("value_filter", t.with_tables(f"SELECT {PAYLOAD} FROM iot WHERE property_value >= 10 AND property_value < 60"))
def _(spark, sf):
    return scenarios.object_payload(t.iot(spark, sf), value_predicate(Bound(10), Bound(60, strict=True)))


SQL_AGGREGATE = {
    "mean": "avg(property_value)",
    "max": "max(property_value)",
    "min": "min(property_value)",
    "median": "median(property_value)",
    "sum": "sum(property_value)",
    "count": "CAST(count(property_value) AS DOUBLE)",
    "stddev": "stddev_samp(property_value)",
}


def _add_object_by_window(func: str, width: int) -> None:
    sql = f"""
SELECT device_id, device_type, location, property, time_bucket(INTERVAL {width} MINUTE, result_time) AS time_window,
       max(result_time) AS result_time, round({SQL_AGGREGATE[func]}, 6) AS property_value
FROM iot GROUP BY ALL
"""

    @check(f"object_by_window_{func}_{width}", t.with_tables(sql, hourly=False))
    def _(spark, sf):
        return rounded(scenarios.object_payload_by_window(t.iot(spark, sf, hourly=False), func, width))


for _func, _width in [("mean", 60), ("max", 7), ("min", 60), ("median", 1440), ("sum", 1440), ("count", 60), ("stddev", 10080)]:
    _add_object_by_window(_func, _width)


# J7: which device meets which event when, then the readings of that moment.
AT_EVENTS = """, meetings AS (
  SELECT device_id, device_type, ocel_event_id, ocel_time
  FROM event_map JOIN event_time ON ocel_id = ocel_event_id AND event_map.ocel_type IN ('purchase', 'signup')),
joined AS (
  SELECT device_id, device_type, iot.location, property, property_value, ocel_event_id, result_time
  FROM meetings JOIN iot USING (device_id, device_type) WHERE result_time = ocel_time)
"""


@check("object_at_events", t.with_tables(AT_EVENTS + "SELECT * FROM joined WHERE device_type = 'view'"))
def _(spark, sf):
    source = maps.source_iot(t.iot(spark, sf), "view")
    return scenarios.object_payload_at_events(source, t.field_log(spark, sf), ["purchase", "signup"])


@check(
    "object_at_events_filtered",
    t.with_tables(AT_EVENTS + "SELECT * FROM joined WHERE device_type = 'click' AND property = 'k' AND property_value > 50"),
)
def _(spark, sf):
    source = maps.source_iot(t.iot(spark, sf), "click")
    keep = threshold_predicate([Condition("k", lower=Bound(50, strict=True))])
    return scenarios.object_payload_at_events(source, t.field_log(spark, sf), ["purchase", "signup"], keep)


@check(
    "object_by_event",
    t.with_tables(
        AT_EVENTS
        + """
SELECT device_id, device_type, location, property, ocel_event_id, result_time, round(avg(property_value), 6) AS property_value
FROM joined WHERE device_type = 'view' GROUP BY ALL
"""
    ),
)
def _(spark, sf):
    source = maps.source_iot(t.iot(spark, sf), "view")
    return rounded(scenarios.object_payload_by_event(source, t.field_log(spark, sf), ["purchase", "signup"], "mean"))


# Event attributes


def before_events(lookback: int, mapped: bool, sensor: str = "view", event: str = "purchase") -> str:
    """J8 or J9 as `base`, a row per reading and event that looks back on it; J10 and W1 as `closest`."""
    source, meets = "spans", "true"
    if mapped:
        # A device that is at two objects of an event looks on it twice.
        source = "spans JOIN event_map m USING (ocel_event_id)"
        meets = f"m.device_type = '{sensor}' AND m.device_id = x.device_id"
    return f""", spans AS (
  SELECT ocel_id AS ocel_event_id, ocel_time AS until, ocel_time - INTERVAL {lookback} MINUTE AS since
  FROM event_time WHERE ocel_type = '{event}'),
base AS (
  SELECT x.device_id, x.device_type, x.location, x.property, x.property_value, x.result_time AS iot_time,
         spans.ocel_event_id, spans.until AS result_time
  FROM {source}, (SELECT * FROM iot WHERE device_type = '{sensor}') x
  WHERE {meets} AND x.result_time BETWEEN spans.since AND spans.until),
closest AS (
  SELECT * FROM base
  QUALIFY 1 = row_number() OVER (
    PARTITION BY property, ocel_event_id ORDER BY iot_time DESC, device_id, property_value, location))
"""


def _add_matches(name: str, lookback: int, mapped: bool, hourly: bool) -> None:
    sql = (
        before_events(lookback, mapped)
        + """
SELECT ocel_event_id, result_time, count(*) AS n_readings,
       CAST(epoch_us(result_time) - epoch_us(min(iot_time)) AS BIGINT) // 60000000 AS oldest_minutes,
       CAST(epoch_us(result_time) - epoch_us(max(iot_time)) AS BIGINT) // 60000000 AS newest_minutes
FROM base GROUP BY ocel_event_id, result_time
"""
    )

    @check(name, t.with_tables(sql, hourly))
    def _(spark, sf):
        source = maps.source_iot(t.iot(spark, sf, hourly), "view")
        return scenarios.matches_before_events(source, t.field_log(spark, sf, hourly), "purchase", lookback, mapped)


_add_matches("event_matches_mapped_60", 60, True, True)
_add_matches("event_matches_mapped_1440", 1440, True, False)
_add_matches("event_matches_by_time_60", 60, False, True)
_add_matches("event_matches_by_time_15", 15, False, False)


def _add_closest(name: str, mapped: bool, hourly: bool, sensor: str, low: float | None = None) -> None:
    where = "" if low is None else f" WHERE property = 'value' AND property_value > {low}"
    sql = (
        before_events(60, mapped, sensor)
        + "SELECT device_id, device_type, location, property, property_value, ocel_event_id, result_time FROM closest"
        + where
    )

    @check(name, t.with_tables(sql, hourly))
    def _(spark, sf):
        source = maps.source_iot(t.iot(spark, sf, hourly), sensor)
        keep = None if low is None else threshold_predicate([Condition("value", lower=Bound(low, strict=True))])
        log = t.field_log(spark, sf, hourly)
        return scenarios.closest_before_events(source, log, "purchase", mapped, keep=keep)


_add_closest("event_closest_mapped", True, True, "view")
_add_closest("event_closest_mapped_exact_times", True, False, "click")
_add_closest("event_closest_mapped_filtered", True, True, "click", 20)
_add_closest("event_closest_by_time", False, False, "error")
_add_closest("event_closest_by_time_filtered", False, True, "view", 20)


def _add_aggregate(func: str, lookback: int, mapped: bool, hourly: bool, sensor: str, event: str) -> None:
    sql = (
        before_events(lookback, mapped, sensor, event)
        + f"""
SELECT device_id, device_type, location, property, round({SQL_AGGREGATE[func]}, 6) AS property_value,
       ocel_event_id, result_time
FROM base GROUP BY device_id, device_type, location, property, ocel_event_id, result_time
"""
    )
    kind = "mapped" if mapped else "by_time"

    @check(f"event_{func}_{kind}_{lookback}", t.with_tables(sql, hourly))
    def _(spark, sf):
        source = maps.source_iot(t.iot(spark, sf, hourly), sensor)
        log = t.field_log(spark, sf, hourly)
        return scenarios.aggregate_before_events(source, log, event, func, lookback, mapped, digits=6)


_add_aggregate("mean", 60, True, True, "view", "purchase")
_add_aggregate("max", 1440, True, False, "click", "signup")
_add_aggregate("median", 1440, True, False, "view", "purchase")
_add_aggregate("sum", 2880, True, True, "click", "purchase")
_add_aggregate("stddev", 2880, True, False, "view", "signup")
_add_aggregate("min", 30, False, False, "error", "purchase")
_add_aggregate("mean", 30, False, False, "view", "purchase")
_add_aggregate("count", 0, False, True, "click", "signup")


@check(
    "pivot_event_payload",
    t.with_tables(
        before_events(60, True)
        + """
SELECT ocel_event_id, result_time, max(property_value) FILTER (WHERE property = 'k') AS k,
       max(property_value) FILTER (WHERE property = 'value') AS value
FROM closest GROUP BY ocel_event_id, result_time
"""
    ),
)
def _(spark, sf):
    source = maps.source_iot(t.iot(spark, sf), "view")
    payload = scenarios.closest_before_events(source, t.field_log(spark, sf), "purchase", True)
    return reshape.pivot_event_payload(payload)


# Writing into the log

# The object table already holds the `value` changes whose reading has k of 50 or more.
OBJECT_WRITE = """, target AS (
  SELECT location AS ocel_id, result_time AS ocel_time, 'value' AS ocel_changed_field, min(value) AS value
  FROM iot_wide WHERE k >= 50 AND location IS NOT NULL GROUP BY 1, 2),
changes AS (
  SELECT location AS ocel_id, result_time AS ocel_time, property AS ocel_changed_field,
         first(property_value ORDER BY device_id, property_value) AS v
  FROM iot WHERE property_value IS NOT NULL GROUP BY 1, 2, 3),
marked AS (
  SELECT c.*, EXISTS (SELECT 1 FROM target t WHERE t.ocel_id = c.ocel_id AND t.ocel_time = c.ocel_time
                      AND t.ocel_changed_field = c.ocel_changed_field) AS there FROM changes c)
"""


def _object_table(spark, sf):
    return (
        t.iot_wide(spark, sf)
        .where("k >= 50 AND location IS NOT NULL")
        .groupBy(F.col("location").alias("ocel_id"), F.col("result_time").alias("ocel_time"))
        .agg(F.min("value").alias("value"))
        .select("ocel_id", "ocel_time", F.lit("value").alias("ocel_changed_field"), "value")
    )


@check(
    "insert_object_attributes",
    t.with_tables(
        OBJECT_WRITE
        + """
SELECT ocel_id, ocel_time, ocel_changed_field, value, CAST(NULL AS DOUBLE) AS k FROM target
UNION ALL
SELECT ocel_id, ocel_time, ocel_changed_field, CASE WHEN ocel_changed_field = 'value' THEN v END,
       CASE WHEN ocel_changed_field = 'k' THEN v END FROM marked WHERE NOT there
"""
    ),
)
def _(spark, sf):
    return persist.insert_object_attributes(_object_table(spark, sf), t.iot(spark, sf)).table


@check(
    "insert_object_attributes_counts",
    t.with_tables(
        OBJECT_WRITE
        + "SELECT count(*) FILTER (WHERE NOT there) AS inserted, count(*) FILTER (WHERE there) AS skipped FROM marked"
    ),
)
def _(spark, sf):
    return persist.insert_object_attributes(_object_table(spark, sf), t.iot(spark, sf)).counts


# Links the table already holds: those of `click` devices.
OBJECT_LINKS = (
    AT_EVENTS
    + """, old AS (
  SELECT DISTINCT location, device_id, 'measured' AS q, result_time FROM joined
  WHERE device_type = 'click' AND ocel_event_id IN (SELECT ocel_id FROM event WHERE ocel_type = 'purchase')),
wanted AS (
  SELECT DISTINCT location, device_id, 'measured' AS q, result_time FROM joined
  WHERE ocel_event_id IN (SELECT ocel_id FROM event WHERE ocel_type = 'purchase')
  UNION ALL
  SELECT DISTINCT location, device_id, 'joined', result_time FROM joined
  WHERE ocel_event_id IN (SELECT ocel_id FROM event WHERE ocel_type = 'signup')),
marked AS (
  SELECT w.*, EXISTS (SELECT 1 FROM old o WHERE o.location = w.location AND o.device_id = w.device_id AND o.q = w.q
                      AND o.result_time = w.result_time) AS there FROM wanted w)
"""
)


def _object_links(spark, sf):
    log = t.field_log(spark, sf)
    associations = [Association("measured", "purchase"), Association("joined", "signup")]

    def payload(kind):
        source = maps.source_iot(t.iot(spark, sf), kind)
        return scenarios.object_payload_at_events(source, log, ["purchase", "signup"])

    click = payload("click")
    at_purchase = log["event"].where("ocel_type = 'purchase'").select(F.col("ocel_id").alias("ocel_event_id"))
    old = (
        click.join(at_purchase, "ocel_event_id", "left_semi")
        .select(
            F.col("location").alias("ocel_object_id"),
            F.col("device_id").alias("ocel_IoT_object_id"),
            F.lit("measured").alias("ocel_qualifier"),
            F.col("result_time").alias("ocel_time"),
        )
        .distinct()
    )
    everything = click.unionByName(payload("view")).unionByName(payload("error"))
    return persist.object_links(old, everything, associations, log["event"])


@check(
    "object_links",
    t.with_tables(
        OBJECT_LINKS
        + """
SELECT location AS ocel_object_id, device_id AS "ocel_IoT_object_id", q AS ocel_qualifier, result_time AS ocel_time FROM old
UNION ALL SELECT location, device_id, q, result_time FROM marked WHERE NOT there
"""
    ),
)
def _(spark, sf):
    return _object_links(spark, sf).table


@check(
    "object_links_counts",
    t.with_tables(
        OBJECT_LINKS
        + "SELECT count(*) FILTER (WHERE NOT there) AS inserted, count(*) FILTER (WHERE there) AS skipped FROM marked"
    ),
)
def _(spark, sf):
    return _object_links(spark, sf).counts


# The event table already has a `value` where the purchase is worth more than 20.
EVENT_FILL = (
    before_events(60, True)
    + """, target AS (
  SELECT 'ev-' || event_id AS ocel_id, date_trunc('hour', ts) AS ocel_time,
         CASE WHEN value > 20 THEN value END AS value FROM events WHERE event_type = 'purchase'),
source AS (
  SELECT ocel_event_id, max(property_value) FILTER (WHERE property = 'k') AS k,
         max(property_value) FILTER (WHERE property = 'value') AS value FROM closest GROUP BY 1)
"""
)


def _event_fill(spark, sf):
    log = t.field_log(spark, sf)
    source = maps.source_iot(t.iot(spark, sf), "view")
    payload = scenarios.closest_before_events(source, log, "purchase", True)
    events = t.table(spark, sf, "events").where("event_type = 'purchase'")
    target = events.select(
        F.concat(F.lit("ev-"), F.col("event_id").cast("string")).alias("ocel_id"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ocel_time"),
        F.when(F.col("value") > 20, F.col("value")).alias("value"),
    )
    return persist.fill_event_attributes(target, payload)


@check(
    "fill_event_attributes",
    t.with_tables(
        EVENT_FILL
        + """
SELECT t.ocel_id, CAST(t.ocel_time AS TIMESTAMP) AS ocel_time, coalesce(t.value, s.value) AS value, s.k
FROM target t LEFT JOIN source s ON s.ocel_event_id = t.ocel_id
"""
    ),
)
def _(spark, sf):
    return _event_fill(spark, sf).table


@check(
    "fill_event_attributes_counts",
    t.with_tables(
        EVENT_FILL
        + """
SELECT count(*) FILTER (WHERE gain) AS inserted, count(*) FILTER (WHERE NOT gain) AS skipped
FROM (SELECT (t.value IS NULL AND s.value IS NOT NULL) OR s.k IS NOT NULL AS gain
      FROM target t JOIN source s ON s.ocel_event_id = t.ocel_id)
"""
    ),
)
def _(spark, sf):
    return _event_fill(spark, sf).counts


EVENT_LINKS = (
    before_events(60, True)
    + """, old AS (SELECT DISTINCT ocel_event_id, device_id FROM closest WHERE property = 'k' AND property_value >= 50),
wanted AS (SELECT DISTINCT ocel_event_id, device_id FROM closest),
marked AS (SELECT w.*, EXISTS (SELECT 1 FROM old o WHERE o.ocel_event_id = w.ocel_event_id
                               AND o.device_id = w.device_id) AS there FROM wanted w)
"""
)


def _event_links(spark, sf):
    source = maps.source_iot(t.iot(spark, sf), "view")
    payload = scenarios.closest_before_events(source, t.field_log(spark, sf), "purchase", True)
    old = (
        payload.where("property = 'k' AND property_value >= 50")
        .select(
            "ocel_event_id",
            F.col("device_id").alias("ocel_IoT_object_id"),
            F.lit("seen by").alias("ocel_qualifier"),
        )
        .distinct()
    )
    return persist.event_links(old, payload, "seen by")


@check(
    "event_links",
    t.with_tables(
        EVENT_LINKS
        + """SELECT ocel_event_id, device_id AS "ocel_IoT_object_id", 'seen by' AS ocel_qualifier FROM marked"""
    ),
)
def _(spark, sf):
    return _event_links(spark, sf).table


@check(
    "event_links_counts",
    t.with_tables(
        EVENT_LINKS
        + "SELECT count(*) FILTER (WHERE NOT there) AS inserted, count(*) FILTER (WHERE there) AS skipped FROM marked"
    ),
)
def _(spark, sf):
    return _event_links(spark, sf).counts


# Whole runs


def _workspace(spark, sf) -> Workspace:
    workspace = Workspace(spark, scratch_path(spark, "workspace"))
    init_workspace(t.field_log(spark, sf, object_tables=True), workspace)
    return workspace


@check(
    "integrate_object_attributes",
    t.with_tables(
        """, chosen AS (
  SELECT * FROM iot WHERE device_type = 'view' AND device_id IN (
    SELECT p.device_id FROM iot p JOIN object o ON p.location = o.ocel_id
    WHERE p.device_type = 'view' AND o.ocel_type = 'MACHINERY'))
SELECT 'cust-' || c_custkey AS ocel_id, TIMESTAMP '1970-01-01 00:00:00' AS ocel_time,
       CAST(NULL AS VARCHAR) AS ocel_changed_field, c_acctbal AS acctbal, CAST(NULL AS DOUBLE) AS k,
       CAST(NULL AS DOUBLE) AS value
FROM customer WHERE c_mktsegment = 'MACHINERY'
UNION ALL
SELECT location, result_time, property, NULL, CASE WHEN property = 'k' THEN v END, CASE WHEN property = 'value' THEN v END
FROM (SELECT location, result_time, property, first(property_value ORDER BY device_id, property_value) AS v
      FROM chosen WHERE property_value IS NOT NULL GROUP BY 1, 2, 3)
"""
    ),
)
def _(spark, sf):
    workspace = _workspace(spark, sf)
    config = Config("view", "MACHINERY", selected_type="MACHINERY", qualifier="measures")
    integrate(t.iot(spark, sf), workspace, config)
    log = workspace.read()
    assert OBJECT_LINK in log and LEDGER in log
    return log["object_machinery"]


@check(
    "integrate_event_attributes",
    t.with_tables(
        before_events(60, True)
        + """, s AS (
  SELECT ocel_event_id, max(property_value) FILTER (WHERE property = 'k') AS k,
         max(property_value) FILTER (WHERE property = 'value') AS value FROM closest GROUP BY 1)
SELECT e.ocel_id, e.ocel_time, s.k, s.value
FROM event_time e LEFT JOIN s ON s.ocel_event_id = e.ocel_id WHERE e.ocel_type = 'purchase'
"""
    ),
)
def _(spark, sf):
    workspace = _workspace(spark, sf)
    integrate(t.iot(spark, sf), workspace, Config("view", "purchase", attribute_type="2", qualifier="seen by"))
    exported = export_ocel(workspace, scratch_path(spark, "export"))
    assert EVENT_LINK in exported and LEDGER not in exported
    return exported["event_purchase"]


@check(
    "integrate_ledger",
    t.with_tables("SELECT * FROM (VALUES ('click', 'BUILDING'), ('view', 'MACHINERY')) AS t(device_type, ocel_type)"),
)
def _(spark, sf):
    workspace = _workspace(spark, sf)
    for kind, place in (("view", "MACHINERY"), ("click", "BUILDING"), ("view", "MACHINERY")):
        integrate(t.iot(spark, sf), workspace, Config(kind, place, selected_type=place))
    return workspace.read()[LEDGER].where("timestamp IS NOT NULL").select("device_type", "ocel_type")


@check(
    "integrate_result",
    t.with_tables(
        """, chosen AS (
  SELECT * FROM iot WHERE device_type = 'view' AND device_id IN (
    SELECT p.device_id FROM iot p JOIN object o ON p.location = o.ocel_id
    WHERE p.device_type = 'view' AND o.ocel_type = 'MACHINERY')),
n AS (
  SELECT (SELECT count(*) FROM (SELECT DISTINCT location, result_time, property FROM chosen
                                WHERE property_value IS NOT NULL)) AS main,
         (SELECT count(*) FROM (SELECT DISTINCT location, device_id, result_time FROM chosen)) AS links)
SELECT 1 AS run, 'success' AS status, false AS all_done, main AS main_inserted, 0::BIGINT AS main_skipped,
       links AS links_inserted, 0::BIGINT AS links_skipped FROM n
UNION ALL SELECT 2, 'warning', false, 0, main, 0, links FROM n
"""
    ),
)
def _(spark, sf):
    workspace = _workspace(spark, sf)
    config = Config("view", "MACHINERY", selected_type="MACHINERY")
    rows = []
    for run in (1, 2):
        r = integrate(t.iot(spark, sf), workspace, config)
        rows.append((run, r.status, r.all_done, r.main_inserted, r.main_skipped, r.links_inserted, r.links_skipped))
    counts = "main_inserted bigint, main_skipped bigint, links_inserted bigint, links_skipped bigint"
    return spark.createDataFrame(rows, f"run int, status string, all_done boolean, {counts}")


@check(
    "fill_event_attributes_names",
    t.with_tables(
        before_events(60, True)
        + """, s AS (
  SELECT ocel_event_id, first(property_value ORDER BY device_id, property_value)
           FILTER (WHERE property = 'k' AND property_value IS NOT NULL) AS k,
         first(property_value ORDER BY device_id, property_value)
           FILTER (WHERE property = 'value' AND property_value IS NOT NULL) AS value FROM closest GROUP BY 1)
SELECT e.ocel_id, e.ocel_time, s.k AS "Temp", s.value AS "a.b`c"
FROM event_time e LEFT JOIN s ON s.ocel_event_id = e.ocel_id WHERE e.ocel_type = 'purchase'
"""
    ),
)
def _(spark, sf):
    """Properties that differ in case alone share a column, and any sign may be in a name."""
    source = maps.source_iot(t.iot(spark, sf), "view")
    log = t.field_log(spark, sf)
    payload = scenarios.closest_before_events(source, log, "purchase", True)
    spelled = F.when(F.crc32(F.col("ocel_event_id").cast("binary")) % 2 == 0, F.lit("Temp")).otherwise(F.lit("temp"))
    renamed = payload.withColumn("property", F.when(F.col("property") == "k", spelled).otherwise(F.lit("a.b`c")))
    return persist.fill_event_attributes(log["event_purchase"].select("ocel_id", "ocel_time"), renamed).table


# The log itself


@check(
    "log_overview",
    t.with_trade(
        """
SELECT (SELECT count(*) FROM event) AS events, (SELECT count(*) FROM object) AS objects,
       (SELECT count(DISTINCT ocel_type) FROM event) AS activities,
       (SELECT count(DISTINCT ocel_type) FROM object) AS object_types,
       (SELECT count(*) FROM event_object) AS relationships
"""
    ),
)
def _(spark, sf):
    return overview.overview(t.trade_log(spark, sf))


@check(
    "events_per_activity",
    t.with_trade("SELECT ocel_type AS activity, count(*) AS events FROM event GROUP BY 1"),
)
def _(spark, sf):
    return overview.events_per_activity(t.trade_log(spark, sf))


@check(
    "objects_per_type",
    t.with_trade("SELECT ocel_type AS object_type, count(*) AS objects FROM object GROUP BY 1"),
)
def _(spark, sf):
    return overview.objects_per_type(t.trade_log(spark, sf))


@check(
    "activities_per_object_type",
    t.with_trade("SELECT object_type, count(DISTINCT activity) AS activities FROM steps GROUP BY 1"),
)
def _(spark, sf):
    return overview.activities_per_object_type(t.trade_log(spark, sf))


@check(
    "events_over_time",
    t.with_trade(
        """
SELECT ocel_type AS activity, CAST(date_trunc('month', ocel_time) AS TIMESTAMP) AS period, count(*) AS events
FROM event GROUP BY 1, 2
"""
    ),
)
def _(spark, sf):
    return overview.events_over_time(t.trade_log(spark, sf), "month")


@check(
    "directly_follows",
    t.with_trade(
        """, follows AS (
  SELECT *, lead(event) OVER w AS next_event, lead(activity) OVER w AS next_activity FROM steps
  WINDOW w AS (PARTITION BY object ORDER BY time, event))
SELECT object_type, activity, next_activity, count(*) AS occurrences, count(DISTINCT object) AS objects,
       count(DISTINCT (event, next_event)) AS event_pairs
FROM follows WHERE next_event IS NOT NULL GROUP BY 1, 2, 3
"""
    ),
)
def _(spark, sf):
    return overview.directly_follows(t.trade_log(spark, sf))


@check(
    "start_and_end_activities",
    t.with_trade(
        """, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY object ORDER BY time, event) AS first,
         row_number() OVER (PARTITION BY object ORDER BY time DESC, event DESC) AS last FROM steps)
SELECT object_type, activity, count(*) FILTER (WHERE first = 1) AS starts, count(*) FILTER (WHERE last = 1) AS ends
FROM ranked WHERE first = 1 OR last = 1 GROUP BY 1, 2
"""
    ),
)
def _(spark, sf):
    return overview.start_and_end_activities(t.trade_log(spark, sf))

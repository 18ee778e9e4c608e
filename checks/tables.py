"""Readings and event logs, projected from the given tables: as DataFrames and as the same SQL.

Field log: the sensors are the `view`, `click` and `error` rows of `events`, the business events its `purchase` and
`signup` rows, the business objects all of `customer`, typed by market segment. A sensor of type `error` has no place.
Trade log: every order and every order line is an event, every customer, order, part and supplier an object.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorthread.operators.log import EventLog

# Types and the names of their tables.
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
SENSORS = ["view", "click", "error"]
FIELD_EVENTS = ["purchase", "signup"]
TRADE_EVENTS = {"place order": "place_order", "ship item": "ship_item", "ship returned item": "ship_returned"}
TRADE_OBJECTS = {"customer": "customer", "order": "order", "part": "part", "supplier": "supplier"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hour(ts: str) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def named(prefix: str, *parts: str | Column) -> Column:
    """An id such as `cust-12`. Unlike `concat`, `concat_ws` is never null, so no plan tests the ids for null."""
    return F.concat_ws("-", F.lit(prefix), *[F.col(p) if isinstance(p, str) else p for p in parts])


def iot_wide(spark: SparkSession, sf_dir: str, hourly: bool = True) -> DataFrame:
    """One row per reading time, one column per property."""
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin(SENSORS))
    place = named("cust", "user_id")
    return events.select(
        named("dev", F.col("event_id") % 3, "user_id").alias("device_id"),
        F.col("event_type").alias("device_type"),
        F.when(F.col("event_type") != "error", place).alias("location"),
        (_hour("ts") if hourly else F.col("ts")).alias("result_time"),
        "value",
        F.regexp_extract("props", r"([0-9]+)", 1).cast("double").alias("k"),
    )


def iot(spark: SparkSession, sf_dir: str, hourly: bool = True) -> DataFrame:
    """The readings in the common schema."""
    return iot_wide(spark, sf_dir, hourly).unpivot(
        ["device_id", "device_type", "location", "result_time"], ["value", "k"], "property", "property_value"
    )


def _type_table(spark: SparkSession, types: dict[str, str]) -> DataFrame:
    rows = ", ".join(f"('{kind}', '{suffix}')" for kind, suffix in sorted(types.items()))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(ocel_type, ocel_type_map)")


def field_log(spark: SparkSession, sf_dir: str, hourly: bool = True, object_tables: bool = False) -> EventLog:
    customers = table(spark, sf_dir, "customer")
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin(FIELD_EVENTS))
    customer_id = named("cust", "c_custkey")
    event_id = named("ev", "event_id")
    log = EventLog(
        {
            "object": customers.select(customer_id.alias("ocel_id"), F.col("c_mktsegment").alias("ocel_type")),
            "object_map_type": _type_table(spark, {s: s.lower() for s in SEGMENTS}),
            "event": events.select(event_id.alias("ocel_id"), F.col("event_type").alias("ocel_type")),
            "event_map_type": _type_table(spark, {t: t for t in FIELD_EVENTS}),
            "event_object": events.select(
                event_id.alias("ocel_event_id"),
                named("cust", "user_id").alias("ocel_object_id"),
                F.lit("by").alias("ocel_qualifier"),
            ),
        }
    )
    for segment in SEGMENTS if object_tables else []:
        log[f"object_{segment.lower()}"] = customers.where(F.col("c_mktsegment") == segment).select(
            customer_id.alias("ocel_id"),
            F.lit("1970-01-01 00:00:00").cast("timestamp_ntz").alias("ocel_time"),
            F.lit(None).cast("string").alias("ocel_changed_field"),
            F.col("c_acctbal").alias("acctbal"),
        )
    for kind in FIELD_EVENTS:
        log[f"event_{kind}"] = events.where(F.col("event_type") == kind).select(
            event_id.alias("ocel_id"), (_hour("ts") if hourly else F.col("ts")).alias("ocel_time")
        )
    return log


def trade_log(spark: SparkSession, sf_dir: str) -> EventLog:
    def objects(name: str, column: str, kind: str) -> DataFrame:
        return table(spark, sf_dir, name).select(
            named(kind, column).alias("ocel_id"), F.lit(kind).alias("ocel_type")
        )

    placed = table(spark, sf_dir, "orders").select(
        named("place", "o_orderkey").alias("ocel_id"),
        F.lit("place order").alias("ocel_type"),
        F.col("o_orderdate").alias("ocel_time"),
        named("order", "o_orderkey").alias("order"),
        named("customer", "o_custkey").alias("customer"),
    )
    shipped = table(spark, sf_dir, "lineitem").select(
        named(
            "ship", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.unix_date(F.col("l_shipdate").cast("date"))
        ).alias("ocel_id"),
        F.when(F.col("l_returnflag") == "R", "ship returned item").otherwise("ship item").alias("ocel_type"),
        F.col("l_shipdate").alias("ocel_time"),
        named("order", "l_orderkey").alias("order"),
        named("part", "l_partkey").alias("part"),
        named("supplier", "l_suppkey").alias("supplier"),
    )

    def relations(events: DataFrame, *kinds: str) -> DataFrame:
        return events.select(
            F.col("ocel_id").alias("ocel_event_id"),
            F.explode(F.array(*kinds)).alias("ocel_object_id"),
            F.lit("").alias("ocel_qualifier"),
        )

    events = placed.select("ocel_id", "ocel_type").unionByName(shipped.select("ocel_id", "ocel_type"))
    log = EventLog(
        {
            "object": objects("customer", "c_custkey", "customer")
            .unionByName(objects("orders", "o_orderkey", "order"))
            .unionByName(objects("part", "p_partkey", "part"))
            .unionByName(objects("supplier", "s_suppkey", "supplier")),
            "object_map_type": _type_table(spark, TRADE_OBJECTS),
            "event": events,
            "event_map_type": _type_table(spark, TRADE_EVENTS),
            "event_object": relations(placed, "order", "customer").unionByName(
                relations(shipped, "order", "part", "supplier")
            ),
        }
    )
    for kind, suffix in TRADE_EVENTS.items():
        source = placed if kind == "place order" else shipped.where(F.col("ocel_type") == kind)
        log[f"event_{suffix}"] = source.select("ocel_id", "ocel_time")
    return log


def ledger(spark: SparkSession) -> DataFrame:
    """Pairs integrated before."""
    return spark.sql(
        """SELECT device_type, ocel_type, TIMESTAMP_NTZ'2024-02-01 00:00:00' AS timestamp
        FROM VALUES ('view', 'BUILDING'), ('click', 'BUILDING'), ('error', 'NONE') AS t(device_type, ocel_type)"""
    )


def with_tables(query: str, hourly: bool = True) -> str:
    """The query behind the CTEs of the readings and the field log; CTEs of its own follow a comma."""
    at = "date_trunc('hour', ts)" if hourly else "ts"
    return f"""
WITH iot_wide AS (
  SELECT 'dev-' || (event_id % 3) || '-' || user_id AS device_id, event_type AS device_type,
         CASE WHEN event_type <> 'error' THEN 'cust-' || user_id END AS location,
         CAST({at} AS TIMESTAMP) AS result_time, value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k
  FROM events WHERE event_type IN ('view', 'click', 'error')),
iot AS (
  SELECT device_id, device_type, location, result_time, 'value' AS property, value AS property_value FROM iot_wide
  UNION ALL
  SELECT device_id, device_type, location, result_time, 'k', k FROM iot_wide),
object AS (SELECT 'cust-' || c_custkey AS ocel_id, c_mktsegment AS ocel_type FROM customer),
object_map_type AS (SELECT DISTINCT c_mktsegment AS ocel_type, lower(c_mktsegment) AS ocel_type_map FROM customer),
event AS (SELECT 'ev-' || event_id AS ocel_id, event_type AS ocel_type
          FROM events WHERE event_type IN ('purchase', 'signup')),
event_map_type AS (SELECT * FROM (VALUES ('purchase', 'purchase'), ('signup', 'signup')) t(ocel_type, ocel_type_map)),
event_object AS (SELECT 'ev-' || event_id AS ocel_event_id, 'cust-' || user_id AS ocel_object_id
                 FROM events WHERE event_type IN ('purchase', 'signup')),
event_time AS (SELECT 'ev-' || event_id AS ocel_id, event_type AS ocel_type, CAST({at} AS TIMESTAMP) AS ocel_time
               FROM events WHERE event_type IN ('purchase', 'signup')),
ledger AS (SELECT * FROM (VALUES ('view', 'BUILDING'), ('click', 'BUILDING'), ('error', 'NONE'))
           t(device_type, ocel_type)),
sites AS (SELECT device_id, device_type, location FROM iot GROUP BY ALL),
object_map AS (
  SELECT DISTINCT device_id, location, ocel_type, ocel_type_map, 'object_' || ocel_type_map AS object_table_name
  FROM sites LEFT JOIN (object LEFT JOIN object_map_type USING (ocel_type)) ON ocel_id = location),
happened AS (
  SELECT ocel_object_id AS location, ocel_event_id, ocel_type, ocel_type_map, 'event_' || ocel_type_map AS event_table_name
  FROM event_object LEFT JOIN (event LEFT JOIN event_map_type USING (ocel_type)) ON ocel_id = ocel_event_id),
event_map AS (SELECT * FROM sites LEFT JOIN happened USING (location))
{query}
"""


def with_trade(query: str) -> str:
    """The query behind the CTEs of the trade log."""
    return f"""
WITH object AS (
  SELECT 'customer-' || c_custkey AS ocel_id, 'customer' AS ocel_type FROM customer
  UNION ALL SELECT 'order-' || o_orderkey, 'order' FROM orders
  UNION ALL SELECT 'part-' || p_partkey, 'part' FROM part
  UNION ALL SELECT 'supplier-' || s_suppkey, 'supplier' FROM supplier),
placed AS (
  SELECT 'place-' || o_orderkey AS ocel_id, 'place order' AS ocel_type, CAST(o_orderdate AS TIMESTAMP) AS ocel_time,
         ['order-' || o_orderkey, 'customer-' || o_custkey] AS objects FROM orders),
shipped AS (
  SELECT concat_ws('-', 'ship', l_orderkey, l_linenumber, l_partkey, l_suppkey, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))) AS ocel_id,
         CASE WHEN l_returnflag = 'R' THEN 'ship returned item' ELSE 'ship item' END AS ocel_type,
         CAST(l_shipdate AS TIMESTAMP) AS ocel_time,
         ['order-' || l_orderkey, 'part-' || l_partkey, 'supplier-' || l_suppkey] AS objects FROM lineitem),
event AS (SELECT * FROM placed UNION ALL SELECT * FROM shipped),
event_object AS (SELECT ocel_id AS ocel_event_id, unnest(objects) AS ocel_object_id FROM event),
steps AS (
  SELECT DISTINCT o.ocel_type AS object_type, r.ocel_object_id AS object, e.ocel_time AS time,
         e.ocel_id AS event, e.ocel_type AS activity
  FROM event_object r JOIN event e ON r.ocel_event_id = e.ocel_id JOIN object o ON r.ocel_object_id = o.ocel_id)
{query}
"""

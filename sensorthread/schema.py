"""Names and types of the common schema and of the event-log tables."""

from __future__ import annotations

from pyspark.sql import types as T

# The canonical column names of a conformed reading.
CANONICAL_NAMES = ["device_id", "device_type", "property", "result_time", "location"]
PROPERTY = "property"
PROPERTY_VALUE = "property_value"

# Type labels a user may give a CSV column.
TYPE_LABELS = {
    "Int64": T.LongType(),
    "Float64": T.DoubleType(),
    "Utf8": T.StringType(),
    "Boolean": T.BooleanType(),
    "Datetime": T.TimestampNTZType(),
}

# The object type that stands for "no business object".
NO_OBJECT = "NONE"

# Tables a run leaves behind for itself; an export leaves them out.
WORK_TABLES = (
    "iot_event_map",
    "iot_object_map",
    "processed_iot_payload",
    "source_iot_data",
    "integration_log",
)

OBJECT_LINK = "object_IoTobject"
OBJECT_LINK_SCHEMA = T.StructType(
    [
        T.StructField("ocel_object_id", T.StringType()),
        T.StructField("ocel_IoT_object_id", T.StringType()),
        T.StructField("ocel_qualifier", T.StringType()),
        T.StructField("ocel_time", T.TimestampNTZType()),
    ]
)

EVENT_LINK = "event_IoTobject"
EVENT_LINK_SCHEMA = T.StructType(
    [
        T.StructField("ocel_event_id", T.StringType()),
        T.StructField("ocel_IoT_object_id", T.StringType()),
        T.StructField("ocel_qualifier", T.StringType()),
    ]
)

# Columns that name the folders of combined readings and of links; readers of tables drop them.
TYPE_FOLDER = "type_folder"
KEY_FOLDER = "key_folder"

# The column that links are looked up by.
LINK_KEYS = {OBJECT_LINK: "ocel_object_id", EVENT_LINK: "ocel_event_id"}

LEDGER = "integration_log"
LEDGER_SCHEMA = T.StructType(
    [
        T.StructField("device_type", T.StringType()),
        T.StructField("ocel_type", T.StringType()),
        T.StructField("timestamp", T.TimestampNTZType()),
    ]
)

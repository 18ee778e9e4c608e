"""Looking at a table: types, counts, previews, ad-hoc queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorthread.functions.labels import type_label


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: name, type label, number of rows and of nulls; one pass over the data."""
    counts = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.array(
            *[
                F.struct(
                    F.lit(f.name).alias("name"),
                    F.lit(type_label(f.dataType)).alias("proposed_dtype"),
                    F.count_if(F.col(f"`{f.name}`").isNull()).alias("nulls"),
                )
                for f in df.schema
            ]
        ).alias("columns"),
    )
    return counts.select("row_count", F.inline("columns"))


def table_summary(df: DataFrame, n: int = 20) -> dict:
    return {
        "head": [row.asDict() for row in preview(df, n).collect()],
        "columns": [{"name": f.name, "dtype": type_label(f.dataType)} for f in df.schema],
        "nrows": df.count(),
        "ncols": len(df.columns),
    }


def preview(df: DataFrame, n: int = 20) -> DataFrame:
    return df.limit(n)


def device_type_stats(readings: DataFrame) -> DataFrame:
    """Rows per device type, most first; readings without a type are a group of their own."""
    return (
        readings.groupBy("device_type")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "device_type")
    )


def query_dataset(df: DataFrame, sql: str, limit: int | None = None) -> DataFrame:
    """Run a SELECT (or WITH ... SELECT) on the relation `dataset`: all rows, or at most `limit` if one is given."""
    text = sql.strip().rstrip(";")
    if not text.lower().startswith(("select", "with")):
        raise ValueError("only SELECT queries are allowed")
    df.createOrReplaceTempView("dataset")
    try:
        # As a subquery, nothing but a query parses, and a LIMIT of its own stays inside.
        rows = df.sparkSession.sql(f"SELECT * FROM ({text}) AS q")
    finally:
        # The rows are bound to the table by now.
        df.sparkSession.catalog.dropTempView("dataset")
    return rows if limit is None else rows.limit(limit)

"""Run checked queries and compare them with their SQL: python -m checks.compare [sf] [name ...]"""

from __future__ import annotations

import sys
import time
import traceback

import duckdb
from pyspark.sql import SparkSession

from checks.registry import CHECKS

# The given tables.
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _rows(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def differences(spark: SparkSession, connection: duckdb.DuckDBPyConnection, name: str, sf_dir: str) -> list[str]:
    df = CHECKS[name].run(spark, sf_dir)
    got = _rows(df.columns, df.collect())
    relation = connection.sql(CHECKS[name].sql)
    want = _rows(relation.columns, relation.fetchall())
    problems = []
    if sorted(df.columns) != sorted(relation.columns):
        problems.append(f"columns {sorted(df.columns)} instead of {sorted(relation.columns)}")
    spark_types = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "int": "INTEGER", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
    types = {n: spark_types.get(t, t) for n, t in df.dtypes}
    wanted_types = dict(zip(relation.columns, map(str, relation.types)))
    if types != wanted_types:
        problems.append(f"types {sorted(types.items())} instead of {sorted(wanted_types.items())}")
    if len(got) != len(want):
        problems.append(f"{len(got)} rows instead of {len(want)}")
    if got != want:
        problems.append(f"first differences: {[(g, w) for g, w in zip(got, want) if g != w][:2]}")
    return problems


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(CHECKS)
    sf_dir = f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = oracle(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            problems = differences(spark, connection, name, sf_dir)
        except Exception:
            problems = [traceback.format_exc(limit=6)[:1800]]
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.2f}s", *problems, sep="\n     ", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")


if __name__ == "__main__":
    main()

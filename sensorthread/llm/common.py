"""Expressions and small steps that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorthread.session import apply_session_defaults

#: The separators of words, and the letters that are lower-cased.
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Rows that a Python worker gets at a time, and bytes: texts can be long.
BATCH_ROWS = 500
BATCH_BYTES = 16 << 20

#: Bits of the filter that finds rows by their hash before a join: at most FILTER_BITS / 64 rows of two numbers.
FILTER_BITS = 1 << 26


def prepared(spark: SparkSession) -> SparkSession:
    """The session with adaptive execution on and small batches for Python workers."""
    apply_session_defaults(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once per row: within a lambda a plain column would be computed per element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def split_words(text: Column) -> Column:
    """The words between white space, an empty array for null."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(bare) > 0, F.split(bare, f"{SPACE_CLASS}+")).otherwise(F.array().cast("array<string>"))


def may_match(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str, bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose key (a hash of 64 bits) is one of wanted's, and few others: what a join by the key needs of wide rows.

    A Bloom filter with one hash: bits (a power of two from 64 on) in words of 64, of which those with a bit set are
    broadcast, at most bits / 64 whatever the size of wanted. With more keys than bits more rows pass; none is lost.
    Null keys match nothing. The rows keep their columns.
    """
    place = F.pmod(F.col(wanted_key), F.lit(bits))
    words = (
        wanted.where(F.col(wanted_key).isNotNull())
        .groupBy(F.shiftright(place, 6).alias("filter_word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(63).cast("int"))).alias("filter_bits"))
    )
    at = F.pmod(F.col(key), F.lit(bits))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(63).cast("int"))
    return (
        rows.join(F.broadcast(words), F.shiftright(at, 6) == F.col("filter_word"))
        .where(F.col("filter_bits").bitwiseAND(bit) != 0)
        .drop("filter_word", "filter_bits")
    )


def map_batches(
    df: DataFrame, columns: Callable[..., dict], schema: str, names: list[str] | None = None
) -> DataFrame:
    """columns(**lists of the batch's columns) gives lists for the columns of schema. Batch by batch, in Python workers.

    Rows may be added or left out. names: the columns that are passed, all by default.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    given = names or df.columns
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lists = {name: batch.column(i).to_pylist() for i, name in enumerate(given)}
                made = columns(**lists)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(made[f.name], f.type) for f in arrow], schema=arrow
                )

    return df.select(*given).mapInArrow(run, schema)

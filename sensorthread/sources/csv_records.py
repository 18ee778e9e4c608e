"""Records of CSV files with quoted line breaks, found in parallel: one file is many tasks.

Whether a line break ends a record depends on all quotes before it. A line is therefore taken as a function from "begins
within quotes or not" to "ends within quotes or not". Such functions compose, so each split of a file is scanned for
itself, a row per split tells how the split begins, and only lines of records that go over lines meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorthread.session import written

# A field, and what may follow up to the end of the line. A quote that does not open a field is part of it. Possessive
# throughout, so that long lines neither backtrack nor recurse.
_FIELD = r'(?:"(?:[^"]++|"")*+"[^,]*+|(?!")[^,]*+)'
_CLOSED = rf"\A{_FIELD}(?:,{_FIELD})*+\z"
_CLOSES = rf'\A(?:[^"]++|"")*+"[^,]*+(?:,{_FIELD})*+\z'

_SPLIT = ["file", "block"]


def _state_after(from_outside: Column, from_inside: Column, order) -> dict[str, Column]:
    """Columns for the composition of all functions up to a row: `turns`, then `fixed`, which reads `turns`."""
    turns = F.sum(F.when((from_outside == 1) & (from_inside == 0), 1).otherwise(0)).over(order)
    fixed = F.last(F.when(from_outside == from_inside, (from_outside + F.col("turns")) % 2), ignorenulls=True).over(order)
    return {"turns": turns, "fixed": fixed}


def _ends(begins: int) -> Column:
    return ((F.coalesce("fixed", F.lit(begins)) + F.col("turns")) % 2).cast("int")


def _scanned(spark: SparkSession, path: str) -> DataFrame:
    """A row per line: file, block (start of its split), id (grows along the split), line, head (whether it begins the
    file's first record), and before_0, before_1, after_0, after_1: 1 where the line begins or ends within quotes, if
    its split begins outside (0) or within (1)."""
    # Split at \n alone, as a record may hold any line break.
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
        F.col("value").alias("line"),
    )
    quoted = F.contains("line", F.lit('"'))
    unmarked = F.when(F.col("block") == 0, F.ltrim(F.col("line"), F.lit("\ufeff"))).otherwise(F.col("line"))
    own = lines.withColumn("line", unmarked).select(
        "*",
        F.when(quoted & ~F.rlike("line", F.lit(_CLOSED)), 1).otherwise(0).alias("f0"),
        F.when(quoted & F.rlike("line", F.lit(_CLOSES)), 0).otherwise(1).alias("f1"),
    )
    by_id = Window.partitionBy(*_SPLIT).orderBy("id")
    so_far = by_id.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for name, column in _state_after(F.col("f0"), F.col("f1"), so_far).items():
        own = own.withColumn(name, column)
    filled = F.trim(F.regexp_replace("line", "\r", "")) != ""
    own = own.withColumn("nth", F.sum(filled.cast("int")).over(so_far)).select(
        *_SPLIT,
        "id",
        "line",
        ((F.col("block") == 0) & filled & (F.col("nth") == 1)).alias("head"),
        _ends(0).alias("after_0"),
        _ends(1).alias("after_1"),
    )
    return own.select("*", *[F.lag(f"after_{x}", 1, x).over(by_id).alias(f"before_{x}") for x in (0, 1)])


def _splits(lines: DataFrame) -> DataFrame:
    """A row per split: begins (1 within quotes) and opened, the id of the line that began the record it begins in."""
    own = lines.groupBy(*_SPLIT).agg(
        F.max_by(F.struct("after_0", "after_1"), "id").alias("after"),
        *[F.max(F.when(F.col(f"before_{x}") == 0, F.col("id"))).alias(f"start_{x}") for x in (0, 1)],
    )
    by_block = Window.partitionBy("file").orderBy("block")
    so_far = by_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for name, column in _state_after(F.col("after.after_0"), F.col("after.after_1"), so_far).items():
        own = own.withColumn(name, column)
    own = own.withColumn("begins", F.lag(_ends(0), 1, 0).over(by_block))
    start = F.when(F.col("begins") == 0, F.col("start_0")).otherwise(F.col("start_1"))
    earlier = by_block.rowsBetween(Window.unboundedPreceding, -1)
    return own.withColumn("start", start).select(
        *_SPLIT, "begins", F.last("start", ignorenulls=True).over(earlier).alias("opened")
    )


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all files at a path, without the first of each file (its header), as a column `record`.

    Fields are parted by commas and may be quoted, with quotes doubled in them; lines end with \\n or \\r\\n. Line breaks
    within quotes stay as they are, and empty lines between records are none. Only lines of records that go over lines
    are grouped, each record for itself; a quote that is never closed makes the rest of its file one record. The text is
    written to the shared folder once.
    """
    scanned = written(_scanned(spark, path), "csv-lines")
    # A row per split, read once more from four narrow columns.
    lines = scanned.join(_splits(scanned), _SPLIT)
    before, after = (
        F.when(F.col("begins") == 0, F.col(f"{side}_0")).otherwise(F.col(f"{side}_1")) for side in ("before", "after")
    )
    lines = lines.select(*_SPLIT, "id", "line", "head", "opened", before.alias("before"), after.alias("after"))
    whole = (F.col("before") == 0) & (F.col("after") == 0)
    # Within a split, the last line before that begins a record; else the one that an earlier split left open.
    by_id = Window.partitionBy(*_SPLIT).orderBy("id")
    started = F.last(F.when(F.col("before") == 0, F.col("id")), ignorenulls=True).over(by_id)
    parts = lines.where(~whole).withColumn("start", F.coalesce(started, "opened"))
    united = parts.groupBy("start").agg(
        F.array_sort(F.collect_list(F.struct("block", "id", "line"))).alias("lines"),
        # What opens the file is the head only as a record's first line.
        F.bool_or(F.col("head") & (F.col("before") == 0)).alias("head"),
    )
    joined = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    records = lines.where(whole).select(F.col("line").alias("record"), "head").unionAll(united.select(joined, "head"))
    bare = F.regexp_replace("record", r"\r\z", "")
    return records.where(~F.col("head")).select(bare.alias("record")).where(F.trim("record") != "")

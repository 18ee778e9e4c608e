"""Work that needs the rows of a group in order, for groups too large for one task.

A group of ordinary size goes through a plain window or aggregate. A hot group is range-partitioned on its
group and order columns together, which cuts it into contiguous chunks of even size. Each chunk is handled
alone, and what must pass between chunks is one row per (group, chunk).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorthread.session import freeze, written

# Rows of one group that a single task may sort or hold.
HOT_ROWS = 4_000_000

# Rows that a piece of a hot group has, about.
CHUNK_ROWS = 1_000_000

# Rows that need no more partitions than the session gives.
FEW_ROWS = 8_000_000

# Groups that are counted together, by hash, before any is counted alone.
HASHES = 16_384

# Rows of one group whose values a single task may hold in memory, which the built-in median does.
MEDIAN_ROWS = 200_000


def packed(keys: list[str]) -> Column:
    """The key columns as one struct; struct equality takes two nulls as equal, as grouping does."""
    return F.struct(*[F.col(k) for k in keys])


def crowding(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """How many rows there are, and at most in a group: the rows of the most crowded hash, which shuffles next to nothing."""
    by_hash = df.groupBy(_hash(keys)).agg(F.count(F.lit(1)).alias("_rows"))
    rows, most = by_hash.agg(F.sum("_rows"), F.max("_rows")).first()
    return rows or 0, most or 0


def _hash(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(packed(keys)), F.lit(HASHES)).cast("int").alias("_hash")


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int) -> DataFrame | None:
    """Keys (as `_key`) with more than `hot_rows` rows, or None if there are none. Counting combines on the map
    side, so a hot key costs no more to find than any other. Keys are counted one by one only where there may be a hot one."""
    if crowding(df, keys)[1] <= hot_rows:
        return None
    sizes = df.groupBy(packed(keys).alias("_key")).agg(F.count(F.lit(1)).alias("_rows"))
    hot = sizes.where(F.col("_rows") > hot_rows).select("_key")
    return None if hot.isEmpty() else freeze(hot)


def pieces(spark: SparkSession, rows: int) -> int | None:
    """How many partitions to ask for so that one has about CHUNK_ROWS, whatever the session's number is; None for few
    rows, which adaptive execution deals with."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return None if rows <= FEW_ROWS else max(least, -(-rows // CHUNK_ROWS))


def split_hot(df: DataFrame, keys: list[str], hot: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary groups, and rows of hot groups (None if there are none)."""
    if hot is None:
        return df, None
    keyed = df.withColumn("_key", packed(keys))
    return (
        keyed.join(hot, "_key", "left_anti").drop("_key"),
        keyed.join(hot, "_key", "left_semi").drop("_key"),
    )


def ordered_chunks(df: DataFrame, order: list[str]) -> DataFrame:
    """Number the contiguous, evenly sized pieces of the rows in `order`, as many as bound a piece by CHUNK_ROWS. The
    numbers are saved with the rows, because the cut points come from a sample that a second run of the plan would draw
    anew."""
    df = written(df, "to-chunk")
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(least, -(-df.count() // CHUNK_ROWS))
    return freeze(df.repartitionByRange(wanted, *order).withColumn("_chunk", F.spark_partition_id()))


def with_successor(
    df: DataFrame, group: list[str], order: list[str], carry: list[str], hot: DataFrame | None
) -> DataFrame:
    """Add `next_<c>` for each carried column: its value in the next row of the group, null in the last.
    `group` and `order` together must identify a row; `hot` holds the hot groups, from `hot_keys`."""
    calm, busy = split_hot(df, group, hot)
    in_order = Window.partitionBy(*group).orderBy(*order)
    result = calm.select("*", *[F.lead(c).over(in_order).alias(f"next_{c}") for c in carry])
    if busy is None:
        return result

    chunks = ordered_chunks(busy, group + order)
    in_chunk = Window.partitionBy(*group, "_chunk").orderBy(*order)
    inside = chunks.select(
        "*",
        *[F.lead(c).over(in_chunk).alias(f"next_{c}") for c in carry],
        F.lead(F.lit(True)).over(in_chunk).isNull().alias("_last"),
    )
    # Heads of the chunks: the least row of each, handed to the chunk before it.
    heads = chunks.groupBy(*group, "_chunk").agg(
        F.min(F.struct(*[F.col(c) for c in dict.fromkeys([*order, *carry])])).alias("_head")
    )
    handed = heads.select(
        packed(group).alias("_key"),
        "_chunk",
        F.lead("_head").over(Window.partitionBy(*group).orderBy("_chunk")).alias("_head"),
    )
    stitched = inside.withColumn("_key", packed(group)).join(handed, ["_key", "_chunk"], "left")
    filled = stitched.select(
        *df.columns,
        *[
            F.when(F.col("_last"), F.col(f"_head.{c}")).otherwise(F.col(f"next_{c}")).alias(f"next_{c}")
            for c in carry
        ],
    )
    return result.unionByName(filled)


def group_median(
    df: DataFrame,
    keys: list[str],
    value: str,
    out: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Exact median (interpolated) per group; null where a group has no value."""
    calm, busy = split_hot(df, keys, hot_keys(df, keys, min(hot_rows, MEDIAN_ROWS)))
    result = calm.groupBy(*keys).agg(F.median(value).alias(out))
    if busy is None:
        return result
    return result.unionByName(_median_in_chunks(busy, keys, value, out))


def _median_in_chunks(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    counted = df.groupBy(packed(keys).alias("_key"), F.col(value).alias("_v")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    chunks = ordered_chunks(counted.where(F.col("_v").isNotNull()), ["_key", "_v"])

    whole = Window.partitionBy("_key")
    before = whole.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = chunks.groupBy("_key", "_chunk").agg(F.sum("_n").alias("_m"))
    placed = sums.select(
        "_key",
        "_chunk",
        "_m",
        F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_start"),
        F.sum("_m").over(whole).alias("_total"),
    ).select(
        "_key",
        "_chunk",
        "_m",
        "_start",
        F.expr("(_total - 1) div 2").alias("_lo"),
        F.expr("_total div 2").alias("_hi"),
    )

    def holds(rank: str, start: str, size: str) -> Column:
        return (F.col(start) <= F.col(rank)) & (F.col(rank) < F.col(start) + F.col(size))

    wanted = placed.where(holds("_lo", "_start", "_m") | holds("_hi", "_start", "_m"))
    running = Window.partitionBy("_key", "_chunk").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = chunks.join(wanted, ["_key", "_chunk"]).withColumn(
        "_at", F.col("_start") + F.sum("_n").over(running) - F.col("_n")
    )
    hits = holds("_lo", "_at", "_n").cast("int") + holds("_hi", "_at", "_n").cast("int")
    medians = (
        ranked.withColumn("_hits", hits)
        .where(F.col("_hits") > 0)
        .groupBy("_key")
        # Halved before they are added, as the built-in median does: sums of great values stay finite.
        .agg(F.sum(F.col("_v") / 2 * F.col("_hits")).alias(out))
    )
    # Groups whose values are all null keep their row.
    groups = df.select(packed(keys).alias("_key")).distinct()
    return groups.join(medians, "_key", "left").select(*[F.col(f"_key.{k}").alias(k) for k in keys], out)

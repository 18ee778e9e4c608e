"""Sharding by sampled splitters [native].

Documents are put in the order of a hash of their text, then of one of their id, and the order is cut into shards of
nearly equal bytes. A sample of places in that order, drawn with a chance proportional to a document's size, gives
splitters that stand at even steps of the bytes; they cut the documents into ranges, several to a shard. The bytes of
every range are then counted, and a range that is too full for one task is subdivided by the hash of the id. So each
piece is sorted by a task of its own, and where it starts is a sum over pieces.

A shard is the multiple of total / shards that a document's first byte falls past. Equal texts are neighbours and stay
in one shard, except where they would make it more than a hundredth too large: a text copied into a third of all rows
gets several splitters, as it is drawn that often, and several shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorthread.session import written

#: How many shards, and the bytes a document counts besides its text.
SHARDS = 24
OVERHEAD = 8

#: Ranges per shard, and drawn places per range: together they bound the sample that reaches the driver.
RANGES = 16
DRAWS = 32

#: Rows and bytes that one task is to sort.
PIECE_ROWS = 1_000_000
PIECE_BYTES = 512 << 20

#: Equal texts of at most a shard's bytes over this are not parted.
SLACK = 100

#: Tables of pieces up to so many rows (of some 50 bytes) are broadcast.
SMALL_ROWS = 500_000


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("bigint")


def text_crc32(text: Column) -> Column:
    return F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("bigint")


def _place() -> tuple[Column, Column]:
    """Where a document stands: by its text (null first), then by its id."""
    by_text = F.coalesce(F.substring(F.md5(F.col("text").cast("binary")), 1, 16), F.lit("-" * 16))
    by_id = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return by_text.alias("h"), by_id.alias("g")


def splitters(keys: DataFrame, total: int, ranges: int, draws: int) -> list[str]:
    """Where ranges begin (h, or h and g) but for the first: places at even steps of the bytes, by a sample.

    A row is drawn with the chance size * ranges * draws / total and stands for as many bytes as make that fair; the
    draws are decided by a hash, so reruns agree. A splitter falls before the first of equal texts; only texts that
    several fall into are parted, and have one before their first too.
    """
    wanted = ranges * draws
    chance = F.pmod(F.xxhash64("h", "g"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    drawn = keys.where(chance * total < F.col("size").cast("double") * wanted).select(
        "h", "g", F.greatest(F.col("size").cast("double"), F.lit(total / wanted)).alias("bytes")
    )
    sample = sorted(drawn.collect())
    whole = sum(r.bytes for r in sample)
    chosen: list[tuple[str, str]] = []
    seen, step = 0.0, 1
    for r in sample:
        while step < ranges and seen >= step * whole / ranges:
            chosen.append((r.h, r.g))
            step += 1
        seen += r.bytes
    times: dict[str, int] = {}
    for h, _ in set(chosen):
        times[h] = times.get(h, 0) + 1
    return sorted({h for h in times} | {h + g for h, g in chosen if times[h] > 1})


def _range_of(place: Column, starts: list[str]) -> Column:
    """How many of the starts are at or before the place: a binary search in a literal array."""
    if not starts:
        return F.lit(0)
    steps = F.array(*[F.lit(1 << k) for k in range(len(starts).bit_length() - 1, -1, -1)])
    table = F.array(*[F.lit(s) for s in starts])
    return F.aggregate(
        steps, F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) <= place, at + step).otherwise(at)
    )


def shard(
    docs: DataFrame,
    shards: int = SHARDS,
    ranges: int = RANGES,
    draws: int = DRAWS,
    piece_rows: int = PIECE_ROWS,
    piece_bytes: int = PIECE_BYTES,
    carry: list[str] | None = None,
) -> DataFrame:
    """The rows of docs with size, shard (from 0) and slot (from 0 without gaps in each shard).

    docs needs doc_id and text; the columns of carry are kept, all by default, but those named like the three added. Null texts have no
    bytes beside the overhead and come first; null ids stand as empty ones do; rows that are equal in text and id have
    neighbouring slots, in any order. Shards may be empty where documents are few or one is larger than a shard. No
    rows give none.
    """
    spark = docs.sparkSession
    own = [c for c in carry or docs.columns if c.lower() not in {"size", "shard", "slot"}]
    size = text_size(F.col("text")).alias("size")
    keys = written(docs.select(size, *_place()), "shard-keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    starts = splitters(keys, total, shards * ranges, draws) if total else []
    span = _range_of(F.concat("h", "g"), starts).alias("span")

    counted = written(
        keys.select(span, "size")
        .groupBy("span")
        .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
        .select(
            "span",
            F.ceil(F.greatest(F.col("bytes") / piece_bytes, F.col("n") / piece_rows)).cast("int").alias("parts"),
        ),
        "ranges",
    )
    full = {r.span: r.parts for r in counted.where("parts > 1").collect()}  # One row per range at most.
    # Subdivided ranges: the hash of the id deals their rows evenly, however few texts there are.
    parts = F.lit(1)
    if full:
        parts = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in full.items() for v in kv]), F.col("span")), F.lit(1))
    piece = F.pmod(F.xxhash64("g"), parts).cast("int").alias("piece")
    pieces = keys.select(span, "g", "size").select("span", piece, "size")
    pieces = pieces.groupBy("span", "piece").agg(F.sum("size").alias("bytes"))
    before = Window.orderBy("span", "piece").rowsBetween(Window.unboundedPreceding, -1)
    n_pieces = len(starts) + 1 + sum(full.values())
    begins = pieces.select("span", "piece", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("begin"))

    def small(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if n_pieces + shards <= SMALL_ROWS else table

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), size, *_place())
    rows = rows.select("row", "size", "h", "g", span).select("*", piece)
    place = Window.partitionBy("span", "piece").orderBy("h", "g")
    equal = Window.partitionBy("span", "piece", "h")
    sized = rows.select(
        "*",
        (F.sum("size").over(place.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("at"),
        F.row_number().over(place).alias("row_at"),
    ).select("*", F.min("at").over(equal).alias("head"), F.sum("size").over(equal).alias("copies"))
    first = F.when(F.col("copies") * (shards * SLACK) <= F.lit(total), F.col("head")).otherwise(F.col("at"))
    placed = written(
        sized.withColumn("first", first)
        .join(small(begins), ["span", "piece"])
        .select(
            "row",
            "size",
            "span",
            "piece",
            "row_at",
            F.expr(f"CAST(((begin + first) * {shards}) div {max(total, 1)} AS int)").alias("shard"),
        ),
        "placed",
    )
    by_piece = placed.groupBy("shard", "span", "piece").agg(F.count(F.lit(1)).alias("n"), F.min("row_at").alias("least"))
    earlier = Window.partitionBy("shard").orderBy("span", "piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_piece.select(
        "shard", "span", "piece", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("least")).alias("shift")
    )
    return placed.join(small(offsets), ["shard", "span", "piece"]).select(
        "row.*", "size", "shard", (F.col("row_at") + F.col("shift")).cast("bigint").alias("slot")
    )

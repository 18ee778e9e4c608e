"""Mixing sources to target weights by a time-varying curriculum [native].

Every source has a weight and a schedule, how its weight rises and falls over the training. A schedule is integrated
to the share of the source's words that is due by any time; a document, which stands for a stretch of its source's
words, is due when that share has grown to the middle of the stretch. Documents are then sorted by time across sources.

A source that must give more words than it has is read again from its start, so its documents differ by one reading at
most. Within a source, documents lie in the order of md5(doc_id), which does not depend on the machine. Running sums
are taken in two steps, within and over 4,096 parts of each source, so that no source has to fit one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorthread.llm.common import SPACE_CLASS

#: Weights of the sources in order, repeating, and how often a source may be read at most.
WEIGHTS = (5, 2, 1)
MAX_READS = 3

#: Schedules in the same order: what the weight is multiplied by at each time from 0 to 1, straight in between.
SCHEDULES = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 0.5), (1.0, 2.0)),
)

PART_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def due_time(share: Column, schedule: tuple[tuple[float, float], ...]) -> Column:
    """The time by which a share (0 to 1) of all words is due under the schedule: the inverse of its integral."""
    pieces, total = [], 0.0
    for (t0, m0), (t1, m1) in zip(schedule, schedule[1:]):
        pieces.append((t0, t1 - t0, m0, m1 - m0, total))
        total += (m0 + m1) / 2 * (t1 - t0)
    time = F.lit(None).cast("double")
    for t0, width, m0, rise, before in reversed(pieces):
        area = (share * total - before) / width
        # m0 x + rise x^2 / 2 = area, for x from 0 to 1
        x = area / m0 if rise == 0 else (F.sqrt(m0 * m0 + 2 * rise * area) - m0) / rise
        here = t0 + width * x
        time = here if pieces[-1][0] == t0 else F.when(share * total <= before + (m0 + (m0 + rise)) / 2 * width, here).otherwise(time)
    return time


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_reads: int = MAX_READS) -> DataFrame:
    """From (m_source, source_size), one row per source: rank, weight and target, in words.

    All words are shared by weight. A target above max_reads times its source's size is cut to that, and what is cut
    is shared among the others by weight, again and again. With the sources by their limit over weight, those that are
    cut come first, so one pass with running sums settles it. The table has a row per source: its windows run in one
    task.
    """
    by_name = Window.orderBy(F.col("m_source").asc_nulls_last())
    by_limit = Window.orderBy(F.col("m_limit") / F.col("m_weight"), "m_rank")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    after = by_limit.rowsBetween(0, Window.unboundedFollowing)
    ranked = sizes.withColumn("m_rank", F.row_number().over(by_name) - 1)
    weighed = ranked.withColumn(
        "m_weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("m_rank") % len(weights) + 1).cast("int")).cast("bigint")
    ).withColumn("m_limit", F.col("source_size") * max_reads)
    left = weighed.select(
        "*",
        (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("m_limit").over(before), F.lit(0))).alias("m_left"),
        F.sum("m_weight").over(after).alias("m_rest"),
    )
    cut = left.withColumn("m_cut", F.col("m_limit") * F.col("m_rest") <= F.col("m_left") * F.col("m_weight"))
    # The first source that is not cut has what is left and the weights that share it.
    free = cut.select(
        "*",
        F.max(F.when(~F.col("m_cut"), F.col("m_left"))).over(Window.partitionBy()).alias("m_words"),
        F.max(F.when(~F.col("m_cut"), F.col("m_rest"))).over(Window.partitionBy()).alias("m_weights"),
    )
    return free.select(
        "m_source",
        "source_size",
        "m_rank",
        F.when(F.col("m_cut"), F.col("m_limit").cast("double"))
        .otherwise((F.col("m_words") * F.col("m_weight")).cast("double") / F.col("m_weights"))
        .alias("target"),
    )


def assigned(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    schedules: tuple = SCHEDULES,
    max_reads: int = MAX_READS,
    keep: list[str] | None = None,
) -> DataFrame:
    """Per row the columns of keep (doc_id alone by default) and m_source, size, source_size, target, taken, m_rank and m_from.

    taken: words the mix takes of the document, m_from: where it starts within its source. Null texts have no words
    and are taken in no words; a null source is a source; rows that share a doc_id lie side by side, in the order of their
    sizes and then of a hash of their texts. Rows without a doc_id lie where their texts' hashes say.
    """
    keep = keep or ["doc_id"]
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")))
    sized = docs.select(
        F.struct(*keep).alias("m_row"),
        F.col("source").alias("m_source"),
        digest.alias("m_key"),
        F.xxhash64("text").alias("m_text"),
        F.substring(digest, 1, PART_DIGITS).alias("m_part"),
        word_count(F.col("text")).alias("size"),
    )
    parts = sized.groupBy("m_source", "m_part").agg(F.sum("size").alias("m_size"))
    by_part = Window.partitionBy("m_source").orderBy("m_part")
    starts = parts.select(
        F.col("m_source").alias("p_source"),
        F.col("m_part").alias("p_part"),
        (F.sum("m_size").over(by_part) - F.col("m_size")).alias("p_from"),
    )
    targets = source_targets(parts.groupBy("m_source").agg(F.sum("m_size").alias("source_size")), weights, max_reads)
    starts = starts.join(targets, F.col("p_source").eqNullSafe(F.col("m_source"))).drop("m_source")
    within = Window.partitionBy("m_source", "m_part").orderBy("m_key", "size", "m_text").rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.withColumn("m_in", F.sum("size").over(within) - F.col("size")).join(
        starts, F.col("m_source").eqNullSafe(F.col("p_source")) & (F.col("m_part") == F.col("p_part"))
    )
    begins = F.col("p_from") + F.col("m_in")
    goal = F.round("target").cast("bigint")
    reads = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    rest = goal - reads * F.col("source_size") - begins
    taken = reads * F.col("size") + F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), rest))
    return placed.select(
        "m_row.*",
        "m_source",
        "size",
        "source_size",
        "target",
        taken.alias("taken"),
        "m_rank",
        begins.alias("m_from"),
        "m_text",
    )


def due_at(start: Column, words: Column, schedules: tuple = SCHEDULES) -> Column:
    """When the words from start on, of the words that the mix takes of a source, are due: at their middle."""
    share = (start + words / 2) / F.col("target")
    time = due_time(share, schedules[-1])
    for k in range(len(schedules) - 1):
        time = F.when(F.col("m_rank") % len(schedules) == k, due_time(share, schedules[k])).otherwise(time)
    return F.round(F.least(F.lit(1.0), time), 9)


def training_order(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    schedules: tuple = SCHEDULES,
    max_reads: int = MAX_READS,
) -> DataFrame:
    """The training data: the rows of docs, once per reading, sorted by position (0 to 1).

    Added are words (those to be read, less than the text has where the source's target ends within it), reading (from
    0) and position; columns of docs with these names are left out. Documents that the mix does not take are missing,
    such as null and empty texts. Equal positions are in the order of doc_id, reading and a hash of the text, null ids
    first; a null source is a source, and no rows give none.
    """
    own = [c for c in docs.columns if c.lower() not in {"words", "reading", "position"}]
    inner = {name: f"d{i}" for i, name in enumerate(own)}
    mixed = assigned(
        docs.select("doc_id", "source", "text", *[F.col(f"`{c}`").alias(a) for c, a in inner.items()]),
        weights,
        schedules,
        max_reads,
        list(inner.values()),
    )
    readings = F.ceil(F.col("taken") / F.col("size")).cast("int")
    copies = mixed.where("taken > 0").withColumn("reading", F.explode(F.sequence(F.lit(0), readings - 1)))
    words = F.least(F.col("size"), F.col("taken") - F.col("reading") * F.col("size"))
    start = F.col("reading") * F.col("source_size") + F.col("m_from")
    return (
        copies.select(
            *[F.col(a).alias(c) for c, a in inner.items()],
            words.alias("words"),
            "reading",
            due_at(start, words, schedules).alias("position"),
        )
        .orderBy("position", "doc_id", "reading", copies["m_text"])
    )


def mix_report(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, schedules: tuple = SCHEDULES, max_reads: int = MAX_READS) -> DataFrame:
    """Per row doc_id, size, source_size, target, taken and the position of its first reading, in that order.

    Documents that the mix does not take have no position and come last.
    """
    mixed = assigned(docs, weights, schedules, max_reads)
    first = F.least(F.col("size"), F.col("taken"))
    return mixed.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        "taken",
        F.when(F.col("taken") > 0, due_at(F.col("m_from"), first, schedules)).alias("position"),
    ).orderBy(F.col("position").asc_nulls_last(), "doc_id")

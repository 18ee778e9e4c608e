"""Benchmark decontamination by winnowing [native].

Of every WINDOW consecutive words a document is marked by the least hash of the GRAM-word grams within; so is the
benchmark. Equal windows have equal marks, so every shared span of WINDOW words or more is found by joining the distinct
marks of a text, a good quarter of its words. Where marks meet, the windows themselves are compared word by word, and
overlapping ones extend the hit. Benchmark items of fewer words are windows of their own length; the hash of all of
their words is their mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorthread.llm.common import LOWER, UPPER, let, may_match
from sensorthread.session import written

WINDOW = 10
GRAM = 5
#: What separates words, after A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
_SEPARATOR_CHARS = "".join(chr(c) for c in [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: Marks of a text up to which its windows are chosen by looking each up among them.
FEW_MARKS = 64


def bench_words(text: Column) -> Column:
    """The words, an empty array for null. lower() is quicker, but good only if no letter beyond A-Z would change."""
    others = F.rlike(text, F.lit(r"[[\p{IsUppercase}\p{IsTitlecase}]&&[^\x00-\x7F]]"))
    low = F.when(others, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    bare = F.btrim(low, F.lit(_SEPARATOR_CHARS))
    return F.when(F.length(bare) > 0, F.split(bare, SEPARATORS + "+")).otherwise(F.array().cast("array<string>"))


def _joined(left: Column, right: Column, shift: int, join) -> Column:
    """join of left[i] and right[i + shift], wherever both are there."""
    return let(
        F.struct(left.alias("l"), right.alias("r")),
        lambda p: let(
            F.greatest(F.lit(0), F.least(F.size(p["l"]), F.size(p["r"]) - shift)),
            lambda n: F.zip_with(F.slice(p["l"], F.lit(1), n), F.slice(p["r"], F.lit(1 + shift), n), join),
        ),
    )


def _doubled(items: Column, n: int, join, use) -> Column:
    """use(array of what join makes of n neighbours each), by doubling."""

    def rest(array: Column, width: int, powers: dict[int, Column]) -> Column:
        powers = powers | {width: array}
        if 2 * width <= n:
            return let(_joined(array, array, width, join), lambda a: rest(a, 2 * width, powers))
        made, have = powers[width], width
        for w in sorted(powers, reverse=True):
            if w <= n - have:
                made, have = _joined(made, powers[w], have, join), have + w
        return use(made)

    return let(items, lambda a: rest(a, 1, {}))


def grams(words: Column, n: int, use=lambda a: a) -> Column:
    """Hashes of all n consecutive words."""
    return _doubled(F.transform(words, lambda w: F.xxhash64(w)), n, lambda x, y: F.xxhash64(x, y), use)


def marks(words: Column, length: int, window: int, gram: int) -> Column:
    """By start of each window of length words: the least hash of the grams within; if it is shorter than a full
    window, the hash of its words and its length."""
    if length < window:
        return grams(words, length, lambda a: F.transform(a, lambda h: F.xxhash64(h, F.lit(length))))
    return grams(words, gram, lambda a: _doubled(a, window - gram + 1, lambda x, y: F.least(x, y), lambda m: m))


def _windows(words: Column, length: int) -> Column:
    """All windows of length words as text, with their start and length."""
    last = F.size(words) - length
    return F.when(
        last >= 0,
        F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.struct(
                i.alias("start"),
                F.lit(length).alias("length"),
                F.array_join(F.slice(words, i + 1, F.lit(length)), " ").alias("window"),
            ),
        ),
    )


def _marked_windows(words: Column, known: Column, length: int, window: int, gram: int) -> Column:
    """The windows of length words whose mark is known, or all of them if many marks are, with start and length."""

    def chosen(p: Column, found: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(found)),
            lambda i: (i < F.size(found))
            & ((F.size(p["known"]) > FEW_MARKS) | F.array_contains(p["known"], F.get(found, i))),
        )
        return F.transform(
            starts,
            lambda i: F.struct(
                i.alias("start"),
                F.lit(length).alias("length"),
                F.array_join(F.slice(p["words"], i + 1, F.lit(length)), " ").alias("window"),
            ),
        )

    both = F.struct(words.alias("words"), known.alias("known"))
    return let(both, lambda p: let(marks(p["words"], length, window, gram), lambda found: chosen(p, found)))


def _key(text: Column) -> list[Column]:
    """128 bits of the text: texts that are equal are judged once."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("again"), text).alias("k2")]


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per distinct text that holds a window of the benchmark its key (k1, k2), n_hit and the sorted item_ids."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), bench_words(F.col("text")).alias("words"))
    items = items.withColumn("n", F.size("words")).where("n > 0")
    items = written(items, "items")
    # At most window - 1 numbers.
    short = sorted(r["n"] for r in items.where(F.col("n") < window).select("n").distinct().collect())
    lengths = [*short, window]

    def of_items(make) -> Column:
        chain = F.when(F.col("n") >= window, make(window))
        for length in short:
            chain = chain.when(F.col("n") == length, make(length))
        return chain

    item_marks = items.select(
        F.explode(of_items(lambda n: marks(F.col("words"), n, window, gram))).alias("mark")
    ).distinct()
    item_marks = written(item_marks, "item-marks")
    item_windows = items.select("item_id", F.explode(of_items(lambda n: _windows(F.col("words"), n))).alias("w")).select(
        "item_id", F.col("w.window").alias("window")
    )
    item_windows = written(item_windows.distinct(), "item-windows")
    known = written(item_windows.select("window").distinct(), "known-windows")

    texts = docs.where("text IS NOT NULL").select(*_key(F.col("text")), bench_words(F.col("text")).alias("words"))
    words = F.col("words")
    found = texts.select(
        "k1",
        "k2",
        F.explode(
            F.array_distinct(F.flatten(F.array(*[marks(words, n, window, gram) for n in lengths])))
        ).alias("mark"),
    ).join(item_marks, "mark")
    suspects = written(found.groupBy("k1", "k2").agg(F.collect_set("mark").alias("marks")), "suspects")

    # Texts that are no suspects are left where they are.
    again = docs.where("text IS NOT NULL").select(*_key(F.col("text")), "text")
    again = may_match(again, "k1", suspects, "k1").join(suspects, ["k1", "k2"])
    again = again.select("k1", "k2", bench_words(F.col("text")).alias("words"), "marks")
    candidates = F.flatten(F.array(*[_marked_windows(words, F.col("marks"), n, window, gram) for n in lengths]))
    hits = (
        again.select("k1", "k2", F.explode(candidates).alias("c"))
        .select("k1", "k2", "c.start", "c.length", "c.window")
        .join(known, "window")
        .distinct()
    )
    hits = written(hits, "hits")
    covered = F.size(
        F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))))
    )
    reach = (
        hits.groupBy("k1", "k2")
        .agg(F.collect_list(F.struct("start", "length")).alias("spans"))
        .select("k1", "k2", covered.cast("bigint").alias("n_hit"))
    )
    items_of = (
        hits.select("k1", "k2", "window")
        .distinct()
        .join(item_windows, "window")
        .groupBy("k1", "k2")
        .agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    )
    return reach.join(items_of, ["k1", "k2"], "left")


def overlap(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per row doc_id, n_words, n_hit and item_ids (sorted as text, empty without hits).

    A word is hit if it lies in an occurrence of a window of the benchmark: of any window consecutive words of an item,
    or of all words of an item that has fewer. Null and empty texts, and items without words, have no windows; items
    without an id are hit but not listed. Repeated rows are judged alike.
    """
    hits = written(benchmark_hits(docs, benchmark, window, gram), "overlap")
    n_words = F.coalesce(F.size(bench_words(F.col("text"))), F.lit(0)).cast("bigint")
    rows = docs.select("doc_id", n_words.alias("n_words"), *_key(F.col("text")))
    return rows.join(hits, ["k1", "k2"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The rows, with all their columns, that hold no window of the benchmark."""
    hits = written(benchmark_hits(docs, benchmark, window, gram).select("k1", "k2"), "overlap")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(own, *_key(F.col("text")))
    return rows.join(hits, ["k1", "k2"], "left_anti").select("row.*")

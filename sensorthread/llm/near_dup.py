"""Near-duplicates by bottom-k sketches.

The set of a document is that of its word shingles, hashed by one function; its sketch are the k least hashes. Documents
with equal sets form a class. Of each class one sketch goes on:

1. Inverted lists. Two sets at the threshold share at least `least_shared` retained values (but for one pair in 1e9).
   With the values of a sketch ordered from rare to common, such a pair shares one among the first
   size - least_shared + 1 of both. Only these are listed, and only if two classes or more retain them, so passages
   that many documents share make no lists of documents that hold more of their own. Short sketches, of K values, tell
   which classes have a list in common at all. Those, few as they are, get sketches of WIDE values and new lists: these
   part sets that are almost alike, and for sets of up to WIDE shingles they are exact.
2. Each class is compared with the hub of its lists: the class whose values are the most common. Groups of near copies
   become a star around it, and only classes of one list that are not yet in one component are compared otherwise.
   What a list holds outside of its largest component is compared with all of the list.
3. Compared means: the sketch of the union, made from both sketches, estimates the similarity, and what may reach the
   threshold is verified on the full sets.

Classes are known by 64 bits of a 128-bit hash of their set.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensorthread.llm.common import map_batches, may_match
from sensorthread.llm.graph import connected_components
from sensorthread.session import written

#: Values that a sketch retains, at first and for classes that have a list in common.
K = 32
WIDE = 1024
#: Pairs of one hub that are verified together at most.
CHUNK = 256


def least_shared(k: int, threshold: float, risk: float = 1e-9) -> int:
    """So many of the k least hashes of the union of two sets at the threshold lie in both, or more, but for the risk."""
    total = 0.0
    for t in range(k + 1):
        total += math.comb(k, t) * threshold**t * (1 - threshold) ** (k - t)
        if total > risk:
            return t
    return k


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of width words, A-Z lower-cased; all words as one if there are fewer."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.int64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    span = min(n, width)
    mixed = hashes[: n - span + 1] + np.uint64(span)
    for j in range(1, span):
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed += hashes[j : n - span + 1 + j]
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed.view(np.int64))


def sketched(docs: DataFrame, width: int, k: int) -> DataFrame:
    """Per row doc_id, text_hash, n_shingles, class (null without words) and sketch. Runs a job."""

    def columns(doc_id, text_hash, text):
        sets = [shingle_set(t, width) for t in text]
        return {
            "doc_id": doc_id,
            "text_hash": text_hash,
            "n_shingles": [len(s) for s in sets],
            "class": [
                int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=16).digest()[:8], "big", signed=True)
                if len(s)
                else None
                for s in sets
            ],
            "sketch": [s[:k] for s in sets],
        }

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    schema = "doc_id bigint, text_hash bigint, n_shingles bigint, class bigint, sketch array<bigint>"
    return written(map_batches(rows, columns, schema), "sketched")


def inverted_lists(classes: DataFrame, k: int, threshold: float) -> DataFrame:
    """(value, class, n_shingles, weight, place): where a class may find another at the threshold. weight is greater for
    classes whose values are more common, place is the value's among those of the class from rare to common."""
    rows = classes.select("class", "n_shingles", F.explode("sketch").alias("value"))
    holders = rows.groupBy("value").agg(F.count("*").alias("holders")).where("holders > 1")
    own = Window.partitionBy("class")
    size = F.least(F.lit(k), F.col("n_shingles"))
    # A union of more than k shingles has k values in its sketch, a smaller one all of its shingles.
    must_share = F.least(F.lit(least_shared(k, threshold)), F.ceil(F.lit(threshold) * F.col("n_shingles") - 1e-9))
    unshared = size - F.count("*").over(own)
    return (
        rows.join(holders, "value")
        .select(
            "value",
            "class",
            "n_shingles",
            F.sum("holders").over(own).alias("weight"),
            (F.row_number().over(own.orderBy("holders", "value")) + unshared).alias("place"),
            (size - must_share + 1).alias("last"),
        )
        .where("place <= last")
        .drop("last")
    )


def may_reach(pairs: DataFrame, classes: DataFrame, k: int, threshold: float) -> DataFrame:
    """Of the pairs (a, b) of classes those that the sketch of their union lets reach the threshold."""
    sketches = classes.select("class", "sketch")
    both = pairs.join(sketches.toDF("a", "sketch_a"), "a").join(sketches.toDF("b", "sketch_b"), "b")
    union = both.select("a", "b", "sketch_a", "sketch_b", F.array_union("sketch_a", "sketch_b").alias("all"))
    least = union.select(
        "a",
        "b",
        F.size("all").alias("seen"),
        F.size(
            F.array_intersect(
                F.slice(F.sort_array("all"), 1, k), F.array_intersect(F.col("sketch_a"), F.col("sketch_b"))
            )
        ).alias("shared"),
    )
    must_share = F.least(F.lit(least_shared(k, threshold)), F.ceil(F.lit(threshold) * F.col("seen") - 1e-9))
    return least.where(F.col("shared") >= must_share).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame, width: int, part: int, whole: int) -> DataFrame:
    """Of the pairs (a, b) those with whole * intersection >= part * union on their full sets. texts: (class, text).

    The text of a stands before those it is compared with, in partitions of at most CHUNK of them, and the rows are
    read one after the other.
    """
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    dealt = pairs.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("chunks")).alias("chunk"))
    heads = counts.select("a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("chunk"))
    rows = (
        dealt.join(texts.toDF("b", "text"), "b")
        .select("a", "chunk", "b", "text")
        .unionAll(
            heads.join(texts.toDF("a", "text"), "a").select("a", "chunk", F.lit(None).cast("bigint").alias("b"), "text")
        )
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own = None, None
        for batch in batches:
            found_a, found_b = [], []
            for a, b, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if b is None:
                    head, own = a, shingle_set(text, width)
                    continue
                if head != a:
                    raise RuntimeError("the first row of a group is missing")
                other = shingle_set(text, width)
                shared = len(np.intersect1d(own, other, assume_unique=True))
                if whole * shared >= part * (len(own) + len(other) - shared):
                    found_a.append(a)
                    found_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], ["a", "b"])

    ordered = rows.repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())
    return ordered.mapInArrow(compare, "a bigint, b bigint")


def _alike(part: int, whole: int, k: int) -> Column:
    """Can two classes (n_a, n_b) of one list, whose sketches hold its value at place_a and place_b, reach the threshold?

    Their sizes must allow it, and so must the values that come after, if this is the first one they share.
    """
    sizes = F.least("n_a", "n_b") * whole >= F.greatest("n_a", "n_b") * part
    left_a, left_b = (F.least(F.lit(k), F.col(f"n_{x}")) - F.col(f"place_{x}") for x in "ab")
    most = 1 + F.least(left_a, left_b)
    retained = F.least(F.lit(least_shared(k, part / whole)), F.ceil(F.lit(part / whole) * F.greatest("n_a", "n_b") - 1e-9))
    whole_sets = F.greatest("n_a", "n_b") <= k
    return sizes & F.when(whole_sets, most * (part + whole) >= part * (F.col("n_a") + F.col("n_b"))).otherwise(
        most >= retained
    )


def near_duplicates(
    docs: DataFrame, width: int = 5, part: int = 80, whole: int = 100, k: int = K, wide: int = WIDE
) -> DataFrame:
    """Per row doc_id, n_shingles, component_id (least doc_id reachable by links), kept (is it that document), text_hash
    (xxhash64 of the text) and group (a number that the rows of a component share, null without words).

    Documents link if whole * shared shingles >= part * shingles of either. A document without words has an empty set
    and no links. Rows that repeat have equal sets and thus links. A null doc_id is no candidate for the least one: a
    group of null ids alone has a null component and is kept. Other columns are not read.
    """
    threshold = part / whole
    rows = sketched(docs, width, k)
    classes = written(
        rows.where("class IS NOT NULL")
        .groupBy("class")
        .agg(
            F.min("doc_id").alias("least_id"),
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("of"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("sketch").alias("sketch"),
        ),
        "classes",
    )
    near = written(
        classes.select("class", "of").join(_listed(inverted_lists(classes, k, threshold)), "class", "left_semi"), "near"
    )
    texts = written(_texts(docs, near), "texts")
    near = written(_wide(texts, width, wide), "wide")
    lists = written(inverted_lists(near, wide, threshold), "lists")

    hubs = lists.groupBy("value").agg(F.max(F.struct("weight", "class", "n_shingles", "place")).alias("hub"))
    star = (
        lists.join(hubs, "value")
        .select(
            F.col("class").alias("b"),
            F.col("n_shingles").alias("n_b"),
            F.col("place").alias("place_b"),
            "hub",
            F.col("hub.n_shingles").alias("n_a"),
            F.col("hub.place").alias("place_a"),
        )
        .where((F.col("hub.class") != F.col("b")) & _alike(part, whole, wide))
        .groupBy("b")
        .agg(F.max("hub")["class"].alias("a"))
        .select("a", "b")
    )
    star = written(verified(may_reach(star, classes, k, threshold), texts, width, part, whole), "star")
    roots = connected_components(star)
    rest = written(may_reach(_across(lists, roots, part, whole, wide), classes, k, threshold), "rest")
    links = star.unionAll(verified(rest, texts, width, part, whole))
    roots = connected_components(links)

    placed = classes.select(F.col("class"), "least_id").join(
        roots.select(F.col("node").alias("class"), "root"), "class", "left"
    ).select("class", "least_id", F.coalesce("root", "class").alias("root"))
    least = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = placed.join(least, "root").select("class", "component_id", F.col("root").alias("group"))
    with_words = rows.where("class IS NOT NULL").select("doc_id", "text_hash", "n_shingles", "class").join(named, "class")
    return (
        with_words.select("doc_id", "n_shingles", "component_id", "text_hash", "group")
        .unionAll(
            rows.where("class IS NULL").select(
                "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_hash", F.lit(None).cast("bigint")
            )
        )
        .select(
            "doc_id",
            "n_shingles",
            "component_id",
            F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
            "text_hash",
            "group",
        )
    )


def _texts(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, text) from the document that stands for each class; once, even if its row repeats."""
    wanted = classes.select("class", F.col("of.doc_id").alias("c_id"), F.col("of.text_hash").alias("c_hash"))
    found = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    joined = may_match(found, "text_hash", wanted, "c_hash").join(
        wanted, (F.col("text_hash") == F.col("c_hash")) & F.col("doc_id").eqNullSafe(F.col("c_id"))
    ).select("class", "text")
    return joined.groupBy("class").agg(F.first("text").alias("text"))


def keep_one(docs: DataFrame, width: int = 5, part: int = 80, whole: int = 100) -> DataFrame:
    """The rows of docs, with all their columns, without all but one document of each group of near-duplicates.

    The document with the least doc_id stays. Several rows of a group may have that doc_id, or none of its rows has one:
    then the row with the least hash of its text stays. Different texts that share a doc_id are different documents.
    Documents without words (null and empty texts too) stay.
    """
    found = near_duplicates(docs, width, part, whole)
    rows = written(found.select("text_hash", F.col("doc_id").alias("id"), "kept", "group"), "near-duplicates")
    of_text = ["text_hash", "id"]
    gone = rows.where("NOT kept").select(*of_text)
    # Kept rows that meet in one group.
    kept = rows.where("kept AND group IS NOT NULL")
    least = F.min(F.struct(*of_text)).alias("of")
    many = kept.groupBy("group").agg(F.count("*").alias("rows"), least).where("rows > 1")
    doubtful = kept.join(many.select("group"), "group", "left_semi").select(*of_text).distinct()
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(own, F.xxhash64("text").alias("text_hash"), F.col("doc_id").alias("id"))

    def matches(other: DataFrame):
        return (keyed["text_hash"] == other["text_hash"]) & keyed["id"].eqNullSafe(other["id"])

    leave = gone.unionAll(doubtful).distinct()
    sure = keyed.join(leave, matches(leave), "left_anti")
    if doubtful.isEmpty():
        return sure.select("row.*")
    chosen = many.select("of.*")
    settled = keyed.join(chosen, matches(chosen), "left_semi")
    one = Window.partitionBy(*of_text).orderBy("text_hash")
    settled = settled.withColumn("place", F.row_number().over(one)).where("place = 1")
    return sure.select("row.*").unionAll(settled.select("row.*"))


def _listed(lists: DataFrame) -> DataFrame:
    """The classes that are not alone in all of their lists."""
    shared = lists.groupBy("value").agg(F.min("class").alias("first"), F.max("class").alias("last"))
    return lists.join(shared.where("first <> last").select("value"), "value").select("class").distinct()


def _wide(texts: DataFrame, width: int, k: int) -> DataFrame:
    """(class, n_shingles, sketch) of texts, with sketches of k values."""

    def columns(text, **key):
        sets = [shingle_set(t, width) for t in text]
        return key | {"n_shingles": [len(s) for s in sets], "sketch": [s[:k] for s in sets]}

    return map_batches(texts, columns, "class bigint, n_shingles bigint, sketch array<bigint>", ["class", "text"])


def _across(lists: DataFrame, roots: DataFrame, part: int, whole: int, k: int) -> DataFrame:
    """Pairs (a, b) of one list that are in different components, at least one of them outside of its largest."""
    placed = lists.join(roots.select(F.col("node").alias("class"), "root"), "class", "left").withColumn(
        "root", F.coalesce("root", "class")
    )
    counts = placed.groupBy("value", "root").agg(F.count("*").alias("members"))
    main = (
        counts.groupBy("value")
        .agg(F.max(F.struct("members", "root")).alias("main"), F.count("*").alias("roots"))
        .where("roots > 1")
        .select("value", F.col("main.root").alias("main"))
    )
    open_lists = placed.join(main, "value").select("value", "class", "n_shingles", "place", "root", "main")
    outside = open_lists.where("root <> main").select(
        "value",
        F.col("class").alias("a"),
        F.col("n_shingles").alias("n_a"),
        F.col("place").alias("place_a"),
        F.col("root").alias("root_a"),
    )
    others = open_lists.select(
        "value",
        F.col("class").alias("b"),
        F.col("n_shingles").alias("n_b"),
        F.col("place").alias("place_b"),
        F.col("root").alias("root_b"),
        (F.col("root") == F.col("main")).alias("in_main"),
    )
    return (
        outside.join(others, "value")
        .where((F.col("root_a") != F.col("root_b")) & (F.col("in_main") | (F.col("a") < F.col("b"))) & _alike(part, whole, k))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )

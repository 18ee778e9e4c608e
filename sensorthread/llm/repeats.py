"""Substring dedup by level-wise doubling.

Words of a document are removed where a window of `length` words covers them whose words also start anywhere else. The
search goes by levels. At the first, of half that length, windows are not taken at every word: of every full window the
half window with the least hash is marked, which is the same one wherever the full window stands, so that a full window
can only be repeated if its mark is. At the next level those full windows alone are looked at whose mark is repeated.
What survives is repeated; all longer repeats are made of it, so nothing is left to extend to.

A level counts windows by hash, with a map-side combined least and greatest place (text, position) instead of lists: a
window stands alone if both are the same. Places that stand alone go back to their text, which knows all of its places,
so that the many places of a repeated passage never meet. Equal texts have one place, and count as repeated throughout.
Texts are known by a 64-bit hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorthread.llm.common import map_batches
from sensorthread.session import written

LENGTH = 35


def split(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def window_hashes(words: list[bytes], length: int) -> np.ndarray:
    """Hashes of all windows of length words; windows of doubled widths, which overlap in the last step."""
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < length:
        return hashes[:0]
    width = 1
    while width < length:
        step = min(width, length - width)
        hashes = _mixed(hashes[: len(hashes) - step], hashes[step:])
        width += step
    return hashes


def marks(words: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """By start of each full window the start of its mark, and the hashes of all half windows."""
    half = (length + 1) // 2
    if len(words) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    hashes = window_hashes(words, half)
    places = np.empty(len(words) - length + 1, np.int64)
    for at in range(0, len(places), 1 << 16):
        end = min(len(places), at + (1 << 16))
        near = np.lib.stride_tricks.sliding_window_view(hashes[at : end + length - half], length - half + 1)
        places[at:end] = near.argmin(axis=1) + np.arange(at, end)
    return places, hashes


def _alone(windows: DataFrame) -> DataFrame:
    """From (text_hash, starts, hashes, places), one row per text (equal rows may repeat): per text_hash those starts
    whose window stands alone, and `repeated`, whether there are others. places: how many starts there are.

    The number travels as one more place of the text, which stands alone.
    """
    rows = windows.select("text_hash", F.explode(F.arrays_zip("starts", "hashes")).alias("w"))
    rows = rows.select(F.col("w.hashes").alias("h"), "text_hash", F.col("w.starts").alias("start")).unionAll(
        windows.select(F.xxhash64("text_hash", "places"), "text_hash", -1 - F.col("places"))
    )
    single = (
        rows.groupBy("h")
        .agg(
            F.min("text_hash").alias("text_hash"),
            F.max("text_hash").alias("other"),
            F.min("start").alias("start"),
            F.max("start").alias("last"),
        )
        .where("text_hash = other AND start = last")
        .select("text_hash", "start")
    )
    return single.groupBy("text_hash").agg(F.sort_array(F.collect_list("start")).alias("alone")).select(
        "text_hash",
        F.filter("alone", lambda s: s >= 0).alias("alone"),
        (F.size("alone") - 1 < -1 - F.element_at("alone", 1)).alias("repeated"),
    )


_WINDOWS = "text_hash bigint, starts array<int>, hashes array<bigint>, places int"


def _marked(texts: DataFrame, length: int) -> DataFrame:
    """The first level: the marks of every text."""

    def columns(text_hash, text):
        made = {"text_hash": [], "starts": [], "hashes": [], "places": []}
        for key, t in zip(text_hash, text):
            places, hashes = marks(split(t), length)
            if len(places):
                starts = np.unique(places)
                made["text_hash"].append(key)
                made["starts"].append(starts.astype(np.int32))
                made["hashes"].append(hashes[starts].view(np.int64))
                made["places"].append(len(starts))
        return made

    return map_batches(texts, columns, _WINDOWS, ["text_hash", "text"])


def _candidates(words: list[bytes], alone: list[int], length: int) -> np.ndarray:
    """Starts of the full windows whose mark does not stand alone."""
    places, _ = marks(words, length)
    single = np.zeros(len(words) + 1, bool)
    single[alone] = True
    return np.flatnonzero(~single[places])


def _extended(texts: DataFrame, length: int) -> DataFrame:
    """The next level: from (text_hash, text, alone) the full windows whose mark does not stand alone."""

    def columns(text_hash, text, alone):
        made = {"text_hash": text_hash, "starts": [], "hashes": [], "places": []}
        for t, a in zip(text, alone):
            words = split(t)
            starts = _candidates(words, a, length)
            made["starts"].append(starts.astype(np.int32))
            made["hashes"].append(window_hashes(words, length)[starts].view(np.int64))
            made["places"].append(len(starts))
        return made

    return map_batches(texts, columns, _WINDOWS, ["text_hash", "text", "alone"])


def covered(words: list[bytes], starts: np.ndarray, length: int) -> np.ndarray:
    """Which words the windows at starts cover."""
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + length, -1)
    return np.cumsum(edges[:-1]) > 0


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per distinct text with a repeated window: text_hash (xxhash64 of the text), `copies` (how often the text occurs),
    and what says which windows are repeated: `marks_alone` and `windows_alone`, null where all are. See `removed`."""
    texts = docs.where("text IS NOT NULL").select(F.xxhash64("text").alias("text_hash"), "text")
    counts = texts.groupBy("text_hash").agg(F.count("*").alias("copies")).where("copies > 1")
    first = written(_alone(_marked(texts, length)).where("repeated").select("text_hash", "alone"), "first-level")
    found = texts.join(first.where("text_hash IS NOT NULL"), "text_hash")
    second = _alone(_extended(found, length)).where("repeated").select(
        F.col("text_hash"), F.col("alone").alias("windows_alone")
    )
    spans = first.withColumnRenamed("alone", "marks_alone").join(second, "text_hash")
    return spans.join(counts, "text_hash", "full").select(
        "text_hash", F.coalesce("copies", F.lit(1).cast("bigint")).alias("copies"), "marks_alone", "windows_alone"
    )


def removed(words: list[bytes], copies: int, marks_alone, windows_alone, length: int = LENGTH) -> np.ndarray:
    """Which words of a text go."""
    if len(words) < length:
        return np.zeros(len(words), bool)
    if copies > 1:
        return np.ones(len(words), bool)
    starts = _candidates(words, marks_alone, length)
    return covered(words, np.setdiff1d(starts, np.array(windows_alone, np.int64), assume_unique=True), length)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row doc_id, n_words, n_removed and kept_text: the words that stay, joined by a space.

    Windows are judged on the input, those of the same document included, and of repeated rows too. Null and empty texts
    have no words; texts of fewer words than a window stay. Words are what is between white space, unchanged.
    """
    return _applied(docs, length, lambda text: {"kept_text": text}, "kept_text string")


def remove_repeats_digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """As remove_repeats, with kept_sha256 (hexadecimal, of the UTF-8 text) in place of the text."""

    def sha(text: str) -> dict:
        return {"kept_sha256": hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()}

    return _applied(docs, length, sha, "kept_sha256 string")


def _applied(docs: DataFrame, length: int, use, column: str) -> DataFrame:
    """What is made of every text without its repeats: of texts that have some where they meet their spans, of all
    others at once; narrow rows are joined, not texts."""
    name = column.split()[0]
    spans = written(repeated_spans(docs, length), "repeats")

    def whole(doc_id, text_hash, text):
        words = [split(t) for t in text]
        made = [use(b" ".join(w).decode("utf-8", "surrogatepass"))[name] for w in words]
        return {"doc_id": doc_id, "text_hash": text_hash, "n_words": [len(w) for w in words], name: made}

    def cut(text_hash, text, copies, marks_alone, windows_alone):
        gone, made = [], []
        for t, c, m, w in zip(text, copies, marks_alone, windows_alone):
            words = split(t)
            out = removed(words, c, m, w, length)
            gone.append(int(out.sum()))
            kept = b" ".join(word for word, o in zip(words, out) if not o)
            made.append(use(kept.decode("utf-8", "surrogatepass"))[name])
        return {"text_hash": text_hash, "n_removed": gone, f"cut_{name}": made}

    own = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    every = map_batches(own, whole, f"doc_id bigint, text_hash bigint, n_words bigint, {column}")
    changed = own.where("text IS NOT NULL").select("text_hash", "text").join(spans.where("copies > 0"), "text_hash")
    after = map_batches(changed, cut, f"text_hash bigint, n_removed bigint, cut_{column}")
    # Copies of a text have equal rows.
    after = after.groupBy("text_hash").agg(F.max("n_removed").alias("n_removed"), F.max(f"cut_{name}").alias(f"cut_{name}"))
    return every.join(after, "text_hash", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"),
        F.coalesce(f"cut_{name}", name).alias(name),
    )

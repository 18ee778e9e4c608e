"""Which rows may be learned from, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Every fifth document, and those without an id, are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learnable(labels: DataFrame, docs: DataFrame, max_chars: int) -> DataFrame:
    """The labels whose document is there, with a text of max_chars at most: bounds are to be filled by such rows only."""
    fits = docs.where(F.length("text") <= max_chars).select("doc_id").distinct()
    return labels.join(fits, "doc_id", "left_semi")


def least_hashed(ids: DataFrame, n: int) -> DataFrame:
    """The n rows with the least hash of doc_id."""
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def with_text(docs: DataFrame, chosen: DataFrame, max_chars: int) -> DataFrame:
    """The chosen rows (few, by doc_id) with the text and other columns of documents of max_chars at most.

    The chosen rows are broadcast: callers bound their number.
    """
    return docs.where(F.length("text") <= max_chars).join(F.broadcast(chosen), "doc_id")

"""Names of the folders that rows are dealt to by a key, so that a reader of few keys opens few files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folder(letter: str, key: Column) -> Column:
    # The letter keeps names that are digits from being read as numbers.
    return F.coalesce(F.concat(F.lit(letter), F.substring(F.md5(key.cast("string").cast("binary")), 1, 2)), F.lit("none"))


def type_folder(device_type: Column) -> Column:
    """One of 256 folders of device types, or that of no type."""
    return _folder("t", device_type)


def key_folder(key: Column) -> Column:
    """One of 256 folders of keys, or that of no key."""
    return _folder("k", key)

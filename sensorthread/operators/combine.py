"""Union of conformed sources by column name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorthread.functions.labels import common_type


def combine(sources: list[DataFrame]) -> DataFrame:
    """All rows of all sources: columns in the order first seen, a missing column null, and each column of a type
    that holds the values of every source."""
    if not sources:
        raise ValueError("no conformed sources to combine")
    names = list(dict.fromkeys(c for df in sources for c in df.columns))
    if not names:
        raise ValueError("the sources have no columns")
    types = {c: common_type(df.schema[c].dataType for df in sources if c in df.columns) for c in names}
    aligned = [
        df.select(
            *[
                (F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast(types[c]).alias(c)
                for c in names
            ]
        )
        for df in sources
    ]
    return reduce(DataFrame.unionByName, aligned)

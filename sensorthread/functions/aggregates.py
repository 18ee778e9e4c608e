"""Aggregate functions a user may ask for, by name."""

from __future__ import annotations

from pyspark.sql import functions as F

# Accepted names and what they mean.
NAMES = {
    "max": "max",
    "min": "min",
    "mean": "avg",
    "avg": "avg",
    "median": "median",
    "sum": "sum",
    "count": "count",
    "stddev": "stddev",
}

BUILT_IN = {"max": F.max, "min": F.min, "avg": F.avg, "sum": F.sum, "count": F.count, "stddev": F.stddev}


def aggregate_name(name: str) -> str:
    try:
        return NAMES[name.lower()]
    except KeyError:
        raise ValueError(f"unknown aggregate {name!r}; use one of {', '.join(NAMES)}") from None

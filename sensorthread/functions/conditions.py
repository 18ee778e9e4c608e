"""Threshold conditions on the value of a reading."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bound:
    """One side of a range. A value of None or an empty text means the side is open."""

    value: float | str | None = None
    strict: bool = False

    def given(self) -> bool:
        return self.value is not None and self.value != ""


@dataclass(frozen=True)
class Condition:
    """Readings of one property within a range, tied to the condition before by AND or OR."""

    prop: str | None
    lower: Bound = field(default_factory=Bound)
    upper: Bound = field(default_factory=Bound)
    logic: str = "OR"


def _within(lower: Bound, upper: Bound) -> list[Column]:
    number = F.col("property_value").try_cast("double")
    tests = []
    if lower.given():
        low = F.lit(float(lower.value))
        tests.append(number > low if lower.strict else number >= low)
    if upper.given():
        high = F.lit(float(upper.value))
        tests.append(number < high if upper.strict else number <= high)
    return tests


def value_predicate(lower: Bound | None = None, upper: Bound | None = None) -> Column:
    """One range for all properties; with neither side given, everything passes."""
    return reduce(and_, _within(lower or Bound(), upper or Bound()), F.lit(True))


def threshold_predicate(conditions: list[Condition]) -> Column:
    """The conditions as one chain without parentheses, so AND binds tighter than OR."""
    runs: list[list[Column]] = []
    for condition in conditions:
        if not condition.prop:
            continue
        logic = condition.logic.upper()
        if logic not in ("AND", "OR"):
            raise ValueError(f"conditions are tied by AND or OR, not by {condition.logic!r}")
        test = reduce(and_, _within(condition.lower, condition.upper), F.col("property") == condition.prop)
        if runs and logic == "AND":
            runs[-1].append(test)
        else:
            runs.append([test])
    if not runs:
        return F.lit(True)
    return reduce(or_, [reduce(and_, run) for run in runs])

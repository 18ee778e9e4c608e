"""Time arithmetic on zone-free timestamps."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE = 60_000_000
DAY = 86_400_000_000

# Fixed value: minute buckets are counted from 2000-01-03 00:00:00, in microseconds since 1970.
BUCKET_ORIGIN = 946_857_600_000_000


def naive(ts: Column | str) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return ts.cast("timestamp_ntz")


# A text that ends with a zone or an offset, after a time of day.
_WITH_OFFSET = r":\d{2}(\.\d+)?\s*(Z|[+-]\d{2}:?\d{2})\s*$"


def read_time(text: Column) -> Column:
    """A text in an ISO form as a zone-free timestamp, null if it is none. With an offset, it is the moment in UTC,
    whatever the session zone is."""
    seconds = (F.unix_micros(text.try_cast("timestamp")).cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    in_utc = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)
    return F.when(text.rlike(_WITH_OFFSET), in_utc).otherwise(text.try_cast("timestamp_ntz"))


def read_time_as(text: Column, formats: Iterable[str] = ()) -> Column:
    """A text in an ISO form, or else in the first of the formats that fits, as a zone-free timestamp."""
    text = F.trim(text)
    tries = [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats]
    return F.coalesce(read_time(text), *tries)


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a zone-free timestamp, whatever the session zone is."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return (
        F.unix_date(ts.cast("date")).cast("long") * DAY
        + (F.hour(ts) * 60 + F.minute(ts)).cast("long") * MINUTE
        + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    )


def minutes(n: int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(int(n)))


def time_bucket(ts: Column | str, width: int) -> Column:
    """Start of the bucket of `width` minutes that holds `ts`; null stays null."""
    if width <= 0:
        raise ValueError("a bucket needs a width of at least one minute")
    ts = F.col(ts) if isinstance(ts, str) else ts
    into = F.pmod(micros(ts) - F.lit(BUCKET_ORIGIN), F.lit(width * MINUTE))
    seconds = (into.cast("decimal(18,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    return ts - F.make_dt_interval(secs=seconds)

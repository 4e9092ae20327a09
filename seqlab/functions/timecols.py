"""Time helpers (X-01..X-04).

All differences go through ``timestampdiff`` so that they are exact to the
microsecond and independent of the session time zone for ``timestamp_ntz``
inputs, while still working for ``timestamp`` inputs.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def epoch_micros(col) -> Column:
    """Microseconds since 1970-01-01 of a wall-clock timestamp column."""
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH_NTZ), _c(col).cast("timestamp_ntz"))


def micros_between(start, end) -> Column:
    """end - start in microseconds (bigint); null if either side is null."""
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end))


def seconds_between(start, end) -> Column:
    """end - start in seconds as double (X-04, W-02, G-04)."""
    return micros_between(start, end) / F.lit(1_000_000.0)


def parse_timestamp(col, lenient: bool = True) -> Column:
    """X-01 / X-02: text or timestamp -> timestamp_ntz.

    ``lenient`` gives null on unparsable text (X-01); strict raises under
    ANSI mode (X-02).  Timestamp inputs pass through unchanged.
    """
    c = _c(col)
    return c.try_cast("timestamp_ntz") if lenient else c.cast("timestamp_ntz")


def timestamp_from_millis(col) -> Column:
    """X-03: epoch milliseconds -> wall-clock timestamp (no zone shift)."""
    return F.timestamp_add("MILLISECOND", _c(col).cast("long"), F.expr(_EPOCH_NTZ))


def ts_text(col) -> Column:
    """Fixed-width text form of a timestamp, used for hash-stable outputs."""
    return F.date_format(_c(col), "yyyy-MM-dd HH:mm:ss.SSSSSS")

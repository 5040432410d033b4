"""Time-interval column expressions.

Intervals are closed ``[start_us, end_us]`` in epoch microseconds (BIGINT);
an instant has ``start_us == end_us``.  Every expression here is a native
Catalyst expression, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICROS_PER_SECOND = 1_000_000
MICROS_PER_DAY = 86_400 * MICROS_PER_SECOND

# Fixed value: the text layout of the time columns in the tab-separated input.
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"

_EPOCH_NTZ = "timestamp_ntz'1970-01-01 00:00:00'"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_us_ntz(c) -> Column:
    """Epoch microseconds of a TIMESTAMP_NTZ; independent of the session zone."""
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH_NTZ), _col(c))


def from_epoch_us_ntz(c) -> Column:
    """Epoch microseconds -> TIMESTAMP_NTZ wall clock (inverse of ``epoch_us_ntz``)."""
    return F.timestamp_add("MICROSECOND", _col(c), F.expr(_EPOCH_NTZ))


def epoch_us_ltz(c) -> Column:
    """Epoch microseconds of a TIMESTAMP (instant)."""
    return F.unix_micros(_col(c))


def epoch_us(df: DataFrame, name: str) -> Column:
    """Epoch microseconds of column ``name`` whatever its timestamp flavour."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.TimestampNTZType):
        return epoch_us_ntz(name)
    if isinstance(dtype, T.TimestampType):
        return epoch_us_ltz(name)
    if isinstance(dtype, T.DateType):
        return epoch_us_ntz(F.col(name).cast("timestamp_ntz"))
    if isinstance(dtype, (T.LongType, T.IntegerType)):
        return F.col(name).cast("bigint")
    raise TypeError(f"column {name} has type {dtype}, not a time")


def parse_time(c, fmt: str = TIME_FORMAT) -> Column:
    """Text in ``fmt`` -> epoch microseconds, read as wall-clock time without a
    zone (the same value in every session zone)."""
    return epoch_us_ntz(F.to_timestamp_ntz(_col(c), F.lit(fmt)))


def try_parse_time(c, fmt: str = TIME_FORMAT) -> Column:
    """``parse_time`` with NULL for text that is no time in ``fmt`` (read at offset
    zero, so the session zone plays no part)."""
    return F.unix_micros(F.try_to_timestamp(F.concat(_col(c), F.lit(" +0000")), F.lit(fmt + " xx")))


def expand_time(start, end, delta_us: int) -> tuple[Column, Column]:
    """Widen ``[start, end]`` by ``delta_us`` on both sides."""
    return _col(start) - F.lit(delta_us), _col(end) + F.lit(delta_us)


def overlaps(s1, e1, s2, e2) -> Column:
    """Closed-interval overlap: ``s1 <= e2 and e1 >= s2``."""
    return (_col(s1) <= _col(e2)) & (_col(e1) >= _col(s2))


def time_reference_point(s1, e1, s2, e2) -> Column:
    """The later of the two starts when the intervals overlap, else NULL."""
    return F.when(overlaps(s1, e1, s2, e2), F.greatest(_col(s1), _col(s2)))


def centre_t(start, end) -> Column:
    """Mid time, floored (arithmetic shift keeps floor semantics below 0)."""
    return F.shiftright(_col(start) + _col(end), 1)


def floor_div(c, w: int) -> Column:
    """Exact integer ``floor(c / w)`` for BIGINT ``c`` and positive ``w``.

    ``c - pmod(c, w)`` is an exact multiple of ``w``; integral division keeps
    every BIGINT exact."""
    c = _col(c)
    w = F.lit(int(w)).cast("bigint")
    return F.call_function("div", c - F.pmod(c, w), w)


def ceil_div(c, w: int) -> Column:
    """Exact integer ``ceil(c / w)`` for BIGINT ``c`` and positive ``w``."""
    return -floor_div(-_col(c), w)


def bound_contains_time(t, start, end) -> Column:
    """Half-open period membership ``start <= t < end`` (one owner per instant)."""
    return (_col(t) >= _col(start)) & (_col(t) < _col(end))


def bound_contains_range(s, e, period_start, period_end) -> Column:
    """Strict containment of ``[s, e]`` in a period: ``s > start and e < end``."""
    return (_col(s) > _col(period_start)) & (_col(e) < _col(period_end))

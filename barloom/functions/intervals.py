"""Bar intervals such as ``5m`` or ``1M`` as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of a unit; a month has no fixed length and counts as 30 days here.
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800, "M": 2592000}
PATTERN = r"^([1-9][0-9]*)([mhdwM])$"


def _column(interval: Column | str) -> Column:
    return F.lit(interval) if isinstance(interval, str) else interval


def is_supported(interval: Column | str) -> Column:
    return _column(interval).rlike(PATTERN)


def parts(interval: Column | str) -> tuple[Column, Column]:
    c = _column(interval)
    return F.regexp_extract(c, r"^([0-9]+)", 1).try_cast("int"), F.regexp_extract(c, r"([smhdwM])$", 1)


def interval_seconds(interval: Column | str) -> Column:
    """Nominal seconds of an interval; null if it is none."""
    n, unit = parts(interval)
    size = F.coalesce(*[F.when(unit == u, F.lit(s)) for u, s in UNIT_SECONDS.items()])
    return n.cast("long") * size


def next_open_time(open_time: Column, interval: Column | str) -> Column:
    """Where the next bar of the calendar grid opens: months end-of-month clamped; null if the
    interval is not one of minutes, hours, days, weeks or months."""
    n, unit = parts(interval)
    fixed = open_time + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), interval_seconds(interval).cast("decimal(18,6)"))
    month = open_time + F.make_ym_interval(F.lit(0), n)
    return F.when(is_supported(interval), F.when(unit == "M", month).otherwise(fixed))

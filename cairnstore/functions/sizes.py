"""Byte sizes, durations, counters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KB", "MB", "GB", "TB")


def readable(size: Column) -> Column:
    """`1.5 KB`: one decimal, dropped where it is 0; `0` for nothing or less; nothing above TB."""
    power = F.least(sum((F.when(size >= 1024**k, 1).otherwise(0) for k in range(1, len(UNITS))), F.lit(0)), F.lit(len(UNITS) - 1))
    value = F.round(size / F.pow(F.lit(1024.0), power), 1)
    shown = F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(F.format_string("%.1f", value))
    return F.when(size <= 0, "0").otherwise(F.concat(shown, F.lit(" "), F.element_at(F.array(*map(F.lit, UNITS)), power.cast("int") + 1)))


def parse(text: Column) -> Column:
    """Bytes of `1.5 MB`, `102.4kB`, `512B`; -1 if the text holds no size."""
    pattern = r"(?i)([0-9]+(?:\.[0-9]+)?)\s*([KMGT]?)B"
    number, unit = F.regexp_extract(text, pattern, 1), F.upper(F.regexp_extract(text, pattern, 2))
    power = F.when(unit == "K", 1).when(unit == "M", 2).when(unit == "G", 3).when(unit == "T", 4).otherwise(0)
    return F.when(number == "", F.lit(-1)).otherwise(F.floor(F.try_to_number(number, F.lit("999999999999999.999999")).cast("double") * F.pow(F.lit(1024.0), power))).cast("long")


def duration(ms: Column) -> Column:
    """`250 ms`, `12.50 s` or `1d 02:03:04`."""
    s = F.floor(ms / 1000).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    clock = F.concat_ws(":", two(F.floor(s % 86400 / 3600)), two(F.floor(s % 3600 / 60)), two(s % 60))
    days = F.floor(s / 86400)
    return (
        F.when(ms < 1000, F.concat(ms.cast("string"), F.lit(" ms")))
        .when(ms < 60_000, F.format_string("%.2f s", ms / 1000.0))
        .when(days > 0, F.concat(days.cast("string"), F.lit("d "), clock))
        .otherwise(clock)
    )


def percent(now: Column, most: Column) -> Column:
    """Whole percent of a counter, 0 where there is no maximum."""
    return F.when(most > 0, F.floor(now * 100 / most)).otherwise(0).cast("int")


def eta_seconds(now: Column, most: Column, gained: Column, seconds: Column) -> Column:
    """Time left at the rate of a window; null where nothing was gained."""
    return F.when((gained > 0) & (seconds > 0), F.greatest(most - now, F.lit(0)) * seconds / gained)

"""Sizes, rates, durations and other values as people read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenlake.constants import SIZE_UNITS
from lumenlake.functions.numbers import div


def format_size(size: Column) -> Column:
    """Bytes in the largest fitting unit with at most one decimal (STR11)."""
    result = F.concat(size.cast("string"), F.lit(" " + SIZE_UNITS[0]))
    for power, name in enumerate(SIZE_UNITS[1:], start=1):
        unit = 1024 ** power
        rest = F.pmod(size, F.lit(unit))
        tenths = div(size, unit) * 10 + div(rest * 20 + F.lit(unit), 2 * unit)
        digit = F.pmod(tenths, F.lit(10))
        text = F.concat(
            div(tenths, 10).cast("string"),
            F.when(digit > 0, F.concat(F.lit("."), digit.cast("string"))).otherwise(""),
            F.lit(" " + name),
        )
        result = F.when(size >= F.lit(unit), text).otherwise(result)
    return result


def format_eta(seconds: Column) -> Column:
    """``H:MM:SS`` from one hour on, else ``M:SS``; nothing known is ``--:--`` (STR12)."""
    hours = div(seconds, 3600)
    minutes = div(F.pmod(seconds, F.lit(3600)), 60)
    secs = F.pmod(seconds, F.lit(60))
    return (
        F.when(seconds.isNull() | (seconds == 0), F.lit("--:--"))
        .when(hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, secs))
        .otherwise(F.format_string("%d:%02d", minutes, secs))
    )


def format_speed(speed: Column) -> Column:
    return F.format_string("%.1f files/sec", speed)


def format_megabytes(size: Column) -> Column:
    return F.format_string("%.2f MB", size / F.lit(1048576.0))


def format_dimensions(width: Column, height: Column) -> Column:
    """``W×H`` when both sides are known and not zero (STR14)."""
    return F.when((width > 0) & (height > 0), F.format_string("%d×%d", width, height))


def format_day(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd")


def throughput(done: Column, elapsed: Column) -> Column:
    """Files per second, 0 before the clock has moved (MTH1)."""
    return F.when(elapsed > 0, done / elapsed).otherwise(F.lit(0.0))


def eta_seconds(done: Column, total: Column, speed: Column) -> Column:
    """Whole seconds left at the present speed; unknown at speed 0 (MTH2)."""
    return F.when(speed > 0, F.floor((total - done) / speed).cast("long"))


def percent(current: Column, total: Column) -> Column:
    """Share done in whole percent, half rounded up (MTH3)."""
    return F.when(total == 0, F.lit(0)) \
        .otherwise(F.floor(current / total * 100 + 0.5)).cast("long")

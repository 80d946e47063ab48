"""Capture time and date folders."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenlake.functions.text import trim_unicode

# First character (from 1), length and accepted form of the six fields.
_FIELDS = [
    (1, 4, r"^[+-]?[0-9]+$"),
    (6, 2, r"^\+?[0-9]+$"),
    (9, 2, r"^\+?[0-9]+$"),
    (12, 2, r"^\+?[0-9]+$"),
    (15, 2, r"^\+?[0-9]+$"),
    (18, 2, r"^\+?[0-9]+$"),
]


def parse_capture_time(text: Column) -> Column:
    """Capture-time tag text to a UTC timestamp, null when it is not one (DAT1).

    Fields sit at fixed places; separators and any tail are not looked at.
    """
    head = trim_unicode(text)
    parts, sound = [], head.rlike(r"(?s)^[\x00-\x7F]{19}")
    for start, length, form in _FIELDS:
        piece = F.substring(head, start, length)
        sound = sound & piece.rlike(form)
        parts.append(piece.try_cast("int"))
    sound = sound & (parts[5] <= 59)
    return F.when(sound, F.try_make_timestamp(*parts, F.lit("UTC")))


def capture_day(date_taken: Column, as_of: dt.date | None = None) -> Column:
    """Capture date; files without one count as of ``as_of``, by default today (DAT3)."""
    fallback = F.current_date() if as_of is None else F.lit(as_of)
    return F.coalesce(F.to_date(date_taken), fallback)


def date_folder(day: Column, style: str) -> Column:
    """Folder of a day in one of the four styles (DAT2)."""
    year = F.year(day).cast("string")
    month = F.lpad(F.month(day).cast("string"), 2, "0")
    dom = F.lpad(F.dayofmonth(day).cast("string"), 2, "0")
    if style == "yearMonthDay":
        return F.concat_ws("/", year, month, dom)
    if style == "yearMonth":
        return F.concat_ws("/", year, month)
    if style == "yearOnly":
        return year
    if style == "flatDate":
        return F.concat_ws("-", year, month, dom)
    raise ValueError(f"unknown date folder style {style!r}")

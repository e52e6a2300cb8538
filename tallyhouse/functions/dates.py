"""Helpers for text dates (`yyyyMMdd`), times (`HHmmss`) and timestamps (`yyyyMMddHHmmss`).

The display helpers cut text and so never fail on odd input; only `parse_stamp` checks the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Open-ended bounds of a text date range.
FIRST_DATE = "00010101"
LAST_DATE = "99991231"

# Month names of the screen date format, January first.
MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def dashed_date(date: Column) -> Column:
    """`yyyyMMdd` to `yyyy-MM-dd`."""
    return F.concat_ws("-", F.substring(date, 1, 4), F.substring(date, 5, 2), F.substring(date, 7, 2))


def colon_time(time: Column) -> Column:
    """`HHmmss` to `HH:mm:ss`."""
    return F.concat_ws(":", F.substring(time, 1, 2), F.substring(time, 3, 2), F.substring(time, 5, 2))


def readable_stamp(stamp: Column) -> Column:
    """`yyyyMMddHHmmss` to `yyyy-MM-dd HH:mm:ss`; the time is the last six characters."""
    return F.concat_ws(" ", dashed_date(stamp), colon_time(F.right(stamp, F.lit(6))))


def screen_date(date: Column) -> Column:
    """`yyyyMMdd` to `Mon dd, yyyy`."""
    month = F.substring(date, 5, 2).try_cast("int")
    name = F.coalesce(F.get(F.array(*[F.lit(m) for m in MONTH_NAMES]), month - 1), F.lit("undefined"))
    return F.when(date.isNotNull(), F.concat(name, F.lit(" "), F.right(date, F.lit(2)), F.lit(", "), F.substring(date, 1, 4)))


def parse_stamp(stamp: Column) -> Column:
    """`yyyyMMddHHmmss` as a timestamp without zone; null for text that is no valid time."""
    return F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")


def parse_date(date: Column) -> Column:
    """`yyyyMMdd` as a date; null for text that is no valid date."""
    return F.try_to_timestamp(date, F.lit("yyyyMMdd")).cast("date")


def sheet_title(stamp: Column) -> Column:
    """Title of an order sheet: day of month with its suffix, then the time.

    Only days 1, 2 and 3 take st, nd and rd; 21, 22, 23 and 31 keep th.
    """
    day = F.substring(stamp, 7, 2).cast("int")
    suffix = F.when(day == 1, "st").when(day == 2, "nd").when(day == 3, "rd").otherwise("th")
    return F.concat(day.cast("string"), suffix, F.lit(" "), colon_time(F.substring(stamp, 9, 6)))

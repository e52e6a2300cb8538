"""Clock punches and their two-week pay periods."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.dates import parse_date, readable_stamp
from tallyhouse.plans.employees import UNKNOWN_ID
from tallyhouse.sources.tables import Tables

PERIOD_DAYS = 14

# Code and text of the refusal.
BAD_TIME = (100, "DateTime('yyyymmddhhmiss') format is incorrect.")


def well_formed(stamp: Column) -> Column:
    return F.coalesce(F.length(stamp), F.lit(0)) == 14


def accepted_punches(t: Tables, punches: DataFrame) -> DataFrame:
    """Punches with a 14-character time of a known employee. Stateless, so it also runs on a stream."""
    return (
        punches.filter(well_formed(F.col("PUNCH_DTTM")))
        .join(t.users.select("EMPLOYEE_ID"), "EMPLOYEE_ID", "left_semi")
        .select("EMPLOYEE_ID", "PUNCH_DTTM", readable_stamp(F.col("PUNCH_DTTM")).alias("PUNCH_TIME"))
    )


class Punches(NamedTuple):
    accepted: DataFrame
    rejects: DataFrame


def punches_valid(t: Tables, punches: DataFrame) -> Punches:
    """Accepted punches with a readable time, and the refused ones with the reason."""

    def refused(rows: DataFrame, reason: tuple[int, str]) -> DataFrame:
        return rows.select("EMPLOYEE_ID", "PUNCH_DTTM", F.lit(reason[0]).alias("CODE"), F.lit(reason[1]).alias("STATUS"))

    good_time = well_formed(F.col("PUNCH_DTTM"))
    strangers = punches.filter(good_time).join(t.users.select("EMPLOYEE_ID"), "EMPLOYEE_ID", "left_anti")
    rejects = refused(punches.filter(~good_time), BAD_TIME).union(refused(strangers, UNKNOWN_ID))
    return Punches(accepted_punches(t, punches), rejects)


def period_label(number: Column, first_day: Column) -> Column:
    """Name of a pay period: two-digit number, first and last day."""
    last_day = F.date_add(first_day, PERIOD_DAYS - 1)
    return F.concat(
        F.lpad((number % 100).cast("string"), 2, "0"), F.lit(" ["), F.date_format(first_day, "MM/dd"), F.lit(" - "),
        F.date_format(last_day, "MM/dd"), F.lit("] Employee Clock In Table"),
    )


def with_pay_period(punches: DataFrame, anchor: str, first_number: int = 1) -> DataFrame:
    """Adds PERIOD_NO, PERIOD_FROM and PERIOD_LABEL to accepted punches.

    Periods follow each other without gap: each starts the day after the one before ends. The one
    that starts on `anchor` (`yyyy-MM-dd`) has `first_number`. The number is computed from the
    date, so no punches have to be compared. A time that is no valid date has no period.
    """
    start = F.lit(anchor).cast("date")
    elapsed = F.floor(F.date_diff(parse_date(F.substring("PUNCH_DTTM", 1, 8)), start) / PERIOD_DAYS).cast("int")
    return (
        punches.withColumn("PERIOD_NO", elapsed + first_number)
        .withColumn("PERIOD_FROM", F.date_add(start, elapsed * PERIOD_DAYS))
        .withColumn("PERIOD_LABEL", period_label(F.col("PERIOD_NO"), F.col("PERIOD_FROM")))
    )


def next_period(title: Column, year: Column) -> Column:
    """The period after the one a table's title names, as (PERIOD_FROM, PERIOD_LABEL).

    A title has no year; `year` is that of its last day. The new period starts the day after and has the next number, two digits of it.
    Null for a title without two days.
    """
    days = F.regexp_extract_all(title, F.lit(r"[0-9]{2}/[0-9]{2}"), F.lit(0))
    last_day = F.try_to_timestamp(F.concat(year.cast("string"), F.lit("/"), F.get(days, F.lit(1))), F.lit("yyyy/MM/dd")).cast("date")
    first = F.date_add(last_day, 1)
    number = F.trim(F.substring(title, 1, 2)).try_cast("int") + 1
    return F.when(last_day.isNotNull(), F.struct(first.alias("PERIOD_FROM"), period_label(number, first).alias("PERIOD_LABEL")))


def punch_pay_periods(t: Tables, punches: DataFrame, anchor: str, first_number: int = 1) -> DataFrame:
    """Accepted punches with their pay period."""
    return with_pay_period(accepted_punches(t, punches), anchor, first_number)

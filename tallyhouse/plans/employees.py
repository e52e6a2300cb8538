"""Employee look-ups and batch changes."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.text import filled, is_blank
from tallyhouse.operators.keyed import Keys, restrict, single_match, splittable
from tallyhouse.sources.tables import Tables

EMPLOYEE_COLUMNS = ["EMPLOYEE_ID", "FIRST_NAME", "LAST_NAME", "DEPARTMENT_NAME", "LAST_LOGIN_DTTM"]
PATCH_COLUMNS = ["FIRST_NAME", "MIDDLE_NAME", "LAST_NAME", "DEPARTMENT_NAME"]

# Code and text of each refusal.
EMPTY_ID = (400, "Employee id should not be empty.")
EMPTY_NAME = (400, "Length of name should be longer than zero.")
EXISTS = (100, "Employee id exists in the system.")
UNKNOWN_ID = (100, "Employee id doesn't exist in the system.")


def employees(t: Tables) -> DataFrame:
    return t.users.select(*EMPLOYEE_COLUMNS)


def employee_by_id(t: Tables, ids: Keys = None) -> DataFrame:
    """Employees whose id is wanted and occurs exactly once; also the log-in check."""
    return single_match(restrict(employees(t), "EMPLOYEE_ID", ids), ["EMPLOYEE_ID"])


def employee_misses(t: Tables, ids: DataFrame) -> DataFrame:
    """Wanted ids that `employee_by_id` cannot answer, with code and text."""
    wanted = ids.select(F.col(ids.columns[0]).alias("EMPLOYEE_ID")).distinct()
    text = F.concat(F.lit("Can't find employee data with id "), F.coalesce("EMPLOYEE_ID", F.lit("")))
    return wanted.join(employee_by_id(t, ids), "EMPLOYEE_ID", "left_anti").select(
        "EMPLOYEE_ID", F.lit(100).alias("CODE"), text.alias("STATUS")
    )


def _refusal(reasons: list[tuple[Column, tuple[int, str]]]) -> Column:
    """The first reason that holds, as a struct of CODE and STATUS."""
    return F.coalesce(*[
        F.when(holds, F.struct(F.lit(code).alias("CODE"), F.lit(text).alias("STATUS"))) for holds, (code, text) in reasons
    ])


def _nameless() -> Column:
    return is_blank(F.col("FIRST_NAME")) & is_blank(F.col("MIDDLE_NAME")) & is_blank(F.col("LAST_NAME"))


def _known(t: Tables) -> DataFrame:
    return splittable(t.users.select("EMPLOYEE_ID", F.lit(True).alias("_known")).distinct(), "EMPLOYEE_ID")


def _rejects(judged: DataFrame) -> DataFrame:
    return judged.filter("_refused is not null").select("REQUEST_SEQ", "EMPLOYEE_ID", "_refused.CODE", "_refused.STATUS")


class NewEmployees(NamedTuple):
    added: DataFrame
    rejects: DataFrame


def judged_additions(t: Tables, requests: DataFrame, now: str) -> DataFrame:
    """Every addition request with CODE and STATUS of its refusal, which are null where it is accepted, and the row it adds.

    An empty id, a request without any name, and an id that exists are refused. Within a batch the request with the lowest REQUEST_SEQ takes
    the id and later ones find it taken; a missing number comes last. Equal numbers are settled by the names, and of requests equal in
    all of that one takes the id. Requests are counted before they meet, so very many for one id are no hot key.
    """
    judged = requests.join(_known(t), "EMPLOYEE_ID", "left").withColumn("_refused", _refusal([
        (is_blank(F.col("EMPLOYEE_ID")), EMPTY_ID),
        (_nameless(), EMPTY_NAME),
        (F.col("_known"), EXISTS),
    ]))
    own = ["REQUEST_SEQ", "EMPLOYEE_ID", *PATCH_COLUMNS]
    place = F.struct(F.col("REQUEST_SEQ").isNull(), "REQUEST_SEQ", *PATCH_COLUMNS)
    counted = judged.groupBy(*own, "_refused").agg(F.count("*").alias("_copies"))
    takers = counted.filter("_refused is null").groupBy("EMPLOYEE_ID").agg(F.min(place).alias("_taker"))
    counted = counted.join(splittable(takers, "EMPLOYEE_ID"), "EMPLOYEE_ID", "left")
    # The first copy of the taker is accepted; all that is left is refused.
    taker = F.col("_refused").isNull() & place.eqNullSafe(F.col("_taker"))
    first = F.when(taker, 1).otherwise(0)
    each = counted.withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    refused = F.when(F.col("_nth") > first, F.coalesce("_refused", _refusal([(F.lit(True), EXISTS)])))
    return each.withColumn("_refused", refused).select(
        *own, F.lit(now).alias("LAST_LOGIN_DTTM"), F.col("_refused.CODE").alias("CODE"), F.col("_refused.STATUS").alias("STATUS"))


def add_employees(t: Tables, requests: DataFrame, now: str) -> NewEmployees:
    """Rows to append to the employee table, and refused requests: `judged_additions` in two."""
    judged = judged_additions(t, requests, now)
    return NewEmployees(
        judged.filter("CODE is null").select("EMPLOYEE_ID", *PATCH_COLUMNS, "LAST_LOGIN_DTTM"),
        judged.filter("CODE is not null").select("REQUEST_SEQ", "EMPLOYEE_ID", "CODE", "STATUS"),
    )


class ModifiedEmployees(NamedTuple):
    employees: DataFrame
    rejects: DataFrame


def modify_employees(t: Tables, requests: DataFrame, now: str) -> ModifiedEmployees:
    """The employee table after a batch of patches, and refused requests.

    An empty or absent value keeps what is there. Several patches of one employee apply in
    REQUEST_SEQ order, so each column ends with the last value given.
    """
    judged = requests.join(_known(t), "EMPLOYEE_ID", "left").withColumn("_refused", _refusal([
        (is_blank(F.col("EMPLOYEE_ID")), EMPTY_ID),
        (_nameless(), EMPTY_NAME),
        (F.col("_known").isNull(), UNKNOWN_ID),
    ]))

    def last_given(column: str) -> Column:
        given = filled(F.col(column))
        return F.max_by(given, F.when(given.isNotNull(), F.struct("REQUEST_SEQ", given))).alias(column)

    patches = judged.filter("_refused is null").groupBy("EMPLOYEE_ID").agg(*[last_given(c) for c in PATCH_COLUMNS])
    merged = t.users.join(patches.select("EMPLOYEE_ID", F.struct(*PATCH_COLUMNS).alias("_new")), "EMPLOYEE_ID", "left")
    changed = {c: F.coalesce(f"_new.{c}", c) for c in PATCH_COLUMNS}
    changed["LAST_LOGIN_DTTM"] = F.when(F.col("_new").isNotNull(), F.lit(now)).otherwise(F.col("LAST_LOGIN_DTTM"))
    return ModifiedEmployees(merged.withColumns(changed).select(*t.users.columns), _rejects(judged))

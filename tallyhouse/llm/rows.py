"""Rows that pass through a function over Arrow batches as one struct, so that no column's name can clash with those the function works with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def beside(frame: DataFrame, columns: list[str], **more: Column) -> DataFrame:
    """`row`, a struct of the given columns, and the named columns."""
    return frame.select(F.struct(*(F.col("`" + c.replace("`", "``") + "`").alias(c) for c in columns)).alias("row"), *(value.alias(name) for name, value in more.items()))


def with_row(frame: DataFrame, added: str) -> StructType:
    """The schema of `row` as in the frame, and of further columns given as DDL."""
    return StructType([frame.schema["row"], *StructType.fromDDL(added).fields])


def spread(frame: DataFrame) -> DataFrame:
    """The columns in `row`, then the others."""
    return frame.select("row.*", *(F.col(c) for c in frame.columns if c != "row"))

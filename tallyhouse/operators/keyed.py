"""Picks, lookups and updates by key."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

Keys = str | int | DataFrame | None


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in `order`.

    Spark limits each map task to one row per key before the shuffle (WindowGroupLimit), so a hot
    key ships at most one row per task.
    """
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(ranked)).filter("_rank = 1").drop("_rank")


def single_match(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key occurs exactly once.

    One pre-aggregated shuffle: for a key that occurs once, `first` is that row.
    """
    others = [c for c in rows.columns if c not in keys]
    once = rows.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in others])
    return once.filter("_n = 1").select(*rows.columns)


def splittable(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows whose partitioning by the keys is hidden from the planner, given that one key is text.

    AQE splits a hot join key only where both sides come straight from a shuffle. An aggregated or
    ranked side is already partitioned by the key and gets none, so the other side's hot key stays
    in one task. Rewriting the key as an equal expression makes the planner shuffle this (reduced)
    side once more and the join becomes splittable. A side small enough is still broadcast.
    """
    text = next((k for k in keys if isinstance(rows.schema[k].dataType, StringType)), None)
    return rows.withColumn(text, F.concat(F.col(text), F.lit(""))) if text else rows


def distinct_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The distinct keys of rows, as the side that is only looked up in semi and anti joins.

    Copies meet in the map-side aggregate, so a hot key on the looked-up side costs one row per task.
    """
    return splittable(rows.select(*keys).distinct(), *keys)


def restrict(rows: DataFrame, column: str, wanted: Keys) -> DataFrame:
    """Rows whose `column` is wanted: one value, a one-column frame of values, or None for all."""
    if wanted is None:
        return rows
    if isinstance(wanted, DataFrame):
        keys = wanted.select(F.col(wanted.columns[0]).cast(rows.schema[column].dataType).alias(column))
        return rows.join(distinct_keys(keys, [column]), column, "left_semi")
    return rows.filter(F.col(column) == F.lit(wanted))


def _any_of(conditions: Sequence[Column]) -> Column:
    """True where one of them is; as a tree of little depth."""
    if len(conditions) < 3:
        return conditions[0] if len(conditions) == 1 else conditions[0] | conditions[1]
    half = len(conditions) // 2
    return _any_of(conditions[:half]) | _any_of(conditions[half:])


def looked_up(rows: DataFrame, keys: DataFrame, columns: Sequence[str], most: int = 200) -> DataFrame:
    """Rows whose `columns` are among those of `keys`, as a semi join gives them.

    Up to `most` different keys are read first and become equality filters, which reach the files: row groups without the keys are
    left out by their bounds and bloom filters. More keys are joined. Null keys match nothing.
    """
    typed = keys.select(*[F.col(c).cast(rows.schema[c].dataType).alias(c) for c in columns]).dropna(subset=list(columns))
    wanted = typed.distinct().limit(most + 1).collect()  # `most` + 1 rows at most
    if len(wanted) > most:
        return rows.join(distinct_keys(typed, columns), list(columns), "left_semi")
    if not wanted:
        return rows.filter(F.lit(False))
    matches = []
    for key in sorted(wanted):
        match = F.col(columns[0]) == F.lit(key[0])
        for column, value in zip(columns[1:], key[1:], strict=True):
            match = match & (F.col(column) == F.lit(value))
        matches.append(match)
    return rows.filter(_any_of(matches))


def between_dates(rows: DataFrame, column: str, start: str, end: str) -> DataFrame:
    """Rows of an inclusive range of text dates.

    On a table partitioned by ORDER_MONTH a range of order dates also prunes directories.
    """
    rows = rows.filter(F.col(column).between(F.lit(start), F.lit(end)))
    if column == "ORDER_DATE" and "ORDER_MONTH" in rows.columns:
        rows = rows.filter(F.col("ORDER_MONTH").cast("string").between(start[:6], end[:6]))
    return rows


class Changed(NamedTuple):
    """What an update of a stored table did."""

    partitions: list
    rows: int


def latest_per_key(changes: DataFrame, keys: Sequence[str], columns: Sequence[str], order: str) -> DataFrame:
    """The keys with `_new`, the values of the latest change. `order` numbers the changes; equal numbers are settled by the values, so
    that the result does not depend on row order."""
    return first_per_key(
        changes.select(*keys, order, *columns),
        keys,
        [F.col(order).desc()] + [F.col(c).desc() for c in columns],
    ).select(*keys, F.struct(*columns).alias("_new"))


def changed_rows(base: DataFrame, latest: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The rows of `base` that `apply_latest` would give other values."""
    same = F.struct(*columns).eqNullSafe(F.col("_new"))
    return base.join(splittable(latest, *keys), list(keys)).filter(~same).select(*base.columns)


def apply_latest(base: DataFrame, latest: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """`apply_changes` with the result of `latest_per_key`."""
    return _taken(_with_new(base, latest, keys), base, columns)


def _with_new(base: DataFrame, latest: DataFrame, keys: Sequence[str]) -> DataFrame:
    return base.join(splittable(latest, *keys), list(keys), "left")


def _taken(merged: DataFrame, base: DataFrame, columns: Sequence[str]) -> DataFrame:
    return merged.select(*[
        F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
        for c in base.columns
    ])


def apply_changes(base: DataFrame, changes: DataFrame, keys: Sequence[str], columns: Sequence[str], order: str) -> DataFrame:
    """`base` with `columns` replaced from the latest change of each key; other rows unchanged.

    Changes are reduced to one row per key before the join; a small batch is then broadcast by size and the base table is not shuffled.
    """
    return apply_latest(base, latest_per_key(changes, keys, columns, order), keys, columns)


def apply_unique(base: DataFrame, changes: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """`apply_changes` with changes that are one per key already."""
    return apply_latest(base, changes.select(*keys, F.struct(*columns).alias("_new")), keys, columns)


def apply_counted(
    base: DataFrame, changes: DataFrame, keys: Sequence[str], columns: Sequence[str], order: str
) -> tuple[DataFrame, Observation]:
    """`apply_changes` and an observation with the number of rows, those a change matched, and those it gave other values.

    The counts come with the write of the result, from the same scan; `Observation.get` has them after it.
    """
    merged = _with_new(base, latest_per_key(changes, keys, columns, order), keys)
    matched = F.col("_new").isNotNull()
    seen = Observation()
    merged = merged.observe(
        seen, F.count(F.lit(1)).alias("rows"), F.count_if(matched).alias("matched"),
        F.count_if(matched & ~F.struct(*columns).eqNullSafe(F.col("_new"))).alias("changed"),
    )
    return _taken(merged, base, columns), seen

"""Sums and counts by key, stored by day and kept up to date by what was added and withdrawn."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.operators.keyed import Changed
from tallyhouse.sources.storage import replace_partitions, stored_once

PART = "SUM_PART"  # the partition column: the first characters of the day; `none` for rows without a date
_MEASURES = ["_sum", "_filled", "_rows"]  # the sum, the rows whose value is not null, all rows


@dataclass(frozen=True)
class Sums:
    """Where sums lie and what they are of: `value` by `keys`, one of which is `day`, a text date.

    A partition holds the days that agree in their first `grain` characters: 8 for a day, 6 for a month.
    """

    path: str
    keys: Sequence[str]
    value: str
    day: str
    grain: int = 8

    def taken(self, added: DataFrame, withdrawn: DataFrame | None = None) -> DataFrame:
        """Sums and counts of the added rows less those of the withdrawn ones, in one grouping."""
        rows = added.select(*self.keys, self.value, F.lit(1).alias("_sign"))
        if withdrawn is not None:
            rows = rows.unionByName(withdrawn.select(*self.keys, self.value, F.lit(-1).alias("_sign")))
        both = lambda total, value: total(F.when(F.col("_sign") > 0, value)) - total(F.when(F.col("_sign") < 0, value))
        return rows.groupBy(*self.keys).agg(
            both(lambda v: F.coalesce(F.sum(v), F.lit(0)), F.col(self.value)).alias("_sum"), both(F.count, F.col(self.value)).alias("_filled"),
            both(F.count, F.lit(1)).alias("_rows"),
        ).withColumn(PART, F.coalesce(F.left(F.col(self.day), F.lit(self.grain)), F.lit("none")))

    def stored(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(spark.read.parquet(f"{self.path}/shape").schema).parquet(f"{self.path}/sums")


def store_sums(rows: DataFrame, sums: Sums) -> None:
    """The sums of the rows, for batches to come."""
    first = sums.taken(rows).withColumn("_batch", F.lit(-1).cast("long"))
    first = first.select(*[c for c in first.columns if c != PART], PART)
    first.limit(0).write.parquet(f"{sums.path}/shape")
    first.repartition(PART).write.partitionBy(PART).parquet(f"{sums.path}/sums")


def apply_deltas(spark: SparkSession, sums: Sums, batch: int, added: DataFrame, withdrawn: DataFrame) -> Changed:
    """Adds the sums of `added` rows and takes off those of `withdrawn` ones, and rewrites only the partitions that change.

    Batches have rising numbers. A partition keeps the number of the last batch that changed it, so a batch that is applied again, also after
    a loss halfway, changes none twice. New rows are written aside before they are put in place. Withdrawn rows are rows that were
    added before, as they were. Returns the partitions and the number of changed sums.
    """
    merge = [F.sum(m).alias(m) for m in _MEASURES]
    delta = stored_once(sums.taken(added, withdrawn).filter("_sum <> 0 or _filled <> 0 or _rows <> 0"), "deltas")
    changed = {r[PART]: r["count"] for r in delta.groupBy(PART).count().collect()}  # a row per partition
    stored = sums.stored(spark)
    done = {r[0] for r in stored.filter(F.col(PART).isin(list(changed)) & (F.col("_batch") >= batch)).select(PART).distinct().collect()}
    parts = sorted(set(changed) - done)
    if parts:
        each = [rows.filter(F.col(PART).isin(parts)).select(*sums.keys, PART, *_MEASURES) for rows in (stored, delta)]
        # Keys whose rows are all withdrawn stay with zeros, so that a partition that loses its last one is rewritten too.
        # Rows are dealt by partition once, for the sums and for the write.
        merged = each[0].unionByName(each[1]).repartition(PART).groupBy(*sums.keys, PART).agg(*merge).withColumn("_batch", F.lit(batch).cast("long"))
        replace_partitions(stored_once(merged.select(*stored.columns), "merged"), f"{sums.path}/sums", [PART])
    return Changed(parts, sum(changed[p] for p in parts))


def read_sums(spark: SparkSession, sums: Sums, total: str, count: str) -> DataFrame:
    """The keys with their sum and number of rows. As in a grouping, a sum of nulls alone is null."""
    rows = sums.stored(spark).filter("_rows > 0")
    return rows.withColumns({total: F.when(F.col("_filled") > 0, F.col("_sum")), count: F.col("_rows")}).drop(*_MEASURES, PART, "_batch")

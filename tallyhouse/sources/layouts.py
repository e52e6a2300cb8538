"""How stored tables lie: sorted for look-ups by key, bucketed for the join of orders with their items, cut by order month for updates."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.operators.keyed import Changed, apply_latest, changed_rows, latest_per_key, splittable
from tallyhouse.schemas import TABLES
from tallyhouse.sources.storage import by_month, replace_partitions, side_by_side, stored_meanwhile
from tallyhouse.sources.tables import Tables

ORDER_KEY = ["CHANNEL_ORDER_NO", "MARKET_ID"]

# What the tables are looked up by. The first column sorts the rows, every one has a bloom filter in each row group.
LOOKUP_KEYS: dict[str, list[str]] = {
    "orders": ["TRACKING_NO", "CHANNEL_ORDER_NO"],
    "order_items": ["CHANNEL_ORDER_NO", "LISTING_SKU"],
    "listings": ["LISTING_SKU", "STD_SKU"],
    "unlinked_listings": ["LISTING_SKU"],
    "inventory": ["STD_SKU"],
    "images": ["SKU"],
    "users": ["EMPLOYEE_ID"],
}
GROUP_BYTES = 32 << 20  # of a row group: what a look-up reads at least


def write_for_lookups(rows: DataFrame, path: str, keys: Sequence[str], group_bytes: int = GROUP_BYTES, mode: str = "error") -> None:
    """Parquet, sorted by the first key within ranges, with bloom filters on all keys.

    Equality filters on the first key then leave out row groups and pages by their bounds, those on the others row groups by their
    bloom filters. Rows with one first key are cut by the next ones, so a hot key, or null, is not one task.
    """
    writer = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode(mode)
    writer = writer.option("parquet.block.size", group_bytes).option("parquet.bloom.filter.adaptive.enabled", True)
    for key in keys:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", True)
    writer.parquet(path)


def store_for_lookups(t: Tables, root: str, group_bytes: int = GROUP_BYTES) -> None:
    """All tables under `<root>/<table>`, those of LOOKUP_KEYS laid out for look-ups; `tables.read_parquet` opens them."""
    def writer(name: str) -> Callable[[], None]:
        rows, path = getattr(t, name), f"{root}/{name}"
        return partial(write_for_lookups, rows, path, LOOKUP_KEYS[name], group_bytes) if name in LOOKUP_KEYS else partial(rows.write.parquet, path)

    side_by_side(t.orders.sparkSession, [writer(name) for name in TABLES])


HOT_ITEMS = 100_000  # items of an order above which it is stored apart


@dataclass
class Buckets:
    """Where a bucketed bundle lies. The number of buckets is the same for both tables, so that they join bucket by bucket."""

    root: str
    count: int
    name: str  # of the catalog tables, followed by the table's own name

    def table(self, which: str) -> str:
        return f"{self.name}_{which}"


BUCKETED = ["orders", "order_items"]


def store_bucketed(t: Tables, buckets: Buckets, hot: int = HOT_ITEMS) -> None:
    """Orders and order items, bucketed and sorted by (CHANNEL_ORDER_NO, MARKET_ID), and the other tables as plain Parquet.

    A bucket is one task of the join and cannot be split when it runs, so the items of orders with more than `hot` of them are a table
    of their own that is joined by a shuffle that can. One task writes a bucket, so it is one sorted file. The items are written aside first, and
    then once more with the mark of their orders, so that both tables come of one join; what is written aside is deleted.
    """
    with stored_meanwhile(t.order_items, "items") as items:
        per_order = items.groupBy(*ORDER_KEY).count().filter(F.col("count") > hot)
        many = splittable(per_order.select(*ORDER_KEY, F.lit(True).alias("_apart")), *ORDER_KEY)
        no_key = F.col("CHANNEL_ORDER_NO").isNull() | F.col("MARKET_ID").isNull()
        with stored_meanwhile(items.filter(~no_key).join(many, ORDER_KEY, "left").select(*items.columns, "_apart"), "marked") as marked:
            parts = {"orders": t.orders, "order_items": marked.filter("_apart is null").drop("_apart")}
            for which, rows in parts.items():
                (
                    rows.repartition(buckets.count, *ORDER_KEY).write.bucketBy(buckets.count, *ORDER_KEY).sortBy(*ORDER_KEY)
                    .format("parquet").option("path", f"{buckets.root}/{which}").saveAsTable(buckets.table(which))
                )
            # Rows without a whole key join nothing; they lie apart, as they were stored.
            marked.filter("_apart").drop("_apart").unionByName(items.filter(no_key)).write.parquet(f"{buckets.root}/order_items_apart")
    for name in TABLES:
        if name not in BUCKETED:
            getattr(t, name).write.parquet(f"{buckets.root}/{name}")


def attach_bucketed(spark: SparkSession, buckets: Buckets, columns: dict[str, str]) -> None:
    """Names the stored bucketed tables in the catalog of a new session; `columns` gives each table's columns as DDL."""
    by = ", ".join(ORDER_KEY)
    for which, ddl in columns.items():
        spark.sql(f"""create table if not exists {buckets.table(which)} ({ddl}) using parquet
                      clustered by ({by}) sorted by ({by}) into {buckets.count} buckets location '{buckets.root}/{which}'""")


def open_bucketed(spark: SparkSession, buckets: Buckets) -> Tables:
    """The bundle of `store_bucketed`. Its orders meet its items without a shuffle, but for the orders stored apart."""
    regular = spark.table(buckets.table("order_items"))
    apart = spark.read.schema(regular.schema).parquet(f"{buckets.root}/order_items_apart")
    parts = [regular] if apart.isEmpty() else [regular, apart]

    def load(name: str) -> DataFrame:
        if name == "order_items":
            return reduce(DataFrame.unionByName, parts)
        return spark.table(buckets.table(name)) if name in BUCKETED else spark.read.parquet(f"{buckets.root}/{name}")

    return Tables(load, item_parts=parts)


def store_by_month(t: Tables, root: str) -> None:
    """Orders and their items under `<root>/<table>/ORDER_MONTH=...`; an item lies in the month of its order, one without an order in none."""
    dated = by_month(t.orders)
    dated.write.partitionBy("ORDER_MONTH").parquet(f"{root}/orders")
    months = dated.select(*ORDER_KEY, "ORDER_MONTH").groupBy(*ORDER_KEY).agg(F.min("ORDER_MONTH").alias("ORDER_MONTH"))
    t.order_items.join(months, ORDER_KEY, "left").write.partitionBy("ORDER_MONTH").parquet(f"{root}/order_items")


def read_months(spark: SparkSession, path: str) -> DataFrame:
    """A table of `store_by_month`, its month as text."""
    rows = spark.read.parquet(path)
    return rows.withColumn("ORDER_MONTH", F.col("ORDER_MONTH").cast("string"))


def update_months(spark: SparkSession, path: str, changes: DataFrame, keys: Sequence[str], columns: Sequence[str], order: str) -> Changed:
    """Applies the latest change of each key to a table stored by month, and rewrites only the months in which a value changes.

    The latest changes are found and written once, for both looking and rewriting. The months' new rows are written aside first and then put in place, so a lost job can run again, and a repeated update finds nothing to
    change and writes nothing. What is written aside is deleted when it is in place. Returns the rewritten months and the number of changed rows.
    """
    stored = read_months(spark, path)
    with stored_meanwhile(latest_per_key(changes, keys, columns, order), "latest") as latest:
        differing = changed_rows(stored, latest, keys, columns).groupBy("ORDER_MONTH").count().collect()  # a row per month
        months = [r["ORDER_MONTH"] for r in differing]
        if months:
            touched = stored.filter(F.coalesce(F.col("ORDER_MONTH"), F.lit("")).isin([m or "" for m in months]))
            with stored_meanwhile(apply_latest(touched, latest, keys, columns), "months") as rows:
                replace_partitions(rows.select(*stored.columns), path, ["ORDER_MONTH"])
    return Changed(sorted(months, key=lambda m: m or ""), sum(r["count"] for r in differing))

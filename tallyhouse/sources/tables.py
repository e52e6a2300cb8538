"""The sixteen domain tables as one bundle of lazy DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyhouse.schemas import TABLES, in_any_case


class Tables:
    """Attributes are the tables named in `schemas.TABLES`; each is loaded at first use."""

    orders: DataFrame
    order_items: DataFrame
    listings: DataFrame
    unlinked_listings: DataFrame
    inventory: DataFrame
    markets: DataFrame
    users: DataFrame
    brands: DataFrame
    vendors: DataFrame
    vendor_map: DataFrame
    products: DataFrame
    product_map: DataFrame
    manufacturing_map: DataFrame
    sizes: DataFrame
    images: DataFrame
    product_orders: DataFrame

    def __init__(self, load: Callable[[str], DataFrame], item_parts: list[DataFrame] | None = None, **loaded: DataFrame) -> None:
        self._load = load
        self._item_parts = item_parts
        vars(self).update(loaded)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        vars(self)[name] = self._load(name)
        return vars(self)[name]

    def with_tables(self, **changed: DataFrame) -> "Tables":
        """The same bundle with some tables replaced, as after a batch update."""
        return Tables(lambda name: getattr(self, name), None if "order_items" in changed else self._item_parts, **changed)

    @property
    def in_buckets(self) -> bool:
        """Whether the first part of the items lies as the orders do, so that they meet without a shuffle."""
        return self._item_parts is not None

    def item_parts(self) -> list[DataFrame]:
        """The order items as the parts they are stored in, which join orders in their own ways; one part as a rule."""
        return self._item_parts or [self.order_items]


def read_parquet(spark: SparkSession, root: str, any_case: bool = False) -> Tables:
    """Tables stored as `<root>/<table>`; partition columns are found from the directories.

    With `any_case` keys that differ in case only are the same in every plan (`schemas.in_any_case`); by default they differ.
    """
    schema = in_any_case if any_case else lambda contract: contract
    return Tables(lambda name: spark.read.schema(schema(TABLES[name])).parquet(f"{root}/{name}"))


def read_jdbc(spark: SparkSession, url: str, names: dict[str, str] | None = None, **options: str) -> Tables:
    """Tables of a live database.

    `names` maps a bundle name to the database's table name. For parallel reads of the large
    tables give Spark's partitionColumn, lowerBound, upperBound and numPartitions options.
    """
    names = names or {}
    return Tables(
        lambda name: spark.read.format("jdbc").options(url=url, dbtable=names.get(name, name), **options).load()
    )

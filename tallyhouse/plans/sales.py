"""Sales by SKU: the long report, its spread by marketplace, and the text export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions.dates import FIRST_DATE, LAST_DATE, dashed_date
from tallyhouse.functions.text import filled, or_default
from tallyhouse.operators.keyed import between_dates
from tallyhouse.plans.listings import LISTING_KEY, market_names, sku_directory, valid
from tallyhouse.plans.orders import ORDER_KEY, items_of_orders
from tallyhouse.sources.tables import Tables

# Marketplace ids in the column order of the report.
MARKET_ORDER = [1, 8, 2, 3, 4, 5, 6, 7]


SUM_KEY = ["ORDER_DATE", *LISTING_KEY]


def sold_items(t: Tables, start: str = FIRST_DATE, end: str = LAST_DATE) -> DataFrame:
    """Marketplace SKU, quantity and order date of every item of the orders in a range of dates."""
    orders = between_dates(t.orders, "ORDER_DATE", start, end).select(*ORDER_KEY, "ORDER_DATE")
    return items_of_orders(t, [*ORDER_KEY, "LISTING_SKU", "UNIT_QTY"], orders).select(*SUM_KEY, "UNIT_QTY")


def _sold(t: Tables, start: str, end: str, sums: DataFrame | None) -> DataFrame:
    """Sums per date and marketplace SKU: of the items, or the kept ones."""
    if sums is not None:
        return between_dates(sums, "ORDER_DATE", start, end).select(*SUM_KEY, "ORDER_QTY", "ORDER_CNT")
    # Keys in any case are grouped by a sort; numbers before the SKU leave it fewer texts to compare.
    sums = sold_items(t, start, end).groupBy("ORDER_DATE", "MARKET_ID", "LISTING_SKU").agg(F.sum("UNIT_QTY").alias("ORDER_QTY"), F.count("*").alias("ORDER_CNT"))
    return sums.select(*SUM_KEY, "ORDER_QTY", "ORDER_CNT")


def _sales_lines(t: Tables, start: str, end: str, sums: DataFrame | None) -> DataFrame:
    """Sales per date, marketplace SKU and standard SKU, unsorted.

    Items are summed before any dimension join; the directory is distinct, so its join keeps
    rows distinct and the result needs no DISTINCT over the facts.
    """
    names = market_names(t).select("MARKET_ID", F.col("MARKETPLACE_NM").alias("MARKET_NAME")).distinct()
    return (
        _sold(t, start, end, sums).join(sku_directory(t), LISTING_KEY)
        .join(names, "MARKET_ID")
        .select(
            "ORDER_DATE", "STD_SKU", "LISTING_SKU", "PRODUCT_NAME", "MARKET_ID", "MARKET_NAME",
            "ORDER_CNT", "ORDER_QTY", "INVENTORY_YN",
        )
    )


def sales_by_sku_long(t: Tables, start: str = FIRST_DATE, end: str = LAST_DATE, sums: DataFrame | None = None) -> DataFrame:
    """Sales per date, marketplace and standard SKU, sorted by date, marketplace and standard SKU.

    A listing with several standard SKUs repeats its quantity for each. `sums` are kept sums of `sold_items` by SUM_KEY
    (ORDER_QTY, ORDER_CNT); the items are not read then.
    """
    return _sales_lines(t, start, end, sums).orderBy("ORDER_DATE", "MARKET_ID", "STD_SKU")


def _has_empty_sku(t: Tables) -> bool:
    """Whether a marketplace SKU may stand for the empty standard SKU; it never does for null."""
    linked, unlinked = valid(t.listings).filter("STD_SKU = ''"), valid(t.unlinked_listings).filter("LISTING_SKU = ''")
    return not (linked.isEmpty() and unlinked.isEmpty())


def _spread(t: Tables, start: str, end: str, markets: Sequence[int], sums: DataFrame | None = None) -> DataFrame:
    """One row per date and standard SKU, sorted by both.

    Texts are the first non-empty ones in (MARKET_ID, LISTING_SKU) order. Where one marketplace
    has several listings of the SKU, its column shows the last listing's quantity while the total
    adds all of them.

    The lines are cut into ranges of date and SKU and sorted once, and a group's row is made where its lines meet: sorting the made rows
    would make them twice, as the bounds of the sort are sampled from them. Only an empty SKU gets its place from its group, so where
    the catalog has one, the rows are sorted at the end.
    """
    unnamed = _has_empty_sku(t)
    lines = _sales_lines(t, start, end, sums)
    lines = lines if unnamed else lines.repartitionByRange("ORDER_DATE", "STD_SKU")
    in_order = Window.partitionBy("ORDER_DATE", "STD_SKU").orderBy("MARKET_ID", "LISTING_SKU")
    group = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    texts, cells = ["LISTING_SKU", "PRODUCT_NAME", "INVENTORY_YN"], [f"MARKET_{m}" for m in markets]
    quantity = F.coalesce("ORDER_QTY", F.lit(0))
    lines = lines.withColumns({
        "_quantity": quantity, **{f"_{c}": filled(F.col(c)) for c in texts},
        **{c: F.when(F.col("MARKET_ID") == m, quantity) for c, m in zip(cells, markets, strict=True)},
    })
    spread = lines.withColumns({
        "_place": F.row_number().over(in_order), "TOTAL_ORDER_CNT": F.sum("_quantity").over(group),
        **{f"_{c}": F.first_value(f"_{c}", True).over(group) for c in texts}, **{c: F.last_value(c, True).over(group) for c in cells},
    }).filter("_place = 1")
    listing = F.coalesce("_LISTING_SKU", F.lit(""))
    return spread.select(
        "ORDER_DATE",
        or_default(F.col("STD_SKU"), listing).alias("STD_SKU") if unnamed else F.col("STD_SKU"),
        listing.alias("LISTING_SKU"),
        F.coalesce("_PRODUCT_NAME", F.lit("")).alias("PRODUCT_NAME"),
        "TOTAL_ORDER_CNT", F.col("_INVENTORY_YN").alias("INVENTORY_YN"), *cells,
    ).orderBy("ORDER_DATE", "STD_SKU")


def sales_by_sku_wide(
    t: Tables, start: str = FIRST_DATE, end: str = LAST_DATE, markets: Sequence[int] = MARKET_ORDER, sums: DataFrame | None = None
) -> DataFrame:
    """Sales per date and standard SKU with one column per marketplace of `markets`, sorted by date and SKU.

    TOTAL_ORDER_CNT is a quantity, as its source column name suggests otherwise, and counts all marketplaces.
    """
    return _spread(t, start, end, markets, sums)


def sales_by_sku_tsv(
    t: Tables, start: str = FIRST_DATE, end: str = LAST_DATE, market_titles: dict[int, str] | None = None,
    markets: Sequence[int] = MARKET_ORDER,
) -> DataFrame:
    """Rows of the sales export; write them with `write_tsv`.

    `market_titles` gives the column titles of the marketplaces (brand and channel); the ids are
    used for those left out.
    """
    titles = market_titles or {}
    return _spread(t, start, end, markets).select(
        dashed_date(F.col("ORDER_DATE")).alias("Order Date"),
        F.col("STD_SKU").alias("Standard SKU"),
        F.col("PRODUCT_NAME").alias("Product Name"),
        F.col("TOTAL_ORDER_CNT").alias("total"),
        *[F.coalesce(f"MARKET_{m}", F.lit(0)).alias(titles.get(m, f"Market {m}")) for m in markets],
        F.col("INVENTORY_YN").alias("Inventory Y/N"),
    )

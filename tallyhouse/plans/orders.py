"""Order look-ups and the packing-station order document.

Look-ups take one key, a one-column frame of keys, or None for all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.text import yn, zero_pad
from tallyhouse.operators.keyed import Keys, distinct_keys, first_per_key, looked_up, restrict, single_match, splittable
from tallyhouse.plans.listings import LISTING_KEY, linked_listings, market_names, sku_profile, valid
from tallyhouse.sources.tables import Tables

TRACKING_WIDTH = 22
ORDER_KEY = ["CHANNEL_ORDER_NO", "MARKET_ID"]

HEADER_COLUMNS = [
    "CHANNEL_ORDER_NO", "MARKET_ID", "ORDER_DATE", "ORDER_QTY", "ORDER_PRICE", "ORDER_SHIPPING_PRICE",
    "SHIPPING_PRICE", "SHIPPING_STATUS", "TRACKING_NO", "EMPLOYEE_ID", "PROC_DT", "PROC_TM",
]
STORED_ITEM_COLUMNS = ["LISTING_SKU", "UNIT_PRICE", "UNIT_QTY", "PACKING_STATUS", "NO_ITEM_YN", "TAG_CHANGE_YN"]
ITEM_COLUMNS = [
    "LISTING_SKU", "UNIT_PRICE", "UNIT_QTY", "UNIT_PRICE_SUM", "PACKING_STATUS", "NO_ITEM_YN", "TAG_CHANGE_YN",
    "LISTING_ITEM_ID", "STD_SKU", "LISTING_PRODUCT_NAME", "PRODUCT_SIZE", "PRODUCT_COLOR", "PRODUCT_DESIGN",
    "IMAGE_ID", "SKU", "IMAGE_PATH", "IMAGE_SOURCE",
    "LISTING_PRODUCT_SIZE", "LISTING_PRODUCT_COLOR", "LISTING_PRODUCT_DESIGN", "BRAND_NAME",
]


def market_meta(t: Tables, unknown: bool = False) -> DataFrame:
    return market_names(t, unknown)


def full_tracking_no(tracking: Column) -> Column:
    return zero_pad(tracking, TRACKING_WIDTH)


def orders_by_tracking(t: Tables, tracking: Keys = None) -> DataFrame:
    """Order headers of scanned tracking numbers, which are padded to their full width first."""
    if isinstance(tracking, DataFrame):
        tracking = tracking.select(full_tracking_no(F.col(tracking.columns[0])))
    elif tracking is not None:
        return t.orders.filter(F.col("TRACKING_NO") == full_tracking_no(F.lit(tracking))).select(*HEADER_COLUMNS)
    return restrict(t.orders, "TRACKING_NO", tracking).select(*HEADER_COLUMNS)


def order_items(t: Tables, orders: DataFrame | None = None) -> DataFrame:
    """Items with their price sum, of all orders or of the given (CHANNEL_ORDER_NO, MARKET_ID) keys."""
    items = t.order_items if orders is None else t.order_items.join(distinct_keys(orders, ORDER_KEY), ORDER_KEY, "left_semi")
    return items.select(
        *ORDER_KEY, "LISTING_SKU", "UNIT_PRICE", "UNIT_QTY",
        (F.col("UNIT_PRICE") * F.col("UNIT_QTY")).alias("UNIT_PRICE_SUM"),
        "PACKING_STATUS", "NO_ITEM_YN", "TAG_CHANGE_YN",
    )


def items_of_orders(t: Tables, columns: list[str], orders: DataFrame, *conditions: Column) -> DataFrame:
    """Columns of the items that meet the conditions, joined with their orders, part by part of the stored items.

    The first part lies as the orders do. The items of the others, orders with very many of them, meet the orders they belong to by a
    shuffle that can be split.
    """
    joined = None
    for place, part in enumerate(t.item_parts()):
        for condition in conditions:
            part = part.filter(condition)
        part = part.select(*columns)
        own = orders if place == 0 else splittable(orders.join(distinct_keys(part, ORDER_KEY), ORDER_KEY, "left_semi"), *ORDER_KEY)
        rows = part.join(own, ORDER_KEY)
        joined = rows if joined is None else joined.unionByName(rows)
    return joined


def listing_items(t: Tables, skus: DataFrame | None = None) -> DataFrame:
    """Valid listings of valid inventory, of all or of the given (LISTING_SKU, MARKET_ID) keys."""
    rows = linked_listings(t).drop("PRODUCT_NAME")
    return rows if skus is None else rows.join(distinct_keys(skus, LISTING_KEY), LISTING_KEY, "left_semi")


def unlinked_listing_items(t: Tables, skus: DataFrame | None = None) -> DataFrame:
    rows = valid(t.unlinked_listings).select(
        "LISTING_ITEM_ID", "MARKET_ID", "LISTING_SKU", "LISTING_PRODUCT_NAME",
        "LISTING_PRODUCT_SIZE", "LISTING_PRODUCT_COLOR", "LISTING_PRODUCT_DESIGN",
    )
    return rows if skus is None else rows.join(distinct_keys(skus, LISTING_KEY), LISTING_KEY, "left_semi")


def brand_code_of(listing_sku: Column) -> Column:
    """Brand code inside a listing SKU: its second and third character."""
    return F.substring(listing_sku, 2, 2)


def brand_by_code(t: Tables, codes: Keys = None) -> DataFrame:
    return restrict(t.brands, "BRAND_CODE", codes).select("BRAND_CODE", "BRAND_NAME")


def images_by_sku(t: Tables, skus: Keys = None) -> DataFrame:
    return restrict(t.images, "SKU", skus).select("IMAGE_ID", "SKU", "IMAGE_PATH", "IMAGE_SOURCE")


_HAS_KEY = " and ".join(f"{c} is not null" for c in ORDER_KEY)


def _document_headers(t: Tables, tracking: Keys) -> DataFrame:
    """Headers that a scan can open: the tracking number belongs to exactly one order."""
    found = orders_by_tracking(t, tracking).filter("TRACKING_NO is not null")
    # The key first, as the aggregate yields it: then both joins ask for the same columns in the same order, and read one shuffle.
    return single_match(found.select("TRACKING_NO", *[c for c in HEADER_COLUMNS if c != "TRACKING_NO"]), ["TRACKING_NO"])


def _with_items(t: Tables, headers: DataFrame, tracking: Keys) -> DataFrame:
    """The headers with the stored columns of their items, which are narrow; what the items stand for comes after."""
    items = t.order_items if tracking is None else t.order_items.join(distinct_keys(headers, ORDER_KEY), ORDER_KEY, "left_semi")
    flags = {c: yn(F.col(c)) for c in ("NO_ITEM_YN", "TAG_CHANGE_YN")}
    return items.select(*ORDER_KEY, *STORED_ITEM_COLUMNS).withColumns(flags).join(headers.filter(_HAS_KEY), ORDER_KEY)


def _enriched(t: Tables, rows: DataFrame) -> DataFrame:
    """Rows with items and what these stand for. A brand code in a SKU has two characters, so the brands that can be meant are few, and are broadcast."""
    brands = t.brands.filter(F.length("BRAND_CODE") <= 4).select("BRAND_CODE", "BRAND_NAME")  # in any case a code of two may equal a longer one
    brands = F.broadcast(first_per_key(brands, ["BRAND_CODE"], [F.col("BRAND_NAME")]))
    rows = rows.join(sku_profile(t), LISTING_KEY, "left")
    rows = rows.withColumns({"UNIT_PRICE_SUM": F.col("UNIT_PRICE") * F.col("UNIT_QTY"), "BRAND_CODE": brand_code_of(F.col("LISTING_SKU"))})
    return rows.join(brands, "BRAND_CODE", "left").drop("BRAND_CODE")


def _document(t: Tables, headers: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of orders with items, and the headers without, with the images of their marketplaces.

    Orders with and without items are joined apart: an outer join could not split a hot order's items. Headers without a whole key have no
    items; the others are shuffled by it once for both joins.
    """
    without = headers.filter(_HAS_KEY).join(distinct_keys(t.order_items, ORDER_KEY), ORDER_KEY, "left_anti").unionByName(headers.filter(f"not ({_HAS_KEY})"))
    if "COPIES" in columns:
        without = without.withColumn("COPIES", F.lit(0).cast("bigint"))
    images = market_names(t).select("MARKET_ID", "MARKET_IMAGE_PATH")
    whole = _enriched(t, rows).unionByName(without, allowMissingColumns=True).join(images, "MARKET_ID", "left")
    return whole.select("MARKET_ID", *[c for c in HEADER_COLUMNS if c != "MARKET_ID"], "MARKET_IMAGE_PATH", *columns)


def order_document_lines(t: Tables, tracking: Keys = None) -> DataFrame:
    """Flat form of the order document: one row per item, null item columns for an order without items.

    Items meet their orders first and are shuffled once more, with them, to what they stand for.
    """
    headers = _document_headers(t, tracking)
    return _document(t, headers, _with_items(t, headers, tracking), ITEM_COLUMNS)


def order_document(t: Tables, tracking: Keys = None) -> DataFrame:
    """Order headers with their enriched items: a row per order and different item, with the number of its COPIES.

    Equal items are counted where they meet their order, in parts if it is hot, and before they are enriched: what an item stands for follows from
    its SKU and marketplace. An order without items has one row with null item columns and no copies.
    """
    headers = _document_headers(t, tracking)
    # A header is named by its tracking number, so its other columns are those of any of its rows; as texts they make Spark group by a sort, which holds no table of all groups.
    others = [F.first(c).alias(c) for c in HEADER_COLUMNS if c not in (*ORDER_KEY, "TRACKING_NO")]
    counted = _with_items(t, headers, tracking).groupBy(*ORDER_KEY, "TRACKING_NO", *STORED_ITEM_COLUMNS).agg(F.count("*").alias("COPIES"), *others)
    return _document(t, headers, counted, [*ITEM_COLUMNS, "COPIES"])


def order_document_list(t: Tables, tracking: Keys) -> DataFrame:
    """The look-up of scanned orders: each header with the array ORDER_LIST of its different items and their COPIES, by listing SKU."""
    rows = order_document(t, tracking)
    header = [c for c in rows.columns if c not in (*ITEM_COLUMNS, "COPIES")]
    item = F.when(F.col("COPIES") > 0, F.struct(*ITEM_COLUMNS, "COPIES"))
    return rows.groupBy(*header).agg(F.array_sort(F.collect_list(item)).alias("ORDER_LIST"))


def around_scans(t: Tables, tracking: DataFrame) -> Tables:
    """The bundle with only those rows of the large tables that scanned orders need, looked up step by step.

    Each step's keys are few for a few scans and reach the files of the next table as filters (`looked_up`); the plans over the
    result are those over whole tables.
    """
    wanted = tracking.select(full_tracking_no(F.col(tracking.columns[0])).alias("TRACKING_NO"))
    orders = looked_up(t.orders, wanted, ["TRACKING_NO"])
    items = looked_up(t.order_items, orders, ORDER_KEY)
    listings = looked_up(t.listings, items, LISTING_KEY)
    skus = listings.select("STD_SKU", F.col("STD_SKU").alias("SKU"))
    return t.with_tables(
        orders=orders, order_items=items, listings=listings, unlinked_listings=looked_up(t.unlinked_listings, items, LISTING_KEY),
        inventory=looked_up(t.inventory, skus, ["STD_SKU"]), images=looked_up(t.images, skus, ["SKU"]),
    )


def scanned_documents(t: Tables, tracking: DataFrame) -> DataFrame:
    """`order_document` of scanned tracking numbers over tables stored for look-ups.

    The looked-up orders are those of the scans, so the document is made of all of them, and the scans are not computed again in it.
    """
    return order_document(around_scans(t, tracking))

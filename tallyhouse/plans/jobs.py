"""Batch data jobs: extracts, product-name clean-up and SKU harvest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions.dates import parse_stamp
from tallyhouse.functions.text import color_tail
from tallyhouse.operators.keyed import distinct_keys
from tallyhouse.plans.listings import valid
from tallyhouse.sources.tables import Tables

IMAGE_SLOTS = 10

# Product names the clean-up leaves alone, exactly and by pattern.
KEEP_NAMES = [
    "HC Womens Sleeveless T-Shirts, Round-Bottom",
    "MP Instant Hand Saniziter (70% Ethanol, 500ml (16.9oz))",
    "WO Hand Gel Sanitizer (72% Ethanol, 500ml (16.9oz))",
    "Reusable Cotton/Spandex Mask - Black, 3P",
    "PI Mens Super Slim Stretch Jeans PMD040023R, PMD029023R",
]
KEEP_PATTERNS = [
    "SM Mens Premium Cargo Shorts (30-42)%",
    "Mens Crew Neck Short Sleeve T Shirts%",
    "Unisex Fleece Sweat Shorts%",
    "Mens Twill Cargo Shorts with Belt (30-40)%",
    "Womens Fur Lined Belted Coat (GJ1133)%",
]


def extract_by_market(t: Tables, unlisted_only: bool = False) -> DataFrame:
    """Inventory with its listings per marketplace, and every inventory row with blank listing columns.

    In the second part SKUs that have a listing lose their size name and fall back to the raw
    size. `unlisted_only` instead keeps just the SKUs without listing there. Listing numbers are
    text so that the blanks fit, prices with two decimals; bad creation times are null.
    """
    sizes = t.sizes.select("SIZE_CODE", "SIZE_NAME")
    listed_skus = distinct_keys(t.listings, ["STD_SKU"])
    # STORE_NANE is spelt as in existing extracts.
    stores = t.markets.select("MARKET_ID", "CHANNEL_NAME", F.col("BRAND_NAME").alias("STORE_NANE"))
    listings = t.listings.drop("VALID_YN").join(stores, "MARKET_ID")

    stock_columns = [
        F.col("STD_SKU"),
        F.col("PRODUCT_NAME").alias("INVENTORY_PRODUCT_NAME"),
        F.col("PRODUCT_SUPPLIER"),
        F.coalesce("SIZE_NAME", "PRODUCT_SIZE").alias("PRODUCT_SIZE"),
        color_tail(F.col("PRODUCT_COLOR")).alias("PRODUCT_COLOR"),
        F.col("PRODUCT_DESIGN"),
    ]
    with_listing = t.inventory.join(sizes, "SIZE_CODE", "left").join(listings, "STD_SKU").select(
        *stock_columns, "CHANNEL_NAME", "STORE_NANE", "LISTING_SKU",
        F.col("LISTING_ITEM_ID").cast("string").alias("LISTING_ITEM_ID"),
        "LISTING_PRODUCT_NAME",
        F.col("LISTING_PRODUCT_QTY").cast("string").alias("LISTING_PRODUCT_QTY"),
        F.col("LISTING_PRODUCT_PRICE").cast("decimal(12,2)").cast("string").alias("LISTING_PRODUCT_PRICE"),
        "LISTING_PRODUCT_FBM",
        parse_stamp(F.col("CREATED_DTTM")).alias("CREATED_DATE"),
        "VALID_YN",
    )
    if unlisted_only:
        without = t.inventory.join(listed_skus, "STD_SKU", "left_anti")
    else:
        flagged = t.inventory.join(listed_skus.withColumn("_listed", F.lit(True)), "STD_SKU", "left")
        without = flagged.withColumn("SIZE_CODE", F.when(F.col("_listed").isNull(), F.col("SIZE_CODE")))
    blanks = [
        F.lit("").alias(c)
        for c in (
            "CHANNEL_NAME", "STORE_NANE", "LISTING_SKU", "LISTING_ITEM_ID", "LISTING_PRODUCT_NAME",
            "LISTING_PRODUCT_QTY", "LISTING_PRODUCT_PRICE", "LISTING_PRODUCT_FBM",
        )
    ]
    blank_listing = without.join(sizes, "SIZE_CODE", "left").select(
        *stock_columns, *blanks, F.lit(None).cast("timestamp_ntz").alias("CREATED_DATE"), "VALID_YN"
    )
    return with_listing.union(blank_listing).distinct()


def image_pivot(t: Tables) -> DataFrame:
    """Up to ten images of every valid SKU in columns IMAGE_1 to IMAGE_10, in IMAGE_ID order.

    Images are cut to ten per SKU before the join and before any shuffle of the rest, so a SKU
    with very many images costs ten rows per task. The ranks are taken again after the join, in
    the same partitioning, for SKUs that have several inventory rows.
    """
    def ranked(rows: DataFrame, sku: str) -> DataFrame:
        by_id = Window.partitionBy(sku).orderBy("IMAGE_ID", "IMAGE_PATH")
        return rows.withColumn("_rank", F.row_number().over(by_id)).filter(F.col("_rank") <= IMAGE_SLOTS)

    images = ranked(t.images.select(F.col("SKU").alias("STD_SKU"), "IMAGE_ID", "IMAGE_PATH"), "STD_SKU").drop("_rank")
    joined = ranked(valid(t.inventory).select("STD_SKU").join(images, "STD_SKU"), "STD_SKU")
    slots = [
        F.max(F.when(F.col("_rank") == i, F.col("IMAGE_PATH")).otherwise("")).alias(f"IMAGE_{i}")
        for i in range(1, IMAGE_SLOTS + 1)
    ]
    return joined.groupBy("STD_SKU").agg(*slots)


def _renamed(inventory: DataFrame, affected: Column, name: Column) -> DataFrame:
    kept = F.col("PRODUCT_NAME")
    return inventory.withColumn("PRODUCT_NAME", F.when(affected, name).otherwise(kept))


def clean_name_size(inventory: DataFrame) -> DataFrame:
    """Inventory with names cut before `SIZE:`, found in any case."""
    name = F.col("PRODUCT_NAME")
    at = F.instr(F.upper(name), "SIZE:")
    return _renamed(inventory, at > 0, F.trim(F.substr(name, F.lit(1), at - 1)))


def clean_name_paren(
    inventory: DataFrame, keep: Sequence[str] = KEEP_NAMES, keep_patterns: Sequence[str] = KEEP_PATTERNS, guard: bool = False
) -> DataFrame:
    """Inventory with names that hold a comma cut before the first parenthesis.

    A name without parenthesis becomes empty; `guard` leaves such names alone instead.
    """
    name = F.col("PRODUCT_NAME")
    at = F.instr(name, "(")
    affected = name.contains(",") & ~name.isin(*keep)
    for pattern in keep_patterns:
        affected = affected & ~name.like(pattern)
    if guard:
        affected = affected & (at > 0)
    return _renamed(inventory, affected, F.trim(F.substr(name, F.lit(1), F.greatest(at - 1, F.lit(0)))))


def clean_name_close_paren(inventory: DataFrame, keep: Sequence[str] = KEEP_NAMES, guard: bool = False) -> DataFrame:
    """Inventory with names that hold a comma cut after the first closing parenthesis.

    A name without one gets one appended; `guard` leaves such names alone instead.
    """
    name = F.col("PRODUCT_NAME")
    affected = name.contains(",") & ~name.isin(*keep)
    if guard:
        affected = affected & name.contains(")")
    return _renamed(inventory, affected, F.trim(F.concat(F.substring_index(name, ")", 1), F.lit(")"))))


def clean_names(inventory: DataFrame, guard: bool = False) -> DataFrame:
    """The three clean-up steps in order."""
    return clean_name_close_paren(clean_name_paren(clean_name_size(inventory), guard=guard), guard=guard)


def harvest_skus(grids: DataFrame) -> DataFrame:
    """Cells with exactly three dash-separated parts, distinct within each sheet."""
    cells = grids.select("SHEET_ID", F.explode("CELLS").alias("SKU"))
    return cells.filter(F.size(F.split("SKU", "-")) == 3).distinct()


def linked_ids(grids: DataFrame) -> DataFrame:
    """Ids of the sheets that a grid's first column links to, distinct: the sixth part between slashes of the address in a link formula.

    Formulas are read in any case. Cells without one, and addresses with fewer parts, give nothing.
    """
    address = F.regexp_extract(F.get("CELLS", F.lit(0)), r'(?i)=hyperlink\("([^"]+)"', 1)
    ids = grids.select(F.get(F.split(address, "/"), F.lit(5)).alias("LINKED_ID"))
    return ids.filter("LINKED_ID is not null").distinct()

"""What a marketplace SKU stands for: dimension-side joins shared by the fact queries.

Resolving (LISTING_SKU, MARKET_ID) here means that the order items are joined once, whatever
their listing turns out to be, and never scanned a second time for the unmapped ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.operators.keyed import distinct_keys, first_per_key, splittable
from tallyhouse.sources.tables import Tables

LISTING_KEY = ["LISTING_SKU", "MARKET_ID"]


def valid(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("VALID_YN") == "Y")


def linked_listings(t: Tables) -> DataFrame:
    """Valid listings with their valid inventory row.

    Here and below the looked-up side is as large as the catalog, and Spark would broadcast it for the size of its files, which are compressed
    and read in part; run-time sizes do not undo that. So these joins are merges.
    """
    stock = valid(t.inventory).select("STD_SKU", "PRODUCT_NAME", "PRODUCT_SIZE", "PRODUCT_COLOR", "PRODUCT_DESIGN")
    return valid(t.listings).join(stock.hint("merge"), "STD_SKU").select(
        "LISTING_ITEM_ID", "STD_SKU", "MARKET_ID", "LISTING_SKU", "LISTING_PRODUCT_NAME",
        "PRODUCT_NAME", "PRODUCT_SIZE", "PRODUCT_COLOR", "PRODUCT_DESIGN",
    )


def sku_directory(t: Tables) -> DataFrame:
    """Standard SKU and product name of every sellable marketplace SKU.

    INVENTORY_YN is Y for mapped SKUs (one row per standard SKU of the listing) and N for unmapped
    ones, which stand for themselves. A SKU whose valid listing has no valid inventory is in
    neither part. Rows are distinct, so a join with distinct facts needs no later DISTINCT.
    """
    mapped = linked_listings(t).select(*LISTING_KEY, "STD_SKU", "PRODUCT_NAME", F.lit("Y").alias("INVENTORY_YN"))
    unmapped = (
        valid(t.unlinked_listings)
        .join(distinct_keys(valid(t.listings), LISTING_KEY).hint("merge"), LISTING_KEY, "left_anti")
        .select(
            *LISTING_KEY,
            F.col("LISTING_SKU").alias("STD_SKU"),
            F.col("LISTING_PRODUCT_NAME").alias("PRODUCT_NAME"),
            F.lit("N").alias("INVENTORY_YN"),
        )
    )
    return mapped.union(unmapped).distinct()


def first_images(t: Tables) -> DataFrame:
    """The image with the lowest id of every SKU."""
    return first_per_key(t.images.filter("SKU is not null"), ["SKU"], [F.col("IMAGE_ID"), F.col("IMAGE_PATH")])


def sku_profile(t: Tables) -> DataFrame:
    """One row per marketplace SKU: its first linked listing and image, else its first unlinked listing.

    Several listings of one SKU have no order of their own; the lowest LISTING_ITEM_ID is taken. Images meet the inventory, which has fewer rows than
    its listings.
    """
    stock = valid(t.inventory).select("STD_SKU", "PRODUCT_SIZE", "PRODUCT_COLOR", "PRODUCT_DESIGN")
    stock = stock.join(splittable(first_images(t), "SKU").hint("merge"), F.col("STD_SKU") == F.col("SKU"), "left")
    listings = valid(t.listings).select("LISTING_ITEM_ID", "STD_SKU", "MARKET_ID", "LISTING_SKU", "LISTING_PRODUCT_NAME")
    linked = listings.join(splittable(stock, "STD_SKU").hint("merge"), "STD_SKU").withColumn("_kind", F.lit(0))
    unlinked = valid(t.unlinked_listings).drop("VALID_YN").withColumn("_kind", F.lit(1))
    offers = linked.unionByName(unlinked, allowMissingColumns=True)
    pick = [F.col(c) for c in ("_kind", "LISTING_ITEM_ID", "STD_SKU", "LISTING_PRODUCT_NAME")]
    return splittable(first_per_key(offers, LISTING_KEY, pick).drop("_kind"), "LISTING_SKU")


def market_names(t: Tables, unknown: bool = False) -> DataFrame:
    """Name and image of every marketplace; `unknown` adds the stand-in row 99."""
    named = t.markets.select(
        "MARKET_ID",
        F.concat("BRAND_NAME", F.lit(" "), "CHANNEL_NAME").alias("MARKETPLACE_NM"),
        "MARKET_IMAGE_PATH",
    )
    if not unknown:
        return named
    # The row used for an unknown marketplace.
    row = "99 as MARKET_ID, 'Unknown' as MARKETPLACE_NM, 'market_place_amazon_prime_icon' as MARKET_IMAGE_PATH"
    return named.unionByName(t.markets.sparkSession.sql(f"select {row}"))

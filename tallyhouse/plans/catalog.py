"""Catalog lists: brands, vendors, products, variants and sizes.

The argument of a keyed list is one key, a one-column frame of keys, or None for all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.text import color_after_first, color_tail
from tallyhouse.operators.keyed import Keys, distinct_keys, restrict, splittable
from tallyhouse.operators.ordering import joined_in_order
from tallyhouse.sources.tables import Tables

PRODUCT_COLUMNS = ["PRODUCT_CODE", "PRODUCT_TITLE", "BRAND_CODE", "PACK_INFO", "ORDER_BY_SIZE", "MANUFACTURING_CODE"]


def brand_list(t: Tables) -> DataFrame:
    return t.brands.select("BRAND_CODE", "BRAND_NAME", "EMAIL", "ORDERS_FROM").orderBy("BRAND_CODE")


def brands_with_product(t: Tables) -> DataFrame:
    """Brands that have at least one product."""
    return brand_list(t.with_tables(brands=t.brands.join(distinct_keys(t.products, ["BRAND_CODE"]), "BRAND_CODE", "left_semi")))


def vendor_list(t: Tables) -> DataFrame:
    return t.vendors.select("VENDOR_CODE", "VENDOR_NAME", "VENDOR_EMAIL", "ORDERS_FROM").orderBy("VENDOR_CODE")


def vendor_map(t: Tables, vendors: Keys = None) -> DataFrame:
    """Brands of vendors."""
    return restrict(t.vendor_map, "VENDOR_CODE", vendors).select("VENDOR_CODE", "BRAND_CODE")


def _orderable(t: Tables, products: DataFrame) -> DataFrame:
    """Products that have SKUs, with each of their manufacturing codes or an empty text."""
    codes = t.manufacturing_map.select("PRODUCT_CODE", "MANUFACTURING_CODE").distinct()
    return (
        products.join(distinct_keys(t.product_map, ["PRODUCT_CODE"]), "PRODUCT_CODE", "left_semi")
        .join(splittable(codes, "PRODUCT_CODE"), "PRODUCT_CODE", "left")
        .withColumn("MANUFACTURING_CODE", F.coalesce("MANUFACTURING_CODE", F.lit("")))
    )


def product_list(t: Tables, brands: Keys = None) -> DataFrame:
    """Orderable products of brands, by code."""
    return _orderable(t, restrict(t.products, "BRAND_CODE", brands)).select(*PRODUCT_COLUMNS).orderBy("PRODUCT_CODE")


def all_product_list(t: Tables) -> DataFrame:
    return product_list(t)


def vendor_product_list(t: Tables, vendors: Keys = None) -> DataFrame:
    """Orderable products of the vendors' brands, by vendor and code.

    Every vendor of a brand lists all its products, so the list grows with vendors times products. Products are resolved before they meet
    the vendors, once each, and the list is made in its order.
    """
    carried = restrict(t.vendor_map, "VENDOR_CODE", vendors).select("VENDOR_CODE", "BRAND_CODE")
    products = _orderable(t, t.products.join(distinct_keys(carried, ["BRAND_CODE"]), "BRAND_CODE", "left_semi"))
    return joined_in_order(carried, products, "BRAND_CODE", "VENDOR_CODE", ["PRODUCT_CODE"]).select(
        "PRODUCT_CODE", "PRODUCT_TITLE", "MANUFACTURING_CODE", "BRAND_CODE", "VENDOR_CODE", "PACK_INFO", "ORDER_BY_SIZE"
    )


def all_vendor_product_list(t: Tables) -> DataFrame:
    return vendor_product_list(t)


def _variants(t: Tables, products: Keys) -> DataFrame:
    stock = t.inventory.select("STD_SKU", "PRODUCT_COLOR", "SIZE_CODE")
    sizes = t.sizes.select("SIZE_CODE", "SHORT_SIZE_CODE", "SIZE_ORDER")
    pairs = restrict(t.product_map, "PRODUCT_CODE", products).select("PRODUCT_CODE", "STD_SKU")
    return pairs.join(stock, "STD_SKU").join(sizes, "SIZE_CODE")


def product_variants(t: Tables, products: Keys = None) -> DataFrame:
    """SKUs of products with colour tail and size, sorted by the raw colour and then by size."""
    return (
        _variants(t, products)
        .orderBy("PRODUCT_COLOR", "SIZE_ORDER")
        .select(
            "PRODUCT_CODE", "STD_SKU", color_tail(F.col("PRODUCT_COLOR")).alias("PRODUCT_COLOR"),
            "SIZE_CODE", "SHORT_SIZE_CODE", "SIZE_ORDER",
        )
    )


def all_product_variants(t: Tables) -> DataFrame:
    return product_variants(t)


def distinct_sizes(t: Tables, products: Keys = None) -> DataFrame:
    return _variants(t, products).select("PRODUCT_CODE", "SIZE_CODE", "SHORT_SIZE_CODE", "SIZE_ORDER").distinct()


def product_sizes(t: Tables, products: Keys = None) -> DataFrame:
    """Distinct sizes of products in size order."""
    return distinct_sizes(t, products).orderBy("SIZE_ORDER")


def std_sku_by_size_color(t: Tables, wanted: DataFrame) -> DataFrame:
    """Standard SKUs for rows of PRODUCT_CODE, SIZE_CODE and COLOR.

    The colour meant here follows the first underscore of the stored one, spaces trimmed.
    """
    keys = ["PRODUCT_CODE", "SIZE_CODE", "COLOR"]
    variants = _variants(t, None).withColumn("COLOR", color_after_first(F.col("PRODUCT_COLOR")))
    return variants.join(distinct_keys(wanted, keys), keys, "left_semi").select(*keys, "STD_SKU")


def repeated_manufacturing_keys(t: Tables) -> DataFrame:
    """Keys that occur more than once in the manufacturing map, with their number: each repetition counts an order line again."""
    return t.manufacturing_map.groupBy("PRODUCT_CODE", "STD_SKU").agg(F.count("*").alias("ROWS")).filter("ROWS > 1")

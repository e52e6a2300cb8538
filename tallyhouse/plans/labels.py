"""Product labels: rows, the split into printable and rejected ones, and pages."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.text import color_tail_trimmed, is_blank, label_case
from tallyhouse.operators.ordering import running_total
from tallyhouse.sources.tables import Tables

LABELS_PER_PAGE = 4
LABEL_COLUMNS = ["STD_SKU", "PRODUCT_CODE", "SIZE", "COLOR", "NAME"]
LABEL_ORDER = ["STD_SKU", "SIZE", "COLOR", "NAME", "IMAGE_PATH"]


def _matching(t: Tables, prefix: str, ignore_case: bool) -> DataFrame:
    """SKUs with a dash that match the prefix; `%` and `_` in it are wildcards."""
    sku = F.col("STD_SKU")
    matches = sku.ilike(f"{prefix}%") if ignore_case else sku.like(f"{prefix}%")
    return t.inventory.filter(matches & sku.contains("-"))


def label_rows(t: Tables, prefix: str, ignore_case: bool = False) -> DataFrame:
    """Label texts of the matching SKUs with the image of the lowest IMAGE_ID.

    Text compares by binary value; `ignore_case` is for stores that compare SKUs in any case. Images are reduced to one per SKU before the join.
    """
    images = t.images.groupBy("SKU").agg(F.min_by("IMAGE_PATH", "IMAGE_ID").alias("IMAGE_PATH"))
    sku = F.col("STD_SKU")
    return (
        _matching(t, prefix, ignore_case)
        .join(t.sizes.select("SIZE_CODE", "SIZE_NAME"), "SIZE_CODE", "left")
        .select(
            sku,
            F.substring_index(sku, "-", 1).alias("PRODUCT_CODE"),
            F.coalesce("SIZE_NAME", "PRODUCT_SIZE").alias("SIZE"),
            color_tail_trimmed(F.col("PRODUCT_COLOR")).alias("COLOR"),
            F.col("PRODUCT_NAME").alias("NAME"),
        )
        .join(images, sku == F.col("SKU"), "left")
        .select(*LABEL_COLUMNS, "IMAGE_PATH")
        .distinct()
    )


class LabelSplit(NamedTuple):
    printable: DataFrame
    rejects: DataFrame


def label_split(t: Tables, prefix: str) -> LabelSplit:
    """Labels that can be printed, and those lacking colour, image or size.

    Rejects carry the requested code first; append them with `write_tsv` without header.
    """
    rows = label_rows(t, prefix)
    lacking = is_blank(F.col("COLOR")) | is_blank(F.col("IMAGE_PATH")) | is_blank(F.col("SIZE"))
    rejects = rows.filter(lacking).select(
        F.lit(prefix).alias("PRODUCT_CODE"), "STD_SKU", F.col("NAME").alias("PRODUCT_NAME"),
        F.col("SIZE").alias("PRODUCT_SIZE"), F.col("COLOR").alias("PRODUCT_COLOR"), F.col("IMAGE_PATH").alias("IMAGE_URL"),
    )
    return LabelSplit(rows.filter(~lacking), rejects)


def label_pages(t: Tables, prefix: str) -> DataFrame:
    """Printable labels with page and slot, four to a page, in STD_SKU order; other columns settle equal SKUs."""
    printable = label_split(t, prefix).printable
    numbered = running_total(printable, [], LABEL_ORDER, F.lit(1), "_position")
    return numbered.select(
        F.floor(F.col("_position") / LABELS_PER_PAGE).alias("PAGE"),
        (F.col("_position") % LABELS_PER_PAGE).alias("SLOT"),
        "STD_SKU", "PRODUCT_CODE", "SIZE", label_case(F.col("COLOR")).alias("COLOR"), "NAME", "IMAGE_PATH",
    )

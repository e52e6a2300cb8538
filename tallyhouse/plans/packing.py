"""Packing: status report, flag counts and messages, and the updates a packing station sends."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.dates import FIRST_DATE, LAST_DATE, dashed_date, readable_stamp
from tallyhouse.functions.text import filled, shown, strict_name
from tallyhouse.operators.keyed import apply_changes, between_dates
from tallyhouse.operators.ordering import distinct_in_order
from tallyhouse.plans.listings import LISTING_KEY, market_names, sku_directory
from tallyhouse.plans.orders import ORDER_KEY, items_of_orders
from tallyhouse.sources.tables import Tables

# Shipping status codes.
COMPLETE, ON_HOLD = "01", "02"

ITEM_KEY = [*ORDER_KEY, "LISTING_SKU"]
STATUS_COLUMNS = ["SHIPPING_STATUS", "EMPLOYEE_ID", "PROC_DT", "PROC_TM"]
FLAG_COLUMNS = ["NO_ITEM_YN", "TAG_CHANGE_YN"]
PACKING_COLUMNS = [
    "ORDER_DATE", "PROC_DT", "PROC_TM", "CHANNEL_ORDER_NO", "MARKET_NAME", "LISTING_SKU", "STD_SKU",
    "PRODUCT_NAME", "EMPLOYEE_NAME", *FLAG_COLUMNS, "SHIPPING_STATUS", "INVENTORY_YN",
]
PACKING_ORDER = list(dict.fromkeys(["ORDER_DATE", "MARKET_NAME", "LISTING_SKU", *PACKING_COLUMNS]))


def _packing_rows(t: Tables, start: str, end: str) -> DataFrame:
    """Rows of the packing report with their repetitions, columns in PACKING_ORDER.

    Orders meet the employees before their items, as there are fewer of them; orders in buckets meet their items first, where they lie.
    """
    orders = between_dates(t.orders, "ORDER_DATE", start, end).select(*ORDER_KEY, "ORDER_DATE", *STATUS_COLUMNS)
    names = market_names(t).select("MARKET_ID", F.col("MARKETPLACE_NM").alias("MARKET_NAME"))
    staff = t.users.select("EMPLOYEE_ID", strict_name(F.col("FIRST_NAME"), F.col("LAST_NAME")).alias("EMPLOYEE_NAME"))
    named = lambda rows: rows.join(staff, "EMPLOYEE_ID", "left").drop("EMPLOYEE_ID")
    columns = [*ITEM_KEY, *FLAG_COLUMNS]
    items = named(items_of_orders(t, columns, orders)) if t.in_buckets else items_of_orders(t, columns, named(orders))
    return items.join(sku_directory(t), LISTING_KEY).join(names, "MARKET_ID").select(*PACKING_ORDER)


def packing_status(t: Tables, start: str = FIRST_DATE, end: str = LAST_DATE) -> DataFrame:
    """Distinct packing state of every mapped or unmapped order item, sorted by date, marketplace, SKU.

    The employee name is null as soon as one of its parts is.
    """
    return distinct_in_order(_packing_rows(t, start, end), PACKING_ORDER).select(*PACKING_COLUMNS)


def packing_status_tsv(t: Tables, start: str = FIRST_DATE, end: str = LAST_DATE) -> DataFrame:
    """Rows of the packing export; write them with `write_tsv`, which prints nulls as `null`.

    The fulfilled date is given for completed orders only.
    """
    stamp = F.concat(F.col("PROC_DT"), F.col("PROC_TM"))
    fulfilled = F.when(F.col("SHIPPING_STATUS") == COMPLETE, F.when(stamp.isNotNull(), readable_stamp(stamp))).otherwise("")
    return packing_status(t, start, end).select(
        dashed_date(F.col("ORDER_DATE")).alias("Order Date"),
        F.col("CHANNEL_ORDER_NO").alias("Order #"),
        F.col("STD_SKU").alias("SKU"),
        F.col("PRODUCT_NAME").alias("Product Name"),
        F.col("MARKET_NAME").alias("Marketplace"),
        F.col("EMPLOYEE_NAME").alias("Employee"),
        F.col("NO_ITEM_YN").alias("No Item"),
        F.col("TAG_CHANGE_YN").alias("Tag Change"),
        fulfilled.alias("Fulfilled Date"),
    )


def no_item_tag_change_counts(t: Tables, start: str = FIRST_DATE, end: str = LAST_DATE) -> DataFrame:
    """Flagged items per process date; dates without any flag are left out.

    Unflagged items count nothing and cannot make a date appear, so they are filtered at the scan.
    """
    no_item, tag_change = F.col("NO_ITEM_YN") == "Y", F.col("TAG_CHANGE_YN") == "Y"
    processed = between_dates(t.orders, "PROC_DT", start, end).select(*ORDER_KEY, "PROC_DT")
    return (
        items_of_orders(t, [*ORDER_KEY, *FLAG_COLUMNS], processed, no_item | tag_change)
        .groupBy("PROC_DT")
        .agg(
            F.sum(F.when(no_item, 1).otherwise(0)).alias("NO_ITEM"),
            F.sum(F.when(tag_change, 1).otherwise(0)).alias("TAG_CHANGE"),
        )
        .filter((F.col("NO_ITEM") > 0) | (F.col("TAG_CHANGE") > 0))
    )


def daily_flag_messages(t: Tables, start: str = FIRST_DATE, end: str = LAST_DATE) -> DataFrame:
    """One message per date with its flag totals."""
    day = F.concat(F.substring("PROC_DT", 5, 2), F.lit("/"), F.right(F.col("PROC_DT"), F.lit(2)))
    # Fixed format: text of the daily message.
    text = F.format_string(
        "%s: Total number of Tag Change: %d\nTotal number of No Item: %d", day, F.col("TAG_CHANGE"), F.col("NO_ITEM")
    )
    return no_item_tag_change_counts(t, start, end).select("PROC_DT", text.alias("MESSAGE"))


def update_order_status(orders: DataFrame, changes: DataFrame) -> DataFrame:
    """Orders with status, employee and process time of the latest change of each order."""
    return apply_changes(orders, changes, ORDER_KEY, STATUS_COLUMNS, "REQUEST_SEQ")


def update_order_item_flags(items: DataFrame, changes: DataFrame) -> DataFrame:
    """Items with the flags of the latest change of each item."""
    return apply_changes(items, changes, ITEM_KEY, FLAG_COLUMNS, "REQUEST_SEQ")


class PackingChanges(NamedTuple):
    order_changes: DataFrame
    item_changes: DataFrame
    rejects: DataFrame


def _status_of_request():
    """Complete wins over hold; a request with neither has no status and is refused."""
    return F.when(F.col("COMPLETE_YN") == "Y", COMPLETE).when(F.col("HOLD_YN") == "Y", ON_HOLD)


def accepted_requests(requests: DataFrame, now: str | Column) -> DataFrame:
    """The accepted requests with the values they give their orders: STATUS_COLUMNS."""
    return _judged(requests, now).filter("SHIPPING_STATUS is not null")


def _judged(requests: DataFrame, now: str | Column) -> DataFrame:
    day, time = (F.lit(now[:8]), F.lit(now[-6:])) if isinstance(now, str) else (F.left(now, F.lit(8)), F.right(now, F.lit(6)))
    return requests.withColumns({
        "SHIPPING_STATUS": _status_of_request(), "EMPLOYEE_ID": filled(F.col("EMPLOYEE_ID")), "PROC_DT": day, "PROC_TM": time,
    })


def packing_update(requests: DataFrame, now: str | Column) -> PackingChanges:
    """Changes asked for by a batch of packing requests, and the refused requests.

    `now` is the processing time as `yyyyMMddHHmmss`, a text or a column.
    """
    judged, accepted = _judged(requests, now), accepted_requests(requests, now)
    order_changes = accepted.select("REQUEST_SEQ", *ORDER_KEY, *STATUS_COLUMNS)
    item_changes = accepted.select("REQUEST_SEQ", F.explode("ORDER_LIST").alias("i")).select(
        "REQUEST_SEQ", *[F.col(f"i.{c}") for c in (*ITEM_KEY, *FLAG_COLUMNS)]
    )
    # Code and text of the refusal.
    rejects = judged.filter("SHIPPING_STATUS is null").select(
        "REQUEST_SEQ", *ORDER_KEY, F.lit(300).alias("CODE"), F.lit("Invalid post request.").alias("STATUS")
    )
    return PackingChanges(order_changes, item_changes, rejects)


def apply_packing(t: Tables, requests: DataFrame, now: str) -> Tables:
    """The tables after a batch of packing requests."""
    changes = packing_update(requests, now)
    return t.with_tables(
        orders=update_order_status(t.orders, changes.order_changes),
        order_items=update_order_item_flags(t.order_items, changes.item_changes),
    )


def packing_alerts(t: Tables, requests: DataFrame) -> DataFrame:
    """One message per flag set in an accepted request; an item with both flags gives two.

    Stateless, so it also runs on a stream of requests. An unknown marketplace is named Unknown.
    """
    accepted = requests.filter(_status_of_request().isNotNull())
    items = accepted.select("REQUEST_SEQ", F.explode("ORDER_LIST").alias("i")).select("REQUEST_SEQ", "i.*")
    kinds = F.array_compact(F.array(
        F.when(F.col("NO_ITEM_YN") == "Y", F.lit("No Item")),
        F.when(F.col("TAG_CHANGE_YN") == "Y", F.lit("Tag Change")),
    ))
    markets = market_names(t, unknown=True).select("MARKET_ID", "MARKETPLACE_NM")
    # Fixed format: text of the alert.
    text = F.format_string(
        "%s has been indicated for SKU: %s | Marketplace: %s | Order #: %s | Order Qty: %s.",
        F.col("KIND"), shown(F.col("LISTING_SKU")), F.coalesce("MARKETPLACE_NM", F.lit("Unknown")),
        shown(F.col("CHANNEL_ORDER_NO")), shown(F.col("UNIT_QTY")),
    )
    return (
        items.withColumn("KIND", F.explode(kinds))
        .join(markets, "MARKET_ID", "left")
        .select("REQUEST_SEQ", *ITEM_KEY, "KIND", text.alias("MESSAGE"))
    )

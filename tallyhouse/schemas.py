"""Column contracts of the sixteen domain tables.

Dates, times and timestamps stay text (`yyyyMMdd`, `HHmmss`, `yyyyMMddHHmmss`), so that text
comparison equals time comparison and range filters reach the Parquet scan unchanged.
"""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT = T.StringType()
_WHOLE = T.IntegerType()
_LONG = T.LongType()
_MONEY = T.DecimalType(12, 2)


def _table(text: str = "", **typed: T.DataType) -> T.StructType:
    fields = [T.StructField(name, _TEXT) for name in text.split()]
    fields += [T.StructField(name, kind) for name, kind in typed.items()]
    return T.StructType(fields)


TABLES: dict[str, T.StructType] = {
    "orders": _table(
        "CHANNEL_ORDER_NO ORDER_DATE SHIPPING_STATUS TRACKING_NO EMPLOYEE_ID PROC_DT PROC_TM",
        MARKET_ID=_WHOLE, ORDER_QTY=_WHOLE, ORDER_PRICE=_MONEY, ORDER_SHIPPING_PRICE=_MONEY, SHIPPING_PRICE=_MONEY,
    ),
    "order_items": _table(
        "CHANNEL_ORDER_NO LISTING_SKU PACKING_STATUS NO_ITEM_YN TAG_CHANGE_YN",
        MARKET_ID=_WHOLE, UNIT_PRICE=_MONEY, UNIT_QTY=_WHOLE,
    ),
    "listings": _table(
        "STD_SKU LISTING_SKU LISTING_PRODUCT_NAME LISTING_PRODUCT_FBM CREATED_DTTM VALID_YN",
        LISTING_ITEM_ID=_LONG, MARKET_ID=_WHOLE, LISTING_PRODUCT_QTY=_WHOLE, LISTING_PRODUCT_PRICE=_MONEY,
    ),
    "unlinked_listings": _table(
        "LISTING_SKU LISTING_PRODUCT_NAME LISTING_PRODUCT_SIZE LISTING_PRODUCT_COLOR LISTING_PRODUCT_DESIGN VALID_YN",
        LISTING_ITEM_ID=_LONG, MARKET_ID=_WHOLE,
    ),
    "inventory": _table(
        "STD_SKU PRODUCT_NAME PRODUCT_SUPPLIER PRODUCT_SIZE SIZE_CODE PRODUCT_COLOR PRODUCT_DESIGN VALID_YN"
    ),
    "markets": _table("BRAND_NAME CHANNEL_NAME MARKET_IMAGE_PATH", MARKET_ID=_WHOLE),
    "users": _table("EMPLOYEE_ID FIRST_NAME MIDDLE_NAME LAST_NAME DEPARTMENT_NAME LAST_LOGIN_DTTM"),
    "brands": _table("BRAND_CODE BRAND_NAME EMAIL ORDERS_FROM"),
    "vendors": _table("VENDOR_CODE VENDOR_NAME VENDOR_EMAIL ORDERS_FROM"),
    "vendor_map": _table("VENDOR_CODE BRAND_CODE"),
    "products": _table("PRODUCT_CODE PRODUCT_TITLE BRAND_CODE PACK_INFO ORDER_BY_SIZE"),
    "product_map": _table("PRODUCT_CODE STD_SKU"),
    "manufacturing_map": _table("PRODUCT_CODE STD_SKU MANUFACTURING_CODE MANUFACTURING_TITLE MANUFACTURING_COLOR"),
    "sizes": _table("SIZE_CODE SHORT_SIZE_CODE SIZE_NAME", SIZE_ORDER=_WHOLE),
    "images": _table("SKU IMAGE_PATH IMAGE_SOURCE", IMAGE_ID=_LONG),
    "product_orders": _table(
        "ORDER_DATE STD_SKU PRODUCT_CODE BRAND_CODE VENDOR_CODE ORDER_TM EMPLOYEE_ID",
        ORDER_SEQ=_LONG, ORDER_QTY=_WHOLE,
    ),
}

# Texts that name a thing; other texts are only shown or dated.
KEY_TEXTS = {
    "CHANNEL_ORDER_NO", "TRACKING_NO", "LISTING_SKU", "STD_SKU", "SKU", "PRODUCT_CODE", "MANUFACTURING_CODE", "BRAND_CODE", "VENDOR_CODE", "SIZE_CODE", "EMPLOYEE_ID",
}
ANY_CASE = "UTF8_LCASE"


def in_any_case(schema: T.StructType, collation: str = ANY_CASE) -> T.StructType:
    """The schema with its key texts compared under a collation: in joins, groupings, DISTINCT, filters and sorts of every plan.

    A joined or grouped key shows one of its spellings. Text filters on such keys do not reach the files.
    """
    return T.StructType([
        T.StructField(f.name, T.StringType(collation) if f.name in KEY_TEXTS and isinstance(f.dataType, T.StringType) else f.dataType, f.nullable, f.metadata)
        for f in schema
    ])


# Feeds: request bodies and clock punches, as they arrive.
PACKING_REQUEST = T.StructType([
    T.StructField("REQUEST_SEQ", _LONG),
    T.StructField("CHANNEL_ORDER_NO", _TEXT),
    T.StructField("MARKET_ID", _WHOLE),
    T.StructField("EMPLOYEE_ID", _TEXT),
    T.StructField("COMPLETE_YN", _TEXT),
    T.StructField("HOLD_YN", _TEXT),
    T.StructField("ORDER_LIST", T.ArrayType(T.StructType([
        T.StructField("CHANNEL_ORDER_NO", _TEXT),
        T.StructField("MARKET_ID", _WHOLE),
        T.StructField("LISTING_SKU", _TEXT),
        T.StructField("UNIT_QTY", _WHOLE),
        T.StructField("NO_ITEM_YN", _TEXT),
        T.StructField("TAG_CHANGE_YN", _TEXT),
    ]))),
])
EMPLOYEE_REQUEST = _table("EMPLOYEE_ID FIRST_NAME MIDDLE_NAME LAST_NAME DEPARTMENT_NAME", REQUEST_SEQ=_LONG)
PUNCH = _table("EMPLOYEE_ID PUNCH_DTTM")
ORDER_LINE = _table(
    "ORDER_DATE STD_SKU PRODUCT_CODE BRAND_CODE VENDOR_CODE ORDER_TM EMPLOYEE_ID", ORDER_QTY=_WHOLE
)
SHEET_GRID = T.StructType([
    T.StructField("SHEET_ID", _TEXT),
    T.StructField("ROW_NO", _LONG),
    T.StructField("CELLS", T.ArrayType(_TEXT)),
])

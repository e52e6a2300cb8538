"""The domain tables over the star-schema test data (definitions in FIXTURES.md).

Written without cross joins: small fixed fan-outs are exploded, keys that are functions of a part
are computed in place instead of joined. Codes are padded to at least the documented width, wider
where the number is longer, so that they stay unique at large scale.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession

from tallyhouse.plans.jobs import KEEP_NAMES, KEEP_PATTERNS
from tallyhouse.sources.tables import Tables

MARKET_COUNT = 8  # marketplaces that sell; the others only have a name


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def padded(number: str, width: int) -> str:
    text = f"cast({number} as string)"
    return f"lpad({text}, greatest({width}, length({text})), '0')"


def text_date(moment: str) -> str:
    return f"date_format({moment}, 'yyyyMMdd')"


BRAND_CODE = "lpad(substr(p_brand, 7), 2, '0')"
VENDOR_CODE = f"concat('V', {padded('s_suppkey', 4)})"
PRODUCT_CODE = f"concat('P', {padded('(p_partkey - p_partkey % 4)', 6)})"
STD_SKU = f"""
    if(p_partkey % 13 = 0, concat('N', p_partkey), concat({PRODUCT_CODE}, '-C', p_partkey % 4, '-S', p_size))"""
LISTING_SKU = f"concat('1', {BRAND_CODE}, '-', p_partkey)"
MARKET_ID = f"cast(o_custkey % {MARKET_COUNT} + 1 as int)"
# Names that the clean-up leaves alone, with a comma so that it would not do so otherwise.
KEPT_NAMES = [*KEEP_NAMES, *(pattern.replace("%", ", blue") for pattern in KEEP_PATTERNS)]
KEPT_NAME = f"""element_at(array('{"', '".join(KEPT_NAMES)}'), cast((p_partkey - 3) div 25 % {len(KEPT_NAMES)} as int) + 1)"""
EACH_MARKET = f"explode(sequence(1, {MARKET_COUNT})) as MARKET_ID"


def _markets(nation: DataFrame, region: DataFrame) -> DataFrame:
    named = nation.withColumnRenamed("n_regionkey", "r_regionkey")
    return named.join(region, "r_regionkey").selectExpr(
        "n_nationkey + 1 as MARKET_ID", "n_name as BRAND_NAME", "r_name as CHANNEL_NAME",
        "concat('market_', n_nationkey + 1) as MARKET_IMAGE_PATH",
    )


def _inventory(part: DataFrame) -> DataFrame:
    return part.selectExpr(
        "p_partkey as PARTKEY",
        f"{PRODUCT_CODE} as PRODUCT_CODE",
        f"{STD_SKU} as STD_SKU",
        """case p_partkey % 5 when 0 then concat(p_name, ' Size: ', p_size) when 1 then concat(p_name, ' (blue, L), extra')
           when 2 then concat(p_name, ', no paren')
           when 3 then if(p_partkey % 25 = 3, """ + KEPT_NAME + """, p_name) else p_name end as PRODUCT_NAME""",
        "p_brand as PRODUCT_SUPPLIER",
        "concat('RAW', p_size) as PRODUCT_SIZE",
        "if(p_partkey % 9 = 0, null, cast(p_size as string)) as SIZE_CODE",
        """case p_partkey % 4 when 0 then 'RED' when 1 then concat(p_type, '_dark navy') when 2 then concat('A_B_', p_type)
           else if(p_partkey % 20 = 3, concat(p_type, '_ '), concat(p_type, '_ green ')) end as PRODUCT_COLOR""",
        "p_type as PRODUCT_DESIGN",
        "if(p_partkey % 17 = 0, 'N', 'Y') as VALID_YN",
    )


def _sizes(part: DataFrame) -> DataFrame:
    return part.filter("p_size <= 40").select("p_size").distinct().selectExpr(
        "cast(p_size as string) as SIZE_CODE", "concat('S', p_size) as SHORT_SIZE_CODE",
        "concat('Size ', p_size) as SIZE_NAME", "p_size as SIZE_ORDER",
    )


def _brands(part: DataFrame) -> DataFrame:
    return part.select("p_brand").distinct().selectExpr(
        f"{BRAND_CODE} as BRAND_CODE", "p_brand as BRAND_NAME",
        "if(p_brand = 'Brand#3', null, concat(p_brand, '@example.test')) as EMAIL", "'' as ORDERS_FROM",
    )


def _vendors(supplier: DataFrame) -> DataFrame:
    return supplier.selectExpr(
        f"{VENDOR_CODE} as VENDOR_CODE", "s_name as VENDOR_NAME",
        "concat(s_name, '@example.test b@example.test') as VENDOR_EMAIL",
        "if(s_suppkey % 3 = 0, '', concat('Buyer ', s_suppkey)) as ORDERS_FROM",
    )


def _vendor_map(supplier: DataFrame, brands: DataFrame) -> DataFrame:
    numbered = brands.selectExpr("BRAND_CODE", "cast(BRAND_CODE as bigint) as n")
    return supplier.selectExpr(f"{VENDOR_CODE} as VENDOR_CODE", "s_suppkey % 25 + 1 as n").join(numbered, "n").drop("n")


def _products(part: DataFrame) -> DataFrame:
    return part.filter("p_partkey % 4 = 0").selectExpr(
        f"{PRODUCT_CODE} as PRODUCT_CODE", "p_name as PRODUCT_TITLE", f"{BRAND_CODE} as BRAND_CODE",
        "'1 pack' as PACK_INFO", "if(p_partkey % 8 = 0, 'Y', 'N') as ORDER_BY_SIZE",
    )


def _product_map(inventory: DataFrame) -> DataFrame:
    return inventory.filter("PARTKEY % 40 < 32").select("PRODUCT_CODE", "STD_SKU")


def _manufacturing_map(product_map: DataFrame) -> DataFrame:
    made = product_map.filter("STD_SKU like 'P%' and substr(PRODUCT_CODE, 6, 2) in ('00', '04', '20', '44', '60')")
    return made.selectExpr(
        "PRODUCT_CODE", "STD_SKU", "concat('M', PRODUCT_CODE, if(STD_SKU like '%-C3-%', 'B', '')) as MANUFACTURING_CODE",
        "concat('Mfg ', PRODUCT_CODE) as MANUFACTURING_TITLE",
        "if(STD_SKU like '%-C1-%', '', concat('mfg ', STD_SKU)) as MANUFACTURING_COLOR",
    )


def _images(inventory: DataFrame) -> DataFrame:
    numbered = inventory.filter("PARTKEY % 13 > 0 and PARTKEY % 7 > 0").selectExpr(
        "STD_SKU as SKU", "explode(transform(sequence(0, PARTKEY % 13 - 1), n -> PARTKEY * 100 + n)) as IMAGE_ID"
    )
    return numbered.selectExpr(
        "IMAGE_ID", "SKU", "concat('http://img.example.test/', IMAGE_ID) as IMAGE_PATH", "'src' as IMAGE_SOURCE"
    )


def _listings(part: DataFrame) -> DataFrame:
    """Own listings of a part, extra copies of some, and bundles that sell the SKU of part 1."""
    listed = part.filter("p_partkey % 10 < 7").selectExpr("*", EACH_MARKET)
    kinds = "if(p_partkey % 30 = 3 and p_partkey % 20 <> 0, array(0, 1), array(0))"
    own = listed.selectExpr("*", f"explode({kinds}) as kind", f"{STD_SKU} as STD_SKU")
    first_sku = part.filter("p_partkey = 1").selectExpr(f"{STD_SKU} as STD_SKU").scalar()
    bundles = listed.filter("p_partkey % 20 = 0").selectExpr("*", "1 as kind").withColumn("STD_SKU", first_sku)
    return own.unionByName(bundles).selectExpr(
        "p_partkey * 100 + MARKET_ID * 10 + kind as LISTING_ITEM_ID", "STD_SKU", "MARKET_ID",
        f"{LISTING_SKU} as LISTING_SKU", "concat(p_name, ' listing') as LISTING_PRODUCT_NAME",
        "kind + 1 as LISTING_PRODUCT_QTY", "p_retailprice as LISTING_PRODUCT_PRICE", "'N' as LISTING_PRODUCT_FBM",
        "if(p_partkey % 50 = 6, 'bad', '20240131235959') as CREATED_DTTM", "if(p_partkey % 11 = 0, 'N', 'Y') as VALID_YN",
    )


def _unlinked_listings(part: DataFrame) -> DataFrame:
    return part.filter("p_partkey % 10 >= 6").selectExpr("*", EACH_MARKET).selectExpr(
        "p_partkey * 10 + MARKET_ID as LISTING_ITEM_ID", "MARKET_ID", f"{LISTING_SKU} as LISTING_SKU",
        "concat(p_name, ' unlinked') as LISTING_PRODUCT_NAME", "cast(p_size as string) as LISTING_PRODUCT_SIZE",
        "p_type as LISTING_PRODUCT_COLOR", "p_type as LISTING_PRODUCT_DESIGN",
        "if(p_partkey % 19 = 0, 'N', 'Y') as VALID_YN",
    )


def _orders(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(
        "cast(o_orderkey as string) as CHANNEL_ORDER_NO", f"{MARKET_ID} as MARKET_ID",
        f"{text_date('o_orderdate')} as ORDER_DATE", "1 as ORDER_QTY", "o_totalprice as ORDER_PRICE",
        "0.0D as ORDER_SHIPPING_PRICE", "0.0D as SHIPPING_PRICE",
        "case o_orderstatus when 'F' then '01' when 'P' then '02' end as SHIPPING_STATUS",
        f"{padded('o_orderkey', 22)} as TRACKING_NO",
        "if(o_orderstatus = 'O', null, cast(o_custkey as string)) as EMPLOYEE_ID",
        f"if(o_orderstatus = 'O', null, {text_date('date_add(o_orderdate, 1)')}) as PROC_DT",
        "if(o_orderstatus = 'O', null, '134501') as PROC_TM",
    )


def sold_lines(lineitem: DataFrame, orders: DataFrame, part: DataFrame) -> DataFrame:
    """Line items with the marketplace and part columns the order tables need."""
    return (
        lineitem.join(orders.selectExpr("o_orderkey as l_orderkey", f"{MARKET_ID} as MARKET_ID"), "l_orderkey")
        .join(part.selectExpr("p_partkey as l_partkey", "p_partkey", "p_brand", "p_retailprice"), "l_partkey")
    )


def _order_items(lines: DataFrame) -> DataFrame:
    return lines.selectExpr(
        "cast(l_orderkey as string) as CHANNEL_ORDER_NO", "MARKET_ID", f"{LISTING_SKU} as LISTING_SKU",
        "p_retailprice as UNIT_PRICE", "cast(l_quantity as int) as UNIT_QTY", "'00' as PACKING_STATUS",
        "case l_returnflag when 'R' then 'Y' when 'A' then 'N' end as NO_ITEM_YN",
        "if(l_linestatus = 'F' and l_returnflag = 'A', 'Y', null) as TAG_CHANGE_YN",
    )


def _users(customer: DataFrame) -> DataFrame:
    return customer.filter("c_custkey % 3 <> 0").selectExpr(
        "cast(c_custkey as string) as EMPLOYEE_ID", "if(c_custkey % 7 = 0, null, c_name) as FIRST_NAME",
        "'' as MIDDLE_NAME", "if(c_custkey % 5 = 0, null, c_mktsegment) as LAST_NAME",
        "c_mktsegment as DEPARTMENT_NAME", "'20240101000000' as LAST_LOGIN_DTTM",
    )


def _product_orders(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """One order a month, with the products of that month; a product's lines of a year fall into one order."""
    mapped = part.filter("p_partkey % 40 < 32").selectExpr("p_partkey as l_partkey", "p_partkey", "p_size", "p_brand")
    month = "cast((p_partkey - p_partkey % 4) / 4 as bigint) % 12 + 1"
    return lineitem.withColumnRenamed("l_suppkey", "s_suppkey").join(mapped, "l_partkey").selectExpr(
        f"if(l_orderkey % 97 = 0, null, concat(year(l_shipdate), lpad(cast({month} as string), 2, '0'), '15')) as ORDER_DATE",
        f"if(l_orderkey % 89 = 0, null, cast((year(l_shipdate) - 1990) * 12 + {month} as bigint)) as ORDER_SEQ",
        f"{STD_SKU} as STD_SKU",
        f"{PRODUCT_CODE} as PRODUCT_CODE", f"if(l_linenumber % 2 = 0, {BRAND_CODE}, null) as BRAND_CODE",
        f"if(l_linenumber % 2 = 0, null, {VENDOR_CODE}) as VENDOR_CODE", "cast(l_quantity as int) as ORDER_QTY",
        "'101500' as ORDER_TM", "cast(l_orderkey % 150 as string) as EMPLOYEE_ID",
    )


def tables(spark: SparkSession, folder: str) -> Tables:
    @cache
    def read(name: str) -> DataFrame:
        return load(spark, folder, name)

    @cache
    def table(name: str) -> DataFrame:
        return makers[name]()

    makers = {
        "orders": lambda: _orders(read("orders")),
        "order_items": lambda: _order_items(sold_lines(read("lineitem"), read("orders"), read("part"))),
        "listings": lambda: _listings(read("part")),
        "unlinked_listings": lambda: _unlinked_listings(read("part")),
        "inventory with keys": lambda: _inventory(read("part")),
        "inventory": lambda: table("inventory with keys").drop("PARTKEY", "PRODUCT_CODE"),
        "markets": lambda: _markets(read("nation"), read("region")),
        "users": lambda: _users(read("customer")),
        "brands": lambda: _brands(read("part")),
        "vendors": lambda: _vendors(read("supplier")),
        "vendor_map": lambda: _vendor_map(read("supplier"), table("brands")),
        "products": lambda: _products(read("part")),
        "product_map": lambda: _product_map(table("inventory with keys")),
        "manufacturing_map": lambda: _manufacturing_map(table("product_map")),
        "sizes": lambda: _sizes(read("part")),
        "images": lambda: _images(table("inventory with keys")),
        "product_orders": lambda: _product_orders(read("lineitem"), read("part")),
    }
    return Tables(table)

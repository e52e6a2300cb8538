"""Request batches, punches and sheets over the star-schema test data.

Functions taking a frame instead of a folder also accept a stream of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions.text import color_after_first
from tallyhouse.sample.tables import BRAND_CODE, LISTING_SKU, PRODUCT_CODE, STD_SKU, load, sold_lines
from tallyhouse.sources.tables import Tables


def stream_of(spark: SparkSession, folder: str, name: str, key: str, work: str, batches: int = 3) -> DataFrame:
    """A test table as a stream of several micro-batches: its rows by `key` modulo `batches`, in this order, each in as many files as the
    session has shuffle partitions."""
    table, files = load(spark, folder, name), int(spark.conf.get("spark.sql.shuffle.partitions"))
    for i in range(batches):
        table.filter(F.pmod(F.expr(key), F.lit(batches)) == i).repartition(files).write.mode("append").parquet(f"{work}/{name}")
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(f"{work}/{name}")


def part_of_time(table: DataFrame, moment: str, parts: int = 3) -> str:
    """An expression for the part of its table's span of time that a row lies in, from 0."""
    first, last = table.selectExpr(f"min(unix_micros(cast({moment} as timestamp)))", f"max(unix_micros(cast({moment} as timestamp))) + 1").first()
    return f"cast(least((unix_micros(cast({moment} as timestamp)) - {first or 0}) * {parts} div {max((last or 1) - (first or 0), 1)}, {parts - 1}) as int)"


def packing_requests(spark: SparkSession, folder: str, lineitem: DataFrame | None = None) -> DataFrame:
    """One request per line item: finished lines complete their order, returned ones hold it."""
    lines = load(spark, folder, "lineitem") if lineitem is None else lineitem
    sold = sold_lines(lines, load(spark, folder, "orders"), load(spark, folder, "part"))
    return sold.selectExpr(
        "l_orderkey * 10 + l_linenumber as REQUEST_SEQ",
        "cast(l_orderkey as string) as CHANNEL_ORDER_NO",
        "MARKET_ID",
        "if(l_suppkey % 5 = 0, '', cast(l_suppkey as string)) as EMPLOYEE_ID",
        "if(l_linestatus = 'F', 'Y', 'N') as COMPLETE_YN",
        "if(l_returnflag = 'R', 'Y', null) as HOLD_YN",
        f"""array(named_struct(
            'CHANNEL_ORDER_NO', cast(l_orderkey as string), 'MARKET_ID', MARKET_ID, 'LISTING_SKU', {LISTING_SKU},
            'UNIT_QTY', cast(l_quantity as int), 'NO_ITEM_YN', if(l_returnflag = 'R', 'Y', 'N'),
            'TAG_CHANGE_YN', case l_suppkey % 4 when 0 then 'Y' when 1 then 'N' end)) as ORDER_LIST""",
    )


def employee_requests(customer: DataFrame) -> DataFrame:
    """Two requests per id; some ids exist, some are new or empty, some requests have no name."""
    return customer.selectExpr(
        "c_custkey as REQUEST_SEQ",
        "if(c_custkey % 10 = 3, '', cast(c_custkey - c_custkey % 2 as string)) as EMPLOYEE_ID",
        "if(c_custkey % 4 < 2, concat('New ', c_custkey), '') as FIRST_NAME",
        "if(c_custkey % 6 = 0, 'M', null) as MIDDLE_NAME",
        "if(c_custkey % 5 = 0, null, concat('Last ', c_custkey)) as LAST_NAME",
        "if(c_custkey % 2 = 0, c_mktsegment, '') as DEPARTMENT_NAME",
    )


def punches(events: DataFrame) -> DataFrame:
    """Events as clock punches; the time of every fiftieth event, and of every error, lacks its last character."""
    return events.selectExpr(
        "cast(user_id as string) as EMPLOYEE_ID",
        "left(date_format(ts, 'yyyyMMddHHmmss'), if(event_id % 50 = 0 or event_type = 'error', 13, 14)) as PUNCH_DTTM",
    )


def sheet_grids(part: DataFrame) -> DataFrame:
    """Twenty sheets with a row per part; SKUs stand in two columns among other texts."""
    return part.selectExpr(
        "concat('sheet_', p_partkey % 20) as SHEET_ID",
        "p_partkey as ROW_NO",
        f"array(p_name, {STD_SKU}, 'a-b', if(p_partkey % 3 = 0, {STD_SKU}, null), 'x-y-z-w') as CELLS",
    )


def order_lines(part: DataFrame) -> DataFrame:
    """One new purchase-order line per mapped SKU."""
    return part.filter("p_partkey % 40 < 32").selectExpr(
        "'20240201' as ORDER_DATE", f"{STD_SKU} as STD_SKU", f"{PRODUCT_CODE} as PRODUCT_CODE",
        f"{BRAND_CODE} as BRAND_CODE", "cast(null as string) as VENDOR_CODE",
        "cast(p_partkey % 10 + 1 as int) as ORDER_QTY", "'101500' as ORDER_TM",
        "cast(p_partkey % 150 as string) as EMPLOYEE_ID",
    )


def lookups(t: Tables) -> DataFrame:
    """Product, size and colour of every mapped SKU of valid inventory, as a client would look it up."""
    return t.product_map.join(t.inventory.filter("VALID_YN = 'Y'"), "STD_SKU").select(
        "PRODUCT_CODE", "SIZE_CODE", color_after_first(F.col("PRODUCT_COLOR")).alias("COLOR")
    )

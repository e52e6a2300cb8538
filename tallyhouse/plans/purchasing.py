"""Purchase orders: placing, history, detail, vendor packets and sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions.dates import FIRST_DATE, LAST_DATE, sheet_title
from tallyhouse.functions.text import color_tail, lenient_name, or_default, shown, strip_whitespace, zero_pad
from tallyhouse.operators.keyed import between_dates, splittable
from tallyhouse.operators.ordering import running_total
from tallyhouse.plans.catalog import distinct_sizes
from tallyhouse.sources.tables import Tables

# The number comes first because it tells orders apart: sorts compare it as one word.
SET_KEY = ["ORDER_SEQ", "ORDER_DATE", "PRODUCT_CODE"]
LINE_COLUMNS = [
    "ORDER_DATE", "ORDER_SEQ", "VENDOR_CODE", "VENDOR_NAME", "VENDOR_EMAIL", "ORDERS_FROM", "BRAND_CODE", "BRAND_NAME",
    "PRODUCT_CODE", "PRODUCT_TITLE", "PRODUCT_COLOR", "SHORT_SIZE_CODE", "SIZE_CODE", "ORDER_QTY", "EMPLOYEE_ID",
    "EMPLOYEE_NAME", "MANUFACTURING_CODE", "MANUFACTURING_TITLE", "MANUFACTURING_COLOR",
]
SET_FIELDS = [
    "VENDOR_CODE", "VENDOR_NAME", "VENDOR_EMAIL", "ORDERS_FROM", "BRAND_NAME", "PRODUCT_TITLE", "MANUFACTURING_CODE",
    "EMPLOYEE_ID", "EMPLOYEE_NAME",
]
# Lines of one set come in STD_SKU order; the other columns settle equal SKUs.
LINE_ORDER = [
    "STD_SKU", "VENDOR_CODE", "BRAND_CODE", "EMPLOYEE_ID", "MANUFACTURING_CODE", "MANUFACTURING_COLOR", "ORDER_QTY",
]


def next_order_seq(product_orders: DataFrame, order_date: str) -> DataFrame:
    """The given date and the next free sequence number, which is global and not per date."""
    following = F.coalesce(F.max("ORDER_SEQ"), F.lit(0)) + 1
    return product_orders.agg(following.alias("ORDER_SEQ")).select(F.lit(order_date).alias("ORDER_DATE"), "ORDER_SEQ")


def place_orders(product_orders: DataFrame, lines: DataFrame) -> DataFrame:
    """The lines of one placed order, all with the next sequence number, ready to append.

    Without lines nothing is placed.
    """
    seq = next_order_seq(product_orders, "").select("ORDER_SEQ").scalar()
    return lines.select(
        "ORDER_DATE", seq.alias("ORDER_SEQ"), "STD_SKU", "PRODUCT_CODE", "BRAND_CODE", "VENDOR_CODE", "ORDER_QTY",
        "ORDER_TM", "EMPLOYEE_ID",
    )


def _brand_names(t: Tables) -> DataFrame:
    return t.brands.select("BRAND_CODE", "BRAND_NAME", "EMAIL", F.col("ORDERS_FROM").alias("_brand_from"))


def _vendor_names(t: Tables) -> DataFrame:
    return t.vendors.select("VENDOR_CODE", "VENDOR_NAME", "VENDOR_EMAIL", F.col("ORDERS_FROM").alias("_vendor_from"))


def _staff_names(t: Tables) -> DataFrame:
    return t.users.select("EMPLOYEE_ID", lenient_name(F.col("FIRST_NAME"), F.col("LAST_NAME")).alias("_staff"))


def _staff() -> Column:
    """Staff name, blank when the employee is unknown."""
    return F.coalesce("_staff", F.lit(""))


# What lines can be summed by before the history is taken.
LINE_KEY = ["ORDER_DATE", "ORDER_SEQ", "STD_SKU", "PRODUCT_CODE", "BRAND_CODE", "VENDOR_CODE", "EMPLOYEE_ID"]


def order_history(t: Tables, start: str = FIRST_DATE, end: str = LAST_DATE) -> DataFrame:
    """Quantity per date, sequence, brand or vendor, product and staff, newest first.

    Lines are grouped by brand name before vendor name but show vendor name before brand name. Of
    several shown names or manufacturing codes in a group the smallest is given. A repeated
    (product, SKU) key in the manufacturing map counts the line once per repetition. Lines may be kept sums by LINE_KEY.
    """
    made = t.manufacturing_map.select("PRODUCT_CODE", "STD_SKU", "MANUFACTURING_CODE")
    codes = [*SET_KEY, "BRAND_CODE", "VENDOR_CODE", "EMPLOYEE_ID"]
    # Lines are summed by codes before any name is joined; names then come to the sums.
    by_code = (
        between_dates(t.product_orders, "ORDER_DATE", start, end)
        .join(made, ["PRODUCT_CODE", "STD_SKU"], "left")
        .groupBy(*codes)
        .agg(F.sum("ORDER_QTY").alias("_qty"), F.min(F.coalesce("MANUFACTURING_CODE", F.lit(""))).alias("_made"))
    )
    return (
        by_code.join(splittable(_brand_names(t), "BRAND_CODE"), "BRAND_CODE", "left")
        .join(splittable(_vendor_names(t), "VENDOR_CODE"), "VENDOR_CODE", "left")
        .join(splittable(_staff_names(t), "EMPLOYEE_ID"), "EMPLOYEE_ID", "left")
        .join(t.products.select("PRODUCT_CODE", "PRODUCT_TITLE"), "PRODUCT_CODE")
        .groupBy(
            *SET_KEY, "PRODUCT_TITLE",
            F.coalesce("BRAND_NAME", "VENDOR_NAME").alias("_group_name"),
            _staff().alias("STAFF"),
        )
        .agg(
            F.min(F.coalesce("VENDOR_NAME", "BRAND_NAME")).alias("VENDOR_NAME"),
            F.sum("_qty").alias("TOTAL_QTY"),
            F.min("_made").alias("MANUFACTURING_CODE"),
        )
        .select(
            "ORDER_DATE", "ORDER_SEQ", "VENDOR_NAME", "PRODUCT_CODE", "PRODUCT_TITLE", "TOTAL_QTY", "STAFF",
            "MANUFACTURING_CODE",
        )
        .orderBy(F.col("ORDER_DATE").desc(), F.col("ORDER_SEQ").desc())
    )


def _ordered(t: Tables, order_date: str | None, order_seq: int | None) -> DataFrame:
    """Stored lines of one order, or of all."""
    lines = t.product_orders
    if order_date is not None:
        lines = between_dates(lines, "ORDER_DATE", order_date, order_date)
    if order_seq is not None:
        lines = lines.filter(F.col("ORDER_SEQ") == order_seq)
    return lines.select(
        "ORDER_DATE", "ORDER_SEQ", "STD_SKU", "PRODUCT_CODE", "BRAND_CODE", "VENDOR_CODE", "ORDER_QTY", "EMPLOYEE_ID"
    )


def _detail_lines(t: Tables, order_date: str | None, order_seq: int | None) -> DataFrame:
    """Purchase-order lines with every name, plus their STD_SKU; the vendor falls back to the brand."""
    joined = (
        _ordered(t, order_date, order_seq).join(_brand_names(t), "BRAND_CODE", "left")
        .join(_vendor_names(t), "VENDOR_CODE", "left")
        .join(_staff_names(t), "EMPLOYEE_ID", "left")
        .join(t.manufacturing_map, ["PRODUCT_CODE", "STD_SKU"], "left")
        .join(t.products.select("PRODUCT_CODE", "PRODUCT_TITLE"), "PRODUCT_CODE")
        .join(t.inventory.select("STD_SKU", "PRODUCT_COLOR", "SIZE_CODE"), "STD_SKU")
        .join(t.sizes.select("SIZE_CODE", "SHORT_SIZE_CODE"), "SIZE_CODE")
    )
    blank = F.lit("")
    return joined.withColumns({
        "VENDOR_CODE": F.coalesce("VENDOR_CODE", "BRAND_CODE"),
        "VENDOR_NAME": F.coalesce("VENDOR_NAME", "BRAND_NAME"),
        "VENDOR_EMAIL": F.coalesce("VENDOR_EMAIL", "EMAIL"),
        "ORDERS_FROM": F.coalesce("_vendor_from", "_brand_from"),
        "EMPLOYEE_NAME": _staff(),
        "MANUFACTURING_CODE": F.coalesce("MANUFACTURING_CODE", blank),
        "MANUFACTURING_TITLE": F.coalesce("MANUFACTURING_TITLE", blank),
        "MANUFACTURING_COLOR": F.coalesce("MANUFACTURING_COLOR", blank),
    }).select("STD_SKU", *LINE_COLUMNS)


def order_detail_rows(t: Tables, order_date: str | None = None, order_seq: int | None = None) -> DataFrame:
    """Line-level detail of one order, or of all, newest first and by SKU."""
    lines = _detail_lines(t, order_date, order_seq)
    return lines.orderBy(F.col("ORDER_DATE").desc(), F.col("ORDER_SEQ").desc(), "STD_SKU").select(*LINE_COLUMNS)


def order_set_cells(t: Tables, order_date: str | None = None, order_seq: int | None = None) -> DataFrame:
    """One row per order, product, colour and size, with codes only.

    ORDER_QTY is the last line's quantity, QTY_SUM that of all lines. `_last` keeps the codes of the last line
    and `_first` the first SKU, from which the coarser levels are built without a second scan.
    """
    blank = F.lit("")
    lines = (
        _ordered(t, order_date, order_seq)
        .join(t.manufacturing_map.drop("MANUFACTURING_TITLE"), ["PRODUCT_CODE", "STD_SKU"], "left")
        .join(t.inventory.select("STD_SKU", "PRODUCT_COLOR", "SIZE_CODE"), "STD_SKU")
        .join(t.sizes.select("SIZE_CODE", "SHORT_SIZE_CODE"), "SIZE_CODE")
        .withColumns({
            "_vendor": F.col("VENDOR_CODE"),
            "VENDOR_CODE": F.coalesce("VENDOR_CODE", "BRAND_CODE"),
            "MANUFACTURING_CODE": F.coalesce("MANUFACTURING_CODE", blank),
            "MANUFACTURING_COLOR": F.coalesce("MANUFACTURING_COLOR", blank),
            "PRODUCT_COLOR": strip_whitespace(color_tail(F.col("PRODUCT_COLOR"))),
        })
    )
    return (
        lines.groupBy(*SET_KEY, "PRODUCT_COLOR", "SIZE_CODE")
        .agg(
            F.max(F.struct(*LINE_ORDER, "_vendor")).alias("_last"),
            F.max("SHORT_SIZE_CODE").alias("SHORT_SIZE_CODE"),
            F.sum("ORDER_QTY").alias("QTY_SUM"),
            F.min("STD_SKU").alias("_first"),
        )
        .withColumn("ORDER_QTY", F.col("_last.ORDER_QTY"))
    )


def _named(t: Tables, sets: DataFrame) -> DataFrame:
    """Adds the header fields of the set's last line, whose codes are in `_last`; sets of unknown products are left out."""
    coded = sets.select(
        "*", F.col("_last._vendor").alias("_vendor"),
        *[F.col(f"_last.{c}").alias(c) for c in ("VENDOR_CODE", "BRAND_CODE", "EMPLOYEE_ID", "MANUFACTURING_CODE")],
    )
    vendors = _vendor_names(t).withColumnRenamed("VENDOR_CODE", "_vendor")
    named = (
        coded.join(_brand_names(t), "BRAND_CODE", "left")
        .join(vendors, "_vendor", "left")
        .join(_staff_names(t), "EMPLOYEE_ID", "left")
        .join(t.products.select("PRODUCT_CODE", "PRODUCT_TITLE"), "PRODUCT_CODE")
    )
    return named.withColumns({
        "VENDOR_NAME": F.coalesce("VENDOR_NAME", "BRAND_NAME"),
        "VENDOR_EMAIL": F.coalesce("VENDOR_EMAIL", "EMAIL"),
        "ORDERS_FROM": F.coalesce("_vendor_from", "_brand_from"),
        "EMPLOYEE_NAME": _staff(),
    })


def order_sets(t: Tables, cells: DataFrame) -> DataFrame:
    """One row per order and product: fields of its last line, total of all its lines."""
    sets = cells.groupBy(*SET_KEY).agg(
        F.max("_last").alias("_last"), F.coalesce(F.sum("QTY_SUM"), F.lit(0)).alias("TOTAL_QTY"), F.min("_first").alias("_first")
    )
    return _named(t, sets).select(*SET_KEY, *SET_FIELDS, "TOTAL_QTY", "_first")


def _color_rows(t: Tables, cells: DataFrame) -> DataFrame:
    """One row per order, product and colour: the set's fields and total, the colour's number and a map of size code to cell.

    The map has at most one entry per known size. Set values come from a window over the colours, so cells are read once.
    """
    cell = F.struct("SHORT_SIZE_CODE", "ORDER_QTY")
    colors = cells.groupBy(*SET_KEY, "PRODUCT_COLOR").agg(
        F.max("_last").alias("_own"), F.sum("QTY_SUM").alias("_qty"), F.min("_first").alias("FIRST_SKU"),
        F.map_from_entries(F.collect_list(F.struct("SIZE_CODE", cell))).alias("SIZES"),
    )
    whole = Window.partitionBy(*SET_KEY)
    colors = colors.withColumns({
        "_last": F.max("_own").over(whole),
        "TOTAL_QTY": F.coalesce(F.sum("_qty").over(whole), F.lit(0)),
        "COLORS": F.count("*").over(whole),
        "COLOR_NO": F.row_number().over(whole.orderBy("FIRST_SKU", "PRODUCT_COLOR")) - 1,
        "MANUFACTURING_COLOR": F.col("_own.MANUFACTURING_COLOR"),
    })
    return _named(t, colors)


def _size_lists(t: Tables) -> DataFrame:
    """Sizes of every product as an array in size order (at most one entry per known size)."""
    entry = F.struct("SIZE_ORDER", "SIZE_CODE", "SHORT_SIZE_CODE")
    lists = distinct_sizes(t).groupBy("PRODUCT_CODE").agg(F.array_sort(F.collect_list(entry)).alias("SIZE_VARIANT"))
    return splittable(lists, "PRODUCT_CODE")


def _with_sizes(t: Tables, rows: DataFrame) -> DataFrame:
    """Adds SIZE_VARIANT, empty for a product without sizes."""
    none = F.expr("cast(array() as array<struct<SIZE_ORDER:int,SIZE_CODE:string,SHORT_SIZE_CODE:string>>)")
    return rows.join(_size_lists(t), "PRODUCT_CODE", "left").withColumn("SIZE_VARIANT", F.coalesce("SIZE_VARIANT", none))


def order_detail_nested(t: Tables, order_date: str | None = None, order_seq: int | None = None) -> DataFrame:
    """Per order, product and colour: header, total of the product, the colour's size map, the product's sizes.

    A colour and size ordered twice shows the last line, while the total counts both. COLOR_NO counts the colours of a set
    from 0 in the order of their first SKU.
    """
    rows = _with_sizes(t, _color_rows(t, order_set_cells(t, order_date, order_seq)))
    return rows.select(
        *SET_KEY, *SET_FIELDS, "TOTAL_QTY", "COLOR_NO", "PRODUCT_COLOR", "MANUFACTURING_COLOR", "SIZES", "SIZE_VARIANT"
    )


def order_detail_lists(t: Tables, order_date: str, order_seq: int) -> DataFrame:
    """The look-up of one order: a row per product with its colours as the array COLOR_VARIANT, in COLOR_NO order."""
    rows = order_detail_nested(t, order_date, order_seq)
    header = [*SET_KEY, *SET_FIELDS, "TOTAL_QTY", "SIZE_VARIANT"]
    color = F.struct("COLOR_NO", "PRODUCT_COLOR", "MANUFACTURING_COLOR", "SIZES")
    # Maps cannot be compared, so colours are compared by number.
    by_number = lambda a, b: F.when(a["COLOR_NO"] < b["COLOR_NO"], -1).when(a["COLOR_NO"] > b["COLOR_NO"], 1).otherwise(0)
    return rows.groupBy(*header).agg(F.array_sort(F.collect_list(color), by_number).alias("COLOR_VARIANT"))


def vendor_packets(
    t: Tables, now: str, default_company: str, order_date: str | None = None, order_seq: int | None = None
) -> DataFrame:
    """Order sets by order and vendor, with the texts of the mail to that vendor: a row per packet and product.

    POSITION counts the products of a packet from 0 in the order of their first SKU. Header fields are those of the packet's first
    product. `default_company` signs when the vendor names no buyer; `now` dates the attachment. Without vendor and brand
    the code is blank.
    """
    packet = ["ORDER_SEQ", "ORDER_DATE", "VENDOR_CODE"]
    fields = ["VENDOR_NAME", "VENDOR_EMAIL", "ORDERS_FROM", "EMPLOYEE_ID", "EMPLOYEE_NAME"]
    sets = order_sets(t, order_set_cells(t, order_date, order_seq)).withColumn("VENDOR_CODE", F.coalesce("VENDOR_CODE", F.lit("")))
    in_order = Window.partitionBy(*packet).orderBy("_first", "PRODUCT_CODE")
    placed = sets.withColumn("POSITION", F.row_number().over(in_order) - 1).withColumn("_head", F.first(F.struct(*fields)).over(in_order))
    company = or_default(F.col("_head.ORDERS_FROM"), F.lit(default_company))
    number = zero_pad(F.col("ORDER_SEQ"), 10)
    file_date = f"{now[4:6]}-{now[6:8]}-{now[:4]}"
    return placed.select(
        *packet,
        F.col("_head.VENDOR_NAME").alias("VENDOR_NAME"),
        F.split(F.coalesce("_head.VENDOR_EMAIL", F.lit("")), " ").alias("VENDOR_EMAILS"),
        company.alias("ORDERS_FROM"),
        F.col("_head.EMPLOYEE_ID").alias("EMPLOYEE_ID"),
        or_default(F.col("_head.EMPLOYEE_NAME"), company).alias("EMPLOYEE_NAME"),
        number.alias("ORDER_NO"),
        F.concat(company, F.lit("_"), shown(F.col("_head.VENDOR_NAME")), F.lit("_"), number, F.lit(f" {file_date}.pdf"))
        .alias("ATTACHMENT_NAME"),
        "POSITION", "PRODUCT_CODE",
    )


def sheet_lines(t: Tables) -> DataFrame:
    """The lines of order sheets: every colour of every order set; the orders of a day form a batch."""
    quantity = lambda s: F.coalesce(F.try_element_at(F.col("_ordered"), s["SIZE_CODE"])["ORDER_QTY"], F.lit(0))
    rows = _with_sizes(t, _color_rows(t, order_set_cells(t)).withColumnRenamed("SIZES", "_ordered"))
    return rows.select(
        F.col("ORDER_DATE").alias("BATCH_ID"),
        F.concat_ws("/", zero_pad(F.col("ORDER_SEQ"), 12), "PRODUCT_CODE").alias("BLOCK_KEY"),
        "COLOR_NO", "COLORS", "BRAND_NAME", "PRODUCT_CODE", "PRODUCT_TITLE", F.col("PRODUCT_COLOR").alias("COLOR"),
        F.transform("SIZE_VARIANT", lambda s: s["SHORT_SIZE_CODE"]).alias("SIZES"),
        F.transform("SIZE_VARIANT", quantity).alias("QTYS"),
        "TOTAL_QTY",
    )


def order_sheet_cells(lines: DataFrame, now: str) -> DataFrame:
    """Sheet rows of batches of order blocks.

    `lines` has a row per block and colour: BATCH_ID (the day), BLOCK_KEY (order within the batch), COLOR_NO from 0, COLORS (their number,
    0 for a block without colours, which has one line), BRAND_NAME, PRODUCT_CODE, PRODUCT_TITLE, SIZES (array of text), COLOR, QTYS (a
    quantity per size) and TOTAL_QTY. Each block gives a heading row and one row per colour, and is followed by an empty
    row. Quantities of zero are blank, and the product and the total stand on the first colour row. Row numbers start at 1 in each
    batch. A batch belongs to the book of its month; its sheet has the title of the time of export.
    """
    first = F.col("COLOR_NO") == 0
    last = F.col("COLOR_NO") + 1 >= F.col("COLORS")
    taken = 1 + F.when(first, 1).otherwise(0) + F.when(last, 1).otherwise(0)  # with the heading and the empty row
    placed = running_total(lines, ["BATCH_ID"], ["BLOCK_KEY", "COLOR_NO"], taken, "_offset")
    blank = F.lit("")
    # Headings of the order sheet.
    heading = F.concat(
        F.array(*[F.lit(h) for h in ("VENDOR", "ITEM", "NAME", "COLOR")]), F.col("SIZES"), F.array(F.lit("TOTAL QTY"))
    )
    quantities = F.transform("QTYS", lambda q: F.when(q > 0, q.cast("string")).otherwise(""))
    body = F.concat(
        F.array(*[F.when(first, F.coalesce(c, blank)).otherwise("") for c in ("BRAND_NAME", "PRODUCT_CODE", "PRODUCT_TITLE")],
                F.coalesce("COLOR", blank)),
        F.when(F.col("COLORS") > 0, quantities).otherwise(F.transform("SIZES", lambda _: blank)),
        F.array(F.when(first, F.col("TOTAL_QTY").cast("string")).otherwise("")),
    )
    shown_rows = F.when(first, F.array(heading, body)).otherwise(F.array(body))
    rows = placed.select("BATCH_ID", "_offset", F.posexplode(shown_rows).alias("_i", "CELLS"))
    return rows.select(
        F.substring("BATCH_ID", 1, 6).alias("BOOK"), "BATCH_ID", sheet_title(F.lit(now)).alias("SHEET_TITLE"),
        (F.col("_offset") + F.col("_i") + 1).alias("ROW_NO"), "CELLS",
    )


def order_print_grid(t: Tables, order_date: str | None = None, order_seq: int | None = None) -> DataFrame:
    """Printed grid: one row per order, product and colour.

    SIZES lists all sizes of the product and CELLS the quantity for each, a dot where nothing or
    zero was ordered. The colour shown is the manufacturer's where there is one.
    """
    code = F.col("MANUFACTURING_CODE")
    item = F.concat(F.col("PRODUCT_CODE"), F.when(code != "", F.concat(F.lit(" ("), code, F.lit(")"))).otherwise(""))

    def cell(size: Column) -> Column:
        quantity = F.try_element_at(F.col("_ordered"), size["SIZE_CODE"])["ORDER_QTY"]
        return F.when(quantity != 0, quantity.cast("string")).otherwise(".")

    rows = _with_sizes(t, _color_rows(t, order_set_cells(t, order_date, order_seq)).withColumnRenamed("SIZES", "_ordered"))
    return rows.select(
        *SET_KEY, "VENDOR_NAME", item.alias("ITEM"), "PRODUCT_TITLE", "FIRST_SKU",
        or_default(F.col("MANUFACTURING_COLOR"), F.col("PRODUCT_COLOR")).alias("COLOR"),
        F.transform("SIZE_VARIANT", lambda s: s["SHORT_SIZE_CODE"]).alias("SIZES"),
        F.transform("SIZE_VARIANT", cell).alias("CELLS"),
        "TOTAL_QTY",
    )

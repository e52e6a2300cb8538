"""Every query over the whole test tables, keyed by name; values take (spark, folder)."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions.dates import screen_date
from tallyhouse.operators.keyed import apply_counted
from tallyhouse.operators.ordering import sorted_page, store_order, stored_page
from tallyhouse.plans import catalog, employees, jobs, labels, orders, packing, punches, purchasing, sales
from tallyhouse.sample import feeds
from tallyhouse.sample.tables import load, tables
from tallyhouse.schemas import KEY_TEXTS, TABLES, in_any_case
from tallyhouse.sources import layouts
from tallyhouse.sources.storage import SHARED_SETTINGS, read_grids, read_snapshot, side_by_side, stored_once, work_folder, write_grid, write_json, write_judged, write_range, write_snapshot, write_tsv
from tallyhouse.sources.sums import Sums, apply_deltas, read_sums, store_sums
from tallyhouse.sources.tables import Tables
from tallyhouse.streaming import feeds as streams

NOW = "20240301123456"
ANCHOR, FIRST_PERIOD = "2024-01-05", 1
COMPANY = "The Company"
EVERY_SKU = "%"  # a label prefix may hold wildcards; this one matches the whole table

Query = Callable[[SparkSession, str], DataFrame]


def _over_tables(plan: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, folder: plan(tables(spark, folder))


def _requests(plan: Callable[[Tables, DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: plan(tables(spark, folder), feeds.packing_requests(spark, folder))


def _from(name: str, feed: Callable[[DataFrame], DataFrame], plan: Callable[[Tables, DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: plan(tables(spark, folder), feed(load(spark, folder, name)))


def _shared(query: Query) -> Query:
    """The query in a session that names a shared folder; where none is named, these checks run on one machine and use a local one."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        if not any(spark.conf.get(setting, None) for setting in SHARED_SETTINGS):
            spark.conf.set(SHARED_SETTINGS[-1], f"file://{tempfile.mkdtemp(prefix='checks-')}")
        return query(spark, folder)

    return run


def _joined(column: str) -> F.Column:
    return F.array_join(column, "|", "null").alias(column)


def _some(rows: DataFrame, condition: str, key: str | F.Column) -> DataFrame:
    """Keys to look up: those of the rows that meet a condition on their values, and one that no table has."""
    keys = rows.filter(condition).select((F.col(key) if isinstance(key, str) else key).alias("KEY"))
    return keys.union(rows.sparkSession.sql("select 'no such key'"))


def _read_back(frame: DataFrame, path: str) -> DataFrame:
    """A text export as it stands in the files; nulls are the word null."""
    names = ", ".join(f"`{c}` string" for c in frame.columns)
    return frame.sparkSession.read.schema(names).csv(path, sep="\t", header=True, quote="", nullValue="null", emptyValue="")


def _tsv_export(plan: Callable[[Tables], DataFrame]) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        frame, path = plan(tables(spark, folder)), work_folder(spark, "export")
        write_tsv(frame, path)
        return _read_back(frame, path)

    return run


def _rejects_twice(spark: SparkSession, folder: str) -> DataFrame:
    """Refused labels appended to the same text table twice, without header."""
    rejects, path = labels.label_split(tables(spark, folder), EVERY_SKU).rejects, work_folder(spark, "rejects")
    for _ in range(2):
        write_tsv(rejects, path, mode="append", header=False)
    names = ", ".join(f"{c} string" for c in rejects.columns)
    return spark.read.schema(names).csv(path, sep="\t", quote="", nullValue="null", emptyValue="")


def _alerts_as_json(spark: SparkSession, folder: str) -> DataFrame:
    alerts, path = packing.packing_alerts(tables(spark, folder), feeds.packing_requests(spark, folder)), work_folder(spark, "alerts")
    write_json(alerts, path)
    return spark.read.schema(alerts.schema).json(path)


def _orders_as_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The orders as a first version, then the updated ones as the next, read back."""
    t, path = tables(spark, folder), work_folder(spark, "orders")
    write_snapshot(t.orders, path)
    stored = t.with_tables(orders=read_snapshot(spark, path))
    write_snapshot(packing.apply_packing(stored, feeds.packing_requests(spark, folder), NOW).orders, path)
    return read_snapshot(spark, path)


def _skus_of_files(spark: SparkSession, folder: str) -> DataFrame:
    """SKUs harvested from sheets that were written as delimited files, one folder per sheet."""
    path = work_folder(spark, "sheets")
    grids = feeds.sheet_grids(load(spark, folder, "part"))
    cells = F.array_join(F.transform("CELLS", lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))), ",", "")
    grids.select("SHEET_ID", cells.alias("value")).repartition("SHEET_ID").write.partitionBy("SHEET_ID").text(path)
    found = jobs.harvest_skus(read_grids(spark, f"{path}/*"))
    return found.withColumn("SHEET_ID", F.regexp_extract("SHEET_ID", "SHEET_ID=([^/]+)", 1)).distinct()


def _scanned(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of the ten newest orders, scanned at tables that are laid out for look-ups."""
    t, path = tables(spark, folder), work_folder(spark, "lookups")
    layouts.store_for_lookups(t, path)
    stored = Tables(lambda name: spark.read.parquet(f"{path}/{name}"))
    newest = sorted_page(stored.orders.select("CHANNEL_ORDER_NO", "ORDER_DATE"), "ORDER_DATE", "desc", size=10, tiebreak=["CHANNEL_ORDER_NO"])
    return orders.scanned_documents(stored, newest.select("CHANNEL_ORDER_NO"))


def _in_buckets(plan: Callable[[Tables], DataFrame], hot: int) -> Query:
    """A plan over orders and items in buckets; the items of orders with more than `hot` of them are stored apart."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        path = work_folder(spark, "buckets")
        buckets = layouts.Buckets(path, int(spark.conf.get("spark.sql.shuffle.partitions")), f"buckets_{path.rsplit('-', 1)[-1]}")
        layouts.store_bucketed(tables(spark, folder), buckets, hot)
        return plan(layouts.open_bucketed(spark, buckets))

    return run


def _updated_months(spark: SparkSession, folder: str) -> str:
    """The folder of orders and items stored by month, after the packing requests changed some of them, twice."""
    t, path = tables(spark, folder), work_folder(spark, "months")
    layouts.store_by_month(t, path)
    changes = packing.packing_update(stored_once(feeds.packing_requests(spark, folder), "requests"), NOW)
    for _ in range(2):  # a repeated update finds nothing to change
        layouts.update_months(spark, f"{path}/orders", changes.order_changes, orders.ORDER_KEY, packing.STATUS_COLUMNS, "REQUEST_SEQ")
        layouts.update_months(spark, f"{path}/order_items", changes.item_changes, packing.ITEM_KEY, packing.FLAG_COLUMNS, "REQUEST_SEQ")
    return path


def _deep_page(spark: SparkSession, folder: str) -> DataFrame:
    """The last full page of all orders, read from an order that is stored once."""
    rows, path = tables(spark, folder).orders.select("CHANNEL_ORDER_NO", "MARKET_ID", "ORDER_DATE", "SHIPPING_STATUS"), work_folder(spark, "order")
    store_order(rows, path, "ORDER_DATE", "desc", ["CHANNEL_ORDER_NO"])
    return stored_page(spark, path, rows.schema, rows.count() // 25 - 1, 25)


def _tracking(t: Tables) -> DataFrame:
    return orders.orders_by_tracking(t, _some(t.orders, "SHIPPING_STATUS = '01'", "CHANNEL_ORDER_NO"))


def _nested_flat(t: Tables) -> DataFrame:
    rows = purchasing.order_detail_nested(t)
    rows = rows.withColumn("ALL_SIZES", F.array_join(F.transform("SIZE_VARIANT", lambda s: s["SHORT_SIZE_CODE"]), "|"))
    header = [c for c in rows.columns if c not in ("SIZES", "SIZE_VARIANT")]
    return rows.select(*header, F.explode("SIZES").alias("SIZE_CODE", "v")).select("*", "v.SHORT_SIZE_CODE", "v.ORDER_QTY").drop("v")


def _packets_flat(t: Tables) -> DataFrame:
    packets = purchasing.vendor_packets(t, NOW, COMPANY)
    return packets.withColumn("VENDOR_EMAILS", _joined("VENDOR_EMAILS"))


def _grid_flat(t: Tables) -> DataFrame:
    grid = purchasing.order_print_grid(t)
    return grid.withColumn("SIZES", _joined("SIZES")).withColumn("CELLS", _joined("CELLS"))


def _sheet_flat(t: Tables) -> DataFrame:
    return purchasing.order_sheet_cells(purchasing.sheet_lines(t), NOW).withColumn("CELLS", _joined("CELLS"))


def _screen_dates(t: Tables) -> DataFrame:
    return t.orders.select("ORDER_DATE").distinct().withColumn("SHOWN_DATE", screen_date(F.col("ORDER_DATE")))


def _page(t: Tables) -> DataFrame:
    rows = t.orders.select("CHANNEL_ORDER_NO", "MARKET_ID", "ORDER_DATE", "SHIPPING_STATUS")
    return sorted_page(rows, "ORDER_DATE", "desc", page=2, size=25, tiebreak=["CHANNEL_ORDER_NO"])


def _stream_updates(spark: SparkSession, folder: str) -> Tables:
    work = work_folder(spark, "packing-updates")
    requests = feeds.packing_requests(spark, folder, feeds.stream_of(spark, folder, "lineitem", "l_orderkey", work))
    streams.stream_packing_updates(requests, f"{work}/log", f"{work}/state", lambda: NOW).awaitTermination()
    return streams.packing_state(tables(spark, folder), f"{work}/log")


def _stream_alerts(spark: SparkSession, folder: str) -> DataFrame:
    work = work_folder(spark, "packing-alerts")
    requests = feeds.packing_requests(spark, folder, feeds.stream_of(spark, folder, "lineitem", "l_orderkey", work))
    alerts = streams.stream_packing_alerts(tables(spark, folder), requests)
    streams.run_append(alerts, f"{work}/alerts", f"{work}/state").awaitTermination()
    return spark.read.schema(alerts.schema).parquet(f"{work}/alerts")


def _punches_in_order(spark: SparkSession, folder: str, work: str) -> DataFrame:
    """Punches that arrive in the order of time, or a watermark would leave late ones out."""
    return feeds.punches(feeds.stream_of(spark, folder, "events", feeds.part_of_time(load(spark, folder, "events"), "ts"), work))


def _stream_punches(spark: SparkSession, folder: str) -> DataFrame:
    work = work_folder(spark, "punches")
    feed = _punches_in_order(spark, folder, work)
    rows = streams.stream_punches(tables(spark, folder), feed, ANCHOR, FIRST_PERIOD)
    streams.run_append(rows, f"{work}/punches", f"{work}/state").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{work}/punches").drop("TS")


def _stream_punch_counts(spark: SparkSession, folder: str) -> DataFrame:
    work = work_folder(spark, "punch-counts")
    feed = _punches_in_order(spark, folder, work)
    rows = streams.stream_punches(tables(spark, folder), feed, ANCHOR, FIRST_PERIOD)
    counts = streams.stream_punch_counts(rows, ANCHOR)
    streams.run_punch_counts(counts, f"{work}/counts", f"{work}/state").awaitTermination()
    return streams.punch_counts(spark, f"{work}/counts")


def _late_counts(spark: SparkSession, folder: str) -> str:
    """The folder of counts and late punches of a feed whose later parts come first."""
    work = work_folder(spark, "late-punches")
    backwards = f"2 - {feeds.part_of_time(load(spark, folder, 'events'), 'ts')}"
    feed = feeds.punches(feeds.stream_of(spark, folder, "events", backwards, work))
    rows = streams.stream_punches(tables(spark, folder), feed, ANCHOR, FIRST_PERIOD)
    streams.run_counts_with_late(rows, f"{work}/out", f"{work}/state").awaitTermination()
    return f"{work}/out"


def _stream_latest(spark: SparkSession, folder: str) -> Tables:
    work = work_folder(spark, "latest")
    requests = feeds.packing_requests(spark, folder, feeds.stream_of(spark, folder, "lineitem", "2 - l_orderkey", work))
    latest = streams.stream_latest_changes(requests, F.lit(NOW))
    streams.run_latest_changes(latest, f"{work}/latest", f"{work}/state").awaitTermination()
    return streams.current_state(tables(spark, folder), f"{work}/latest")


def _items_stored(t: Tables) -> Tables:
    """The bundle with its order items as a stored table, which they are outside these checks, and not as joins of the test tables."""
    return t.with_tables(order_items=stored_once(t.order_items, "items"))


def _kept_sales(spark: SparkSession, folder: str) -> DataFrame:
    """Sums of the sales of even orders, then a batch with the odd ones' items and one that withdraws and adds the larger items again."""
    t, kept = _items_stored(tables(spark, folder)), Sums(work_folder(spark, "sums"), sales.SUM_KEY, "UNIT_QTY", "ORDER_DATE", 6)
    odd = F.right("CHANNEL_ORDER_NO", F.lit(1)).cast("int") % 2 == 1
    some = lambda condition: sales.sold_items(t.with_tables(orders=t.orders.filter(condition)))
    large = sales.sold_items(t).filter("UNIT_QTY > 25")
    store_sums(some(~odd), kept)
    for batch, (added, gone) in enumerate([(some(odd), large.limit(0)), (large.limit(0), large), (large, large.limit(0))]):
        apply_deltas(spark, kept, batch, added, gone)
    return sales.sales_by_sku_long(t, sums=read_sums(spark, kept, "ORDER_QTY", "ORDER_CNT"))


def _kept_history(spark: SparkSession, folder: str) -> DataFrame:
    """The history of purchase orders over kept sums of their lines, those of brands and those of vendors in two batches."""
    t, kept = tables(spark, folder), Sums(work_folder(spark, "sums"), purchasing.LINE_KEY, "ORDER_QTY", "ORDER_DATE", 6)
    lines = t.product_orders
    store_sums(lines.limit(0), kept)
    for batch, condition in enumerate(["BRAND_CODE is null", "BRAND_CODE is not null"]):
        apply_deltas(spark, kept, batch, lines.filter(condition), lines.limit(0))
    return purchasing.order_history(t.with_tables(product_orders=read_sums(spark, kept, "ORDER_QTY", "LINES")))


def _sales_in_any_case(spark: SparkSession, folder: str) -> DataFrame:
    """Sales where the listings spell some standard SKUs in lower case, which the inventory does not."""
    t, path = tables(spark, folder), work_folder(spark, "any-case")
    spelled = F.when(F.col("STD_SKU").like("%-C1-%"), F.lower("STD_SKU")).otherwise(F.col("STD_SKU"))
    t = t.with_tables(listings=t.listings.withColumn("STD_SKU", spelled))
    rows = {name: getattr(t, name) for name in TABLES}
    side_by_side(spark, [partial(rows[name].write.parquet, f"{path}/{name}") for name in TABLES])
    loose = {name: spark.read.schema(in_any_case(rows[name].schema)).parquet(f"{path}/{name}") for name in TABLES}
    found = sales.sales_by_sku_long(Tables(loose.__getitem__))
    return found.select(*[F.col(c).cast("string").alias(c) if c in KEY_TEXTS else F.col(c) for c in found.columns])


def _employee_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many additions were accepted and refused, counted while they were written."""
    requests = feeds.employee_requests(load(spark, folder, "customer"))
    counts = write_judged(employees.judged_additions(tables(spark, folder), requests, NOW), work_folder(spark, "judged"))
    return spark.createDataFrame([(counts["accepted"], counts["refused"])], "ACCEPTED long, REFUSED long")


def _status_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Orders, those that a packing request matched, and those it changed, counted while the updated orders were written."""
    t = tables(spark, folder)
    changes = packing.packing_update(feeds.packing_requests(spark, folder), NOW).order_changes
    after, seen = apply_counted(t.orders, changes, orders.ORDER_KEY, packing.STATUS_COLUMNS, "REQUEST_SEQ")
    after.write.parquet(work_folder(spark, "orders"))
    return spark.createDataFrame([(seen.get["rows"], seen.get["matched"], seen.get["changed"])], "ORDERS long, MATCHED long, CHANGED long")


def _links(part: DataFrame) -> DataFrame:
    """A row per part: formulas that link to one of its brand's or size's sheets, in two spellings, addresses that end early, and plain names."""
    start = "if(p_partkey % 2 = 0, '=HYPERLINK(\"', ' =Hyperlink(\"')"
    address = "concat('https://sheets.example.test/spreadsheets/d', if(p_partkey % 5 = 4, '', concat('/', if(p_partkey % 3 = 0, p_brand, concat('size ', p_size)), '/edit')))"
    return part.selectExpr("'index' as SHEET_ID", "p_partkey as ROW_NO", f"array(if(p_partkey % 7 = 0, p_name, concat({start}, {address}, '\",\"', p_name, '\")')), p_type) as CELLS")


def _range_in_sheet(spark: SparkSession, folder: str) -> DataFrame:
    """Sheets with a block of brands and types written into them from row 3 and column 4 on, as files and read back."""
    part, path = load(spark, folder, "part"), work_folder(spark, "ranges")
    block = part.selectExpr("concat('sheet_', p_partkey % 20) as SHEET_ID", "p_partkey div 20 + 1 as ROW_NO", "array(p_brand, null, p_type) as CELLS")
    sheet = part.selectExpr("concat('sheet_', p_partkey % 20) as SHEET_ID", "p_partkey div 20 + 1 as ROW_NO",
                            "if(p_partkey % 3 = 0, array(p_name), array(p_name, 'b', concat('say \"', p_size, '\", all'), 'd', null, 'f', 'g')) as CELLS")
    write_grid(write_range(sheet, block, 3, 4), path)
    found = read_grids(spark, f"{path}/*")
    cells = F.array_join("CELLS", "|", "null").alias("CELLS")
    return found.select(F.regexp_extract("SHEET_ID", "SHEET_ID=([^/]+)", 1).alias("SHEET_ID"), "ROW_NO", cells)


def _stream_orders(spark: SparkSession, folder: str) -> DataFrame:
    work = work_folder(spark, "purchase-orders")
    lines = feeds.order_lines(feeds.stream_of(spark, folder, "part", "p_partkey", work))
    placed = streams.stream_purchase_orders(
        tables(spark, folder).product_orders, lines, f"{work}/placed", f"{work}/ledger", f"{work}/state"
    )
    placed.awaitTermination()
    return spark.read.parquet(f"{work}/placed").drop("BATCH_ID")


def _next_periods(t: Tables, feed: DataFrame) -> DataFrame:
    periods = punches.punch_pay_periods(t, feed, ANCHOR, FIRST_PERIOD).select("PERIOD_LABEL", "PERIOD_FROM").distinct()
    following = punches.next_period(F.col("PERIOD_LABEL"), F.year(F.date_add("PERIOD_FROM", punches.PERIOD_DAYS - 1)))
    return periods.select("PERIOD_LABEL", following.alias("n")).select("PERIOD_LABEL", F.col("n.PERIOD_FROM").alias("NEXT_FROM"), F.col("n.PERIOD_LABEL").alias("NEXT_LABEL"))


def _ids(t: Tables) -> DataFrame:
    return t.orders.select("EMPLOYEE_ID").filter("EMPLOYEE_ID is not null")


_QUERIES: dict[str, Query] = {
    # Orders and fulfilment
    "market_meta": _over_tables(lambda t: orders.market_meta(t, unknown=True)),
    "orders_by_tracking": _over_tables(_tracking),
    "order_items": _over_tables(orders.order_items),
    "order_items_of_held": _over_tables(lambda t: orders.order_items(t, t.orders.filter("SHIPPING_STATUS = '02'"))),
    "listing_items": _over_tables(lambda t: orders.listing_items(t, t.order_items)),
    "unlinked_listing_items": _over_tables(lambda t: orders.unlinked_listing_items(t, t.order_items)),
    "brand_by_code": _over_tables(
        lambda t: orders.brand_by_code(t, _some(t.listings, "CREATED_DTTM = 'bad'", orders.brand_code_of(F.col("LISTING_SKU"))))
    ),
    "images_by_sku": _over_tables(lambda t: orders.images_by_sku(t, t.product_map.select("STD_SKU"))),
    "order_document": _over_tables(orders.order_document),
    "order_document_lines": _over_tables(orders.order_document_lines),
    "packing_update_orders": _requests(lambda t, r: packing.packing_update(r, NOW).order_changes),
    "packing_update_items": _requests(lambda t, r: packing.packing_update(r, NOW).item_changes),
    "packing_update_rejects": _requests(lambda t, r: packing.packing_update(r, NOW).rejects),
    "update_order_status": _requests(lambda t, r: packing.apply_packing(t, r, NOW).orders),
    "update_order_item_flags": _requests(lambda t, r: packing.apply_packing(t, r, NOW).order_items),
    "packing_alerts": _requests(packing.packing_alerts),
    "sales_by_sku_long": _over_tables(sales.sales_by_sku_long),
    "sales_by_sku_wide": _over_tables(sales.sales_by_sku_wide),
    "sales_by_sku_tsv": _over_tables(sales.sales_by_sku_tsv),
    "sales_of_two_markets": _over_tables(lambda t: sales.sales_by_sku_wide(t, markets=[5, 2])),
    "packing_status": _over_tables(packing.packing_status),
    "packing_status_tsv": _over_tables(packing.packing_status_tsv),
    "no_item_tag_change_counts": _over_tables(packing.no_item_tag_change_counts),
    "daily_flag_messages": _over_tables(packing.daily_flag_messages),
    # Employees
    "employees": _over_tables(employees.employees),
    "employee_by_id": _over_tables(lambda t: employees.employee_by_id(t, _ids(t))),
    "employee_misses": _over_tables(lambda t: employees.employee_misses(t, _ids(t))),
    "add_employees": _from("customer", feeds.employee_requests, lambda t, r: employees.add_employees(t, r, NOW).added),
    "add_employees_rejects": _from("customer", feeds.employee_requests, lambda t, r: employees.add_employees(t, r, NOW).rejects),
    "modify_employees": _from("customer", feeds.employee_requests, lambda t, r: employees.modify_employees(t, r, NOW).employees),
    "modify_employees_rejects": _from(
        "customer", feeds.employee_requests, lambda t, r: employees.modify_employees(t, r, NOW).rejects
    ),
    # Catalog
    "brand_list": _over_tables(catalog.brand_list),
    "brands_with_product": _over_tables(catalog.brands_with_product),
    "vendor_list": _over_tables(catalog.vendor_list),
    "vendor_map": _over_tables(lambda t: catalog.vendor_map(t, _some(t.vendors, "ORDERS_FROM = ''", "VENDOR_CODE"))),
    "product_list": _over_tables(lambda t: catalog.product_list(t, _some(t.brands, "EMAIL is not null and BRAND_CODE > '10'", "BRAND_CODE"))),
    "all_product_list": _over_tables(catalog.all_product_list),
    "vendor_product_list": _over_tables(lambda t: catalog.vendor_product_list(t, _some(t.vendors, "ORDERS_FROM = ''", "VENDOR_CODE"))),
    "all_vendor_product_list": _over_tables(catalog.all_vendor_product_list),
    "product_variants": _over_tables(lambda t: catalog.product_variants(t, _some(t.products, "ORDER_BY_SIZE = 'Y'", "PRODUCT_CODE"))),
    "all_product_variants": _over_tables(catalog.all_product_variants),
    "product_sizes": _over_tables(lambda t: catalog.product_sizes(t, _some(t.products, "ORDER_BY_SIZE = 'Y'", "PRODUCT_CODE"))),
    "all_product_sizes": _over_tables(catalog.product_sizes),
    "std_sku_by_size_color": _over_tables(lambda t: catalog.std_sku_by_size_color(t, feeds.lookups(t))),
    # Purchase orders
    "next_order_seq": _over_tables(lambda t: purchasing.next_order_seq(t.product_orders, NOW[:8])),
    "place_orders": _from("part", feeds.order_lines, lambda t, r: purchasing.place_orders(t.product_orders, r)),
    "order_history": _over_tables(purchasing.order_history),
    "order_detail_rows": _over_tables(purchasing.order_detail_rows),
    "order_detail_nested": _over_tables(_nested_flat),
    "vendor_packets": _over_tables(_packets_flat),
    "order_sheet_cells": _over_tables(_sheet_flat),
    "order_print_grid": _over_tables(_grid_flat),
    # Labels
    "label_rows": _over_tables(lambda t: labels.label_rows(t, EVERY_SKU)),
    "label_rows_in_any_case": _over_tables(lambda t: labels.label_rows(t, "p000", ignore_case=True)),
    "label_split": _over_tables(lambda t: labels.label_split(t, EVERY_SKU).printable),
    "label_split_rejects": _over_tables(lambda t: labels.label_split(t, EVERY_SKU).rejects),
    "label_pages": _over_tables(lambda t: labels.label_pages(t, EVERY_SKU)),
    # Batch data jobs
    "extract_by_market": _over_tables(jobs.extract_by_market),
    "extract_unlisted_only": _over_tables(lambda t: jobs.extract_by_market(t, unlisted_only=True)),
    "image_pivot": _over_tables(jobs.image_pivot),
    "clean_name_size": _over_tables(lambda t: jobs.clean_name_size(t.inventory)),
    "clean_name_paren": _over_tables(lambda t: jobs.clean_name_paren(t.inventory)),
    "clean_name_close_paren": _over_tables(lambda t: jobs.clean_name_close_paren(t.inventory)),
    "clean_names": _over_tables(lambda t: jobs.clean_names(t.inventory)),
    "harvest_skus": _from("part", feeds.sheet_grids, lambda t, g: jobs.harvest_skus(g)),
    # Clock punches
    "punches_valid": _from("events", feeds.punches, lambda t, p: punches.punches_valid(t, p).accepted),
    "punches_valid_rejects": _from("events", feeds.punches, lambda t, p: punches.punches_valid(t, p).rejects),
    "punch_pay_periods": _from("events", feeds.punches, lambda t, p: punches.punch_pay_periods(t, p, ANCHOR, FIRST_PERIOD)),
    "next_pay_periods": _from("events", feeds.punches, _next_periods),
    # Screen queries
    "sorted_page": _over_tables(_page),
    "display_date": _over_tables(_screen_dates),
    # Outputs, written and read back
    "export_sales": _tsv_export(sales.sales_by_sku_tsv),
    "export_packing": _tsv_export(packing.packing_status_tsv),
    "append_label_rejects": _rejects_twice,
    "alerts_as_json": _alerts_as_json,
    "orders_as_snapshot": _orders_as_snapshot,
    "harvest_sheet_files": _skus_of_files,
    # Stored layouts
    "scanned_documents": _scanned,
    "sales_in_buckets": _in_buckets(sales.sales_by_sku_long, 6),
    "packing_in_buckets": _in_buckets(packing.packing_status, 6),
    "orders_updated_by_month": lambda spark, folder: layouts.read_months(spark, f"{_updated_months(spark, folder)}/orders").drop("ORDER_MONTH"),
    "items_updated_by_month": lambda spark, folder: layouts.read_months(spark, f"{_updated_months(spark, folder)}/order_items").drop("ORDER_MONTH"),
    "deep_page": _deep_page,
    # Streams
    "stream_packing_updates": lambda spark, folder: _stream_updates(spark, folder).orders,
    "stream_packing_item_updates": lambda spark, folder: _stream_updates(spark, folder).order_items,
    "stream_packing_alerts": _stream_alerts,
    "stream_punches": _stream_punches,
    "stream_punch_counts": _stream_punch_counts,
    "stream_purchase_orders": _stream_orders,
    "stream_latest_orders": lambda spark, folder: _stream_latest(spark, folder).orders,
    "stream_latest_items": lambda spark, folder: _stream_latest(spark, folder).order_items,
    "stream_late_punches": lambda spark, folder: streams.late_punches(spark, _late_counts(spark, folder)).select("EMPLOYEE_ID", "PUNCH_DTTM", "PERIOD_FROM"),
    "stream_counts_with_late": lambda spark, folder: streams.fold_late(spark, _late_counts(spark, folder)),
    # Kept sums, keys in any case, counts of a write, ranges of a sheet
    "kept_sales": _kept_sales,
    "kept_history": _kept_history,
    "sales_in_any_case": _sales_in_any_case,
    "added_employee_counts": _employee_counts,
    "status_update_counts": _status_counts,
    "range_in_sheet": _range_in_sheet,
    "linked_ids": lambda spark, folder: jobs.linked_ids(_links(load(spark, folder, "part"))),
}

QUERIES: dict[str, Query] = {name: _shared(query) for name, query in _QUERIES.items()}

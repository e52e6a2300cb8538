"""Small cases for the semantics that are easy to get wrong."""

from decimal import Decimal

from pyspark.sql import functions as F

from tallyhouse.functions import dates, text
from tallyhouse.operators.keyed import apply_counted
from tallyhouse.plans import catalog, employees, jobs, labels, orders, packing, punches, purchasing, sales
from tallyhouse.schemas import EMPLOYEE_REQUEST, ORDER_LINE, PACKING_REQUEST, PUNCH, SHEET_GRID, TABLES
from tallyhouse.sources import storage
from tallyhouse.sources.tables import read_parquet

NOW = "20240301123456"


def order(no="1", market=1, date="20240101", **more):
    return {"CHANNEL_ORDER_NO": no, "MARKET_ID": market, "ORDER_DATE": date, **more}


def item(sku, qty=1, no="1", market=1, **more):
    return {"CHANNEL_ORDER_NO": no, "MARKET_ID": market, "LISTING_SKU": sku, "UNIT_QTY": qty, **more}


def listing(sku, std, market=1, valid="Y", **more):
    return {"LISTING_SKU": sku, "STD_SKU": std, "MARKET_ID": market, "VALID_YN": valid, **more}


def stock(std, name="name", valid="Y", **more):
    return {"STD_SKU": std, "PRODUCT_NAME": name, "VALID_YN": valid, **more}


def unlinked(sku, name="unlinked", market=1, valid="Y", **more):
    return {"LISTING_SKU": sku, "LISTING_PRODUCT_NAME": name, "MARKET_ID": market, "VALID_YN": valid, **more}


MARKET = {"MARKET_ID": 1, "BRAND_NAME": "Brand", "CHANNEL_NAME": "Channel", "MARKET_IMAGE_PATH": "m.png"}


def values(spark, column, texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string")
    return [r[0] for r in frame.orderBy("i").select(column(F.col("c"))).collect()]


def test_sales_null_sku_and_invalid_inventory_are_in_neither_part(shop, got):
    t = shop(
        orders=[order()], markets=[MARKET],
        order_items=[item(None), item("bad stock", 2), item("only unlinked", 3), item("both", 4), item("nowhere", 5)],
        listings=[listing("bad stock", "A"), listing("both", "B")],
        inventory=[stock("A", valid="N"), stock("B", "b")],
        unlinked_listings=[unlinked("bad stock"), unlinked("only unlinked", "u"), unlinked("both")],
    )
    long = sales.sales_by_sku_long(t)
    assert got(long, "LISTING_SKU", "STD_SKU", "PRODUCT_NAME", "ORDER_QTY", "INVENTORY_YN") == [
        ("both", "B", "b", 4, "Y"), ("only unlinked", "only unlinked", "u", 3, "N"),
    ]
    assert got(packing.packing_status(t), "LISTING_SKU", "INVENTORY_YN") == [("both", "Y"), ("only unlinked", "N")]


def test_sales_listing_with_two_skus_repeats_and_copies_collapse(shop, got):
    t = shop(
        orders=[order()], markets=[MARKET], order_items=[item("L", 2), item("L", 5)],
        listings=[listing("L", "A"), listing("L", "A"), listing("L", "B")], inventory=[stock("A"), stock("B")],
    )
    assert got(sales.sales_by_sku_long(t), "STD_SKU", "ORDER_QTY", "ORDER_CNT") == [("A", 7, 2), ("B", 7, 2)]


def test_sales_cell_shows_last_listing_while_total_adds(shop, got):
    t = shop(
        orders=[order(), order("2", 3)], markets=[MARKET, {**MARKET, "MARKET_ID": 3}],
        order_items=[item("L1", 10), item("L2", 1), item("L0", 7, "2", 3)],
        listings=[listing("L1", "A"), listing("L2", "A"), listing("L0", "A", 3)], inventory=[stock("A", "")],
    )
    wide = sales.sales_by_sku_wide(t)
    assert got(wide, "TOTAL_ORDER_CNT", "MARKET_1", "MARKET_3", "MARKET_8", "LISTING_SKU", "PRODUCT_NAME") == [
        (18, 1, 7, None, "L1", "")
    ]
    tsv = sales.sales_by_sku_tsv(t, market_titles={1: "One"})
    assert tsv.columns[4:7] == ["One", "Market 8", "Market 2"]
    assert got(tsv, "Order Date", "One", "Market 8", "Inventory Y/N") == [("2024-01-01", 1, 0, "Y")]


def test_sales_of_no_orders_is_empty(shop):
    assert sales.sales_by_sku_wide(shop()).isEmpty()


def test_sales_date_range_is_inclusive(shop, got):
    t = shop(
        orders=[order(str(d), date=f"2024010{d}") for d in range(1, 5)], markets=[MARKET],
        order_items=[item("L", d, str(d)) for d in range(1, 5)], listings=[listing("L", "A")], inventory=[stock("A")],
    )
    assert got(sales.sales_by_sku_long(t, "20240102", "20240103"), "ORDER_QTY") == [(2,), (3,)]


def test_color_tails(spark):
    texts = ["A_B_RED", "RED", "A_", "_", "", None, "A_ green "]
    assert values(spark, text.color_tail, texts) == ["RED", "RED", "", "", "", None, " green "]
    assert values(spark, text.color_tail_trimmed, texts) == ["RED", "RED", "", "", "", None, "green"]
    assert values(spark, text.color_after_first, texts) == ["B_RED", "RED", "", "", "", None, "green"]


def test_history_groups_by_brand_first_and_shows_vendor_first(shop, got):
    line = {"ORDER_DATE": "20240101", "ORDER_SEQ": 1, "PRODUCT_CODE": "P", "ORDER_QTY": 2}
    t = shop(
        product_orders=[{**line, "STD_SKU": "S1", "BRAND_CODE": "B", "VENDOR_CODE": "V"},
                        {**line, "STD_SKU": "S2", "BRAND_CODE": "B"}],
        brands=[{"BRAND_CODE": "B", "BRAND_NAME": "The brand"}], vendors=[{"VENDOR_CODE": "V", "VENDOR_NAME": "A vendor"}],
        products=[{"PRODUCT_CODE": "P", "PRODUCT_TITLE": "title"}],
        manufacturing_map=[{"PRODUCT_CODE": "P", "STD_SKU": "S1", "MANUFACTURING_CODE": m} for m in ("M2", "M1")],
    )
    # Both lines share the brand; S1 is counted once per manufacturing row.
    assert got(purchasing.order_history(t), "VENDOR_NAME", "TOTAL_QTY", "MANUFACTURING_CODE", "STAFF") == [("A vendor", 6, "", "")]


def test_employee_names(spark):
    frame = spark.createDataFrame([("A", "B"), (None, "B"), ("A", None), (None, None)], "f string, l string")
    rows = frame.select(text.strict_name(F.col("f"), F.col("l")), text.lenient_name(F.col("f"), F.col("l"))).collect()
    assert [tuple(r) for r in rows] == [("A B", "A B"), (None, "B"), (None, "A"), (None, "")]


def test_extract_listed_sku_loses_its_size_name(shop, got):
    t = shop(
        markets=[MARKET], sizes=[{"SIZE_CODE": "1", "SIZE_NAME": "Size one"}],
        inventory=[stock("listed", SIZE_CODE="1", PRODUCT_SIZE="raw"), stock("free", SIZE_CODE="1", PRODUCT_SIZE="raw"),
                   stock("no size", PRODUCT_SIZE="raw")],
        listings=[listing("L", "listed", LISTING_PRODUCT_PRICE=Decimal("9.5"), LISTING_PRODUCT_QTY=2, CREATED_DTTM="20200230000000")],
    )
    rows = got(jobs.extract_by_market(t), "STD_SKU", "PRODUCT_SIZE", "CHANNEL_NAME", "LISTING_PRODUCT_PRICE", "LISTING_PRODUCT_QTY")
    assert rows == [
        ("free", "Size one", "", "", ""), ("listed", "Size one", "Channel", "9.50", "2"), ("listed", "raw", "", "", ""),
        ("no size", "raw", "", "", ""),
    ]
    assert [r[0] for r in got(jobs.extract_by_market(t, unlisted_only=True), "STD_SKU")] == ["free", "listed", "no size"]


def test_bad_stamps_are_null(spark):
    stamps = values(spark, dates.parse_stamp, ["20240131235959", "bad", "20200230000000", None])
    assert [str(s) for s in stamps] == ["2024-01-31 23:59:59", "None", "None", "None"]


def cleaned(make, job, names, **options):
    frame = make(TABLES["inventory"], [stock(str(i), n) for i, n in enumerate(names)])
    return [r[0] for r in job(frame, **options).orderBy("STD_SKU").select("PRODUCT_NAME").collect()]


def test_name_clean_up(make):
    kept = jobs.KEEP_NAMES[0]
    names = ["shirt, no paren", "shirt (a, b) x", kept, "no comma (a)", "Unisex Fleece Sweat Shorts, (a)", None]
    assert cleaned(make, jobs.clean_name_paren, names) == ["", "shirt", kept, names[3], names[4], None]
    assert cleaned(make, jobs.clean_name_paren, names, guard=True)[0] == names[0]
    assert cleaned(make, jobs.clean_name_close_paren, names) == [
        "shirt, no paren)", "shirt (a, b)", kept, names[3], "Unisex Fleece Sweat Shorts, (a)", None
    ]
    assert cleaned(make, jobs.clean_name_close_paren, names, guard=True)[0] == names[0]
    assert cleaned(make, jobs.clean_name_size, ["hat  siZe: 5", "hat", "size:"]) == ["hat", "hat", ""]


def test_sequence_is_global(shop, make, got):
    placed = [{"ORDER_DATE": d, "ORDER_SEQ": s} for d, s in (("20240101", 7), ("20240201", 3))]
    assert got(purchasing.next_order_seq(shop().product_orders, NOW[:8])) == [("20240301", 1)]
    t = shop(product_orders=placed)
    lines = make(ORDER_LINE, [{"ORDER_DATE": "20240301", "STD_SKU": s, "ORDER_QTY": 1} for s in "ab"])
    assert got(purchasing.place_orders(t.product_orders, lines), "STD_SKU", "ORDER_SEQ") == [("a", 8), ("b", 8)]
    assert purchasing.place_orders(t.product_orders, make(ORDER_LINE, [])).isEmpty()


def packing_request(seq, no="1", complete=None, hold=None, employee="7", items=()):
    return {"REQUEST_SEQ": seq, "CHANNEL_ORDER_NO": no, "MARKET_ID": 1, "EMPLOYEE_ID": employee, "COMPLETE_YN": complete,
            "HOLD_YN": hold, "ORDER_LIST": [("1", 1, sku, qty, no_item, tag) for sku, qty, no_item, tag in items]}


def test_packing_update(shop, make, got):
    requests = make(PACKING_REQUEST, [
        packing_request(1, "1", "N", "Y"), packing_request(2, "1", "Y", "Y", "", [("L", 3, "Y", "Y"), ("M", 1, "N", None)]),
        packing_request(3, "2", "N", None, "9", [("L", 1, "Y", "N")]),
    ])
    t = shop(
        orders=[order("1", SHIPPING_STATUS="00", EMPLOYEE_ID="1"), order("2"), order("3")],
        order_items=[item("L", no="1"), item("M", no="1", TAG_CHANGE_YN="Y"), item("N", no="1", NO_ITEM_YN="Y")], markets=[MARKET],
    )
    changes = packing.packing_update(requests, NOW)
    assert got(changes.rejects, "REQUEST_SEQ", "CODE") == [(3, 300)]
    after = packing.apply_packing(t, requests, NOW)
    assert got(after.orders, "CHANNEL_ORDER_NO", "SHIPPING_STATUS", "EMPLOYEE_ID", "PROC_DT", "PROC_TM") == [
        ("1", "01", None, "20240301", "123456"), ("2", None, None, None, None), ("3", None, None, None, None)
    ]
    assert got(after.order_items, "LISTING_SKU", "NO_ITEM_YN", "TAG_CHANGE_YN") == [("L", "Y", "Y"), ("M", "N", None), ("N", "Y", None)]
    twice = packing.apply_packing(after, requests, NOW)
    assert got(twice.orders) == got(after.orders)
    assert [m for _, m in got(packing.packing_alerts(t, requests), "KIND", "MESSAGE")] == [
        f"{kind} has been indicated for SKU: L | Marketplace: Brand Channel | Order #: 1 | Order Qty: 3."
        for kind in ("No Item", "Tag Change")
    ]


def test_flag_counts_and_messages(shop, got):
    t = shop(
        orders=[order("1", PROC_DT="20240105"), order("2", PROC_DT="20240106"), order("3")],
        order_items=[item("a", no="1", NO_ITEM_YN="Y", TAG_CHANGE_YN="Y"), item("b", no="1", NO_ITEM_YN="Y"),
                     item("c", no="2", NO_ITEM_YN="N"), item("d", no="3", NO_ITEM_YN="Y")],
    )
    assert got(packing.no_item_tag_change_counts(t)) == [("20240105", 2, 1)]
    assert got(packing.daily_flag_messages(t), "MESSAGE") == [
        ("01/05: Total number of Tag Change: 1\nTotal number of No Item: 2",)
    ]


def test_packing_export_dates_completed_orders_only(shop, got):
    done = {"PROC_DT": "20240105", "PROC_TM": "010203"}
    t = shop(
        orders=[order("1", SHIPPING_STATUS="01", EMPLOYEE_ID="7", **done), order("2", SHIPPING_STATUS="02", **done),
                order("3", SHIPPING_STATUS="01")],
        order_items=[item("L", no=n) for n in "123"], listings=[listing("L", "A")], inventory=[stock("A")], markets=[MARKET],
        users=[{"EMPLOYEE_ID": "7", "FIRST_NAME": "A"}],
    )
    assert got(packing.packing_status_tsv(t), "Order #", "Employee", "Fulfilled Date") == [
        ("1", None, "2024-01-05 01:02:03"), ("2", None, ""), ("3", None, None)
    ]


def test_tracking_keeps_the_right_end(shop, got):
    full = "1" + "0" * 20 + "5"
    t = shop(orders=[order("1", TRACKING_NO="0" * 21 + "5"), order("2", TRACKING_NO=full)])
    assert got(orders.orders_by_tracking(t, "5"), "CHANNEL_ORDER_NO") == [("1",)]
    assert got(orders.orders_by_tracking(t, "99" + full), "CHANNEL_ORDER_NO") == [("2",)]


def test_order_document(shop, got):
    track = "0" * 21
    t = shop(
        orders=[order("1", TRACKING_NO=track + "1"), order("2", TRACKING_NO=track + "2"), order("3", TRACKING_NO=track + "2"),
                order("4", 9, TRACKING_NO=track + "4"), order("5")],
        order_items=[item("1AB-linked", 2, UNIT_PRICE=Decimal("1.50")), item("1AC-unlinked", 1, NO_ITEM_YN="", TAG_CHANGE_YN="Y"),
                     item("1AB-none"), item("1AB-none")],
        listings=[listing("1AB-linked", "S2", LISTING_ITEM_ID=2), listing("1AB-linked", "S1", LISTING_ITEM_ID=1)],
        inventory=[stock("S1", PRODUCT_SIZE="M"), stock("S2")], markets=[MARKET],
        unlinked_listings=[unlinked("1AB-linked", "never"), unlinked("1AC-unlinked", "u", LISTING_PRODUCT_SIZE="XL")],
        images=[{"IMAGE_ID": i, "SKU": "S1", "IMAGE_PATH": f"{i}.png"} for i in (5, 4)],
        brands=[{"BRAND_CODE": "AB", "BRAND_NAME": "AB brand"}],
    )
    lines = orders.order_document_lines(t)
    columns = ("CHANNEL_ORDER_NO", "LISTING_SKU", "STD_SKU", "UNIT_PRICE_SUM", "IMAGE_ID", "LISTING_PRODUCT_NAME",
               "LISTING_PRODUCT_SIZE", "BRAND_NAME", "NO_ITEM_YN", "TAG_CHANGE_YN", "MARKET_IMAGE_PATH")
    expected = [
        ("1", "1AB-linked", "S1", Decimal("3.00"), 4, None, None, "AB brand", "N", "N", "m.png"),
        ("1", "1AB-none", None, None, None, None, None, "AB brand", "N", "N", "m.png"),
        ("1", "1AB-none", None, None, None, None, None, "AB brand", "N", "N", "m.png"),
        ("1", "1AC-unlinked", None, None, None, "u", "XL", None, "N", "Y", "m.png"),
        ("4", None, None, None, None, None, None, None, None, None, None),
    ]
    assert got(lines, *columns) == expected
    document = orders.order_document(t)
    assert got(document.select("CHANNEL_ORDER_NO", "LISTING_SKU", "COPIES")) == [
        ("1", "1AB-linked", 1), ("1", "1AB-none", 2), ("1", "1AC-unlinked", 1), ("4", None, 0)
    ]
    assert got(document, *columns) == sorted(set(expected), key=repr)
    listed = orders.order_document_list(t, "1").collect()
    assert [[(i.LISTING_SKU, i.COPIES) for i in r.ORDER_LIST] for r in listed] == [[("1AB-linked", 1), ("1AB-none", 2), ("1AC-unlinked", 1)]]
    assert [r.ORDER_LIST for r in orders.order_document_list(t, "4").collect()] == [[]]


def test_add_employees(shop, make, got):
    t = shop(users=[{"EMPLOYEE_ID": "1"}])
    requests = make(EMPLOYEE_REQUEST, [
        {"REQUEST_SEQ": 1, "EMPLOYEE_ID": "", "FIRST_NAME": "a"}, {"REQUEST_SEQ": 2, "FIRST_NAME": "a"},
        {"REQUEST_SEQ": 3, "EMPLOYEE_ID": "1", "FIRST_NAME": "a"}, {"REQUEST_SEQ": 4, "EMPLOYEE_ID": "2", "FIRST_NAME": ""},
        {"REQUEST_SEQ": 5, "EMPLOYEE_ID": "2", "LAST_NAME": "b"}, {"REQUEST_SEQ": 6, "EMPLOYEE_ID": "2", "LAST_NAME": "c"},
    ])
    added, rejects = employees.add_employees(t, requests, NOW)
    assert got(added, "EMPLOYEE_ID", "LAST_NAME", "LAST_LOGIN_DTTM") == [("2", "b", NOW)]
    assert got(rejects, "REQUEST_SEQ", "CODE") == [(1, 400), (2, 400), (3, 100), (4, 400), (6, 100)]


def test_linked_ids(make, got):
    cells = ['=HYPERLINK("https://h/spreadsheets/d/one/edit#gid=0","a")', 'x =hyperlink("https://h/a/b/one")', '=Hyperlink("https://h/a/b/two")', '=HYPERLINK("https://h/a/b")', "plain", None, '=HYPERLINK(A1,"b")']
    grids = make(SHEET_GRID, [{"SHEET_ID": "s", "ROW_NO": i, "CELLS": [c, '=HYPERLINK("https://h/a/b/other")']} for i, c in enumerate(cells)] + [{"SHEET_ID": "s", "CELLS": []}, {"SHEET_ID": "s"}])
    assert got(jobs.linked_ids(grids)) == [("one",), ("two",)]


def test_keys_in_any_case(spark, shop, got, tmp_path):
    """With the option spellings of a key are one key in joins, groupings and DISTINCT; without it they are not."""
    t = shop(
        orders=[order("ab1"), order("AB1", market=2)], markets=[MARKET, {**MARKET, "MARKET_ID": 2, "CHANNEL_NAME": "Other"}],
        order_items=[item("sku-a", 2, "AB1"), item("SKU-A", 3, "ab1"), item("sku-b", 5, "Ab1"), item("SKU-a", 7, "aB1", market=2)],
        listings=[listing("Sku-A", "std1"), listing("SKU-A", "std1", market=2), listing("sku-B", "gone")], inventory=[stock("STD1", "name")], unlinked_listings=[unlinked("SKU-B", "u")],
    )
    for name in TABLES:
        getattr(t, name).write.parquet(f"{tmp_path}/{name}")
    strict, loose = (read_parquet(spark, str(tmp_path), any_case) for any_case in (False, True))
    assert got(sales.sales_by_sku_long(strict)) == []
    rows = sales.sales_by_sku_long(loose).selectExpr("upper(STD_SKU)", "upper(LISTING_SKU)", "MARKET_ID", "ORDER_QTY", "ORDER_CNT")
    assert got(rows) == [("STD1", "SKU-A", 1, 5, 2), ("STD1", "SKU-A", 2, 7, 1)]
    assert got(sales.sales_by_sku_wide(loose), "TOTAL_ORDER_CNT", "MARKET_1", "MARKET_2") == [(12, 5, 7)]
    assert packing.packing_status(loose).count() == 2 and orders.order_document(loose).count() == 0  # no tracking numbers
    plan = sales.sales_by_sku_long(loose)._jdf.queryExecution().optimizedPlan().toString()
    assert "lower(" not in plan and "upper(" not in plan


def test_add_employees_settles_equal_numbers(spark, shop, make, got):
    """Requests with equal or missing numbers, and equal ones, add an id once; every other request is refused."""
    t = shop(users=[])
    same = {"REQUEST_SEQ": 5, "EMPLOYEE_ID": "2", "LAST_NAME": "b"}
    requests = make(EMPLOYEE_REQUEST, [
        same, same, same, {**same, "LAST_NAME": "a"}, {**same, "LAST_NAME": None, "FIRST_NAME": "z"}, {"EMPLOYEE_ID": "2", "LAST_NAME": "0"},
        {"EMPLOYEE_ID": "3", "LAST_NAME": "x"}, {"EMPLOYEE_ID": "3", "LAST_NAME": "y"}, {"EMPLOYEE_ID": None, "LAST_NAME": "y"}, {"EMPLOYEE_ID": None, "LAST_NAME": "y"},
    ])
    added, rejects = employees.add_employees(t, requests, NOW)
    assert got(added, "EMPLOYEE_ID", "LAST_NAME") == [("2", "a"), ("3", "x")]
    assert got(rejects, "EMPLOYEE_ID", "REQUEST_SEQ", "CODE") == sorted([("2", 5, 100)] * 4 + [("2", None, 100), ("3", None, 100)] + [(None, None, 400)] * 2, key=repr)


def test_counts_come_with_the_write(spark, shop, make, got, tmp_path):
    """Accepted, refused, matched and changed rows are observed while rows are written: equal to counts of the result, from one scan."""
    t = shop(users=[{"EMPLOYEE_ID": "1"}], orders=[order(str(i), SHIPPING_STATUS="01") for i in range(9)])
    requests = make(EMPLOYEE_REQUEST, [{"REQUEST_SEQ": i, "EMPLOYEE_ID": str(i % 4), "LAST_NAME": "b"} for i in range(20)])
    judged = employees.judged_additions(t, requests, NOW)
    counts = storage.write_judged(judged, f"{tmp_path}/judged")
    added, rejects = employees.add_employees(t, requests, NOW)
    assert counts == {"accepted": added.count(), "refused": rejects.count()} == {"accepted": 3, "refused": 17}
    back = spark.read.parquet(f"{tmp_path}/judged")
    assert got(back.filter("ACCEPTED = 'true'"), "EMPLOYEE_ID", "LAST_NAME") == got(added, "EMPLOYEE_ID", "LAST_NAME")
    changes = spark.createDataFrame([(i, str(i), 1, "02" if i % 2 else "01") for i in range(5)] + [(1, "99", 1, "02")], "n long, CHANNEL_ORDER_NO string, MARKET_ID int, SHIPPING_STATUS string")
    after, seen = apply_counted(t.orders, changes, orders.ORDER_KEY, ["SHIPPING_STATUS"], "n")
    after.write.parquet(f"{tmp_path}/orders")
    assert seen.get == {"rows": 9, "matched": 5, "changed": 2}
    assert got(spark.read.parquet(f"{tmp_path}/orders"), "CHANNEL_ORDER_NO", "SHIPPING_STATUS") == [(str(i), "02" if i in (1, 3) else "01") for i in range(9)]
    plan = after._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CollectMetrics") == 1 and plan.count("SHIPPING_PRICE") and plan.count("LogicalRDD") + plan.count("LocalRelation") <= 2


def test_modify_employees(shop, make, got):
    t = shop(users=[{"EMPLOYEE_ID": "1", "FIRST_NAME": "a", "LAST_NAME": "b", "LAST_LOGIN_DTTM": "old"},
                    {"EMPLOYEE_ID": "2", "FIRST_NAME": "x", "LAST_LOGIN_DTTM": "old"}])
    requests = make(EMPLOYEE_REQUEST, [
        {"REQUEST_SEQ": 1, "EMPLOYEE_ID": "1", "FIRST_NAME": "new", "LAST_NAME": ""},
        {"REQUEST_SEQ": 2, "EMPLOYEE_ID": "1", "FIRST_NAME": "", "LAST_NAME": "B", "DEPARTMENT_NAME": "d"},
        {"REQUEST_SEQ": 3, "EMPLOYEE_ID": "9", "LAST_NAME": "B"}, {"REQUEST_SEQ": 4, "EMPLOYEE_ID": "2"},
    ])
    after, rejects = employees.modify_employees(t, requests, NOW)
    assert got(after) == [("1", "new", None, "B", "d", NOW), ("2", "x", None, None, None, "old")]
    assert got(rejects, "REQUEST_SEQ", "CODE") == [(3, 100), (4, 400)]


def test_employee_lookup_wants_exactly_one(shop, make, got, spark):
    t = shop(users=[{"EMPLOYEE_ID": "1"}, {"EMPLOYEE_ID": "2"}, {"EMPLOYEE_ID": "2"}])
    ids = spark.createDataFrame([("1",), ("1",), ("2",), ("3",)], "id string")
    assert got(employees.employee_by_id(t, ids), "EMPLOYEE_ID") == [("1",)]
    assert got(employees.employee_misses(t, ids), "EMPLOYEE_ID") == [("2",), ("3",)]
    assert got(employees.employee_by_id(t, "1"), "EMPLOYEE_ID") == [("1",)]


def test_catalog_keys(shop, got, spark):
    t = shop(
        products=[{"PRODUCT_CODE": p, "BRAND_CODE": b} for p, b in (("P1", "A"), ("P2", "B"), ("P3", "A"))],
        product_map=[{"PRODUCT_CODE": "P1", "STD_SKU": "s"}, {"PRODUCT_CODE": "P2", "STD_SKU": "t"}],
        manufacturing_map=[{"PRODUCT_CODE": "P1", "STD_SKU": s, "MANUFACTURING_CODE": "M"} for s in "sx"],
        vendor_map=[{"VENDOR_CODE": "V", "BRAND_CODE": "A"}, {"VENDOR_CODE": "W", "BRAND_CODE": "B"}],
        brands=[{"BRAND_CODE": b} for b in "ABC"],
        inventory=[stock("s", PRODUCT_COLOR="x_RED", SIZE_CODE="1"), stock("t", PRODUCT_COLOR="a_b_RED", SIZE_CODE="1")],
        sizes=[{"SIZE_CODE": "1", "SHORT_SIZE_CODE": "S", "SIZE_ORDER": 1}],
    )
    assert got(catalog.product_list(t, "A"), "PRODUCT_CODE", "MANUFACTURING_CODE") == [("P1", "M")]
    assert got(catalog.vendor_product_list(t, "W"), "PRODUCT_CODE", "MANUFACTURING_CODE") == [("P2", "")]
    assert got(catalog.vendor_map(t, "V"), "BRAND_CODE") == [("A",)]
    assert got(catalog.brands_with_product(t), "BRAND_CODE") == [("A",), ("B",)]
    assert got(catalog.product_variants(t, "P2"), "STD_SKU", "PRODUCT_COLOR") == [("t", "RED")]
    assert got(catalog.product_sizes(t, "P1"), "SHORT_SIZE_CODE") == [("S",)]
    wanted = spark.createDataFrame([("P2", "1", "b_RED"), ("P2", "1", "RED")], "PRODUCT_CODE string, SIZE_CODE string, COLOR string")
    assert got(catalog.std_sku_by_size_color(t, wanted), "STD_SKU", "COLOR") == [("t", "b_RED")]


def test_variants_sort_by_raw_color(shop):
    colors = {"a": "z_A", "b": "a_Z", "c": "a_Z"}
    t = shop(
        product_map=[{"PRODUCT_CODE": "P", "STD_SKU": s} for s in colors],
        inventory=[stock(s, PRODUCT_COLOR=c, SIZE_CODE="2" if s == "b" else "1") for s, c in colors.items()],
        sizes=[{"SIZE_CODE": "1", "SIZE_ORDER": 1}, {"SIZE_CODE": "2", "SIZE_ORDER": 2}],
    )
    assert [r.STD_SKU for r in catalog.all_product_variants(t).collect()] == ["c", "b", "a"]


def order_detail(shop):
    line = {"ORDER_DATE": "20240101", "ORDER_SEQ": 12, "PRODUCT_CODE": "P", "EMPLOYEE_ID": "e"}
    return shop(
        product_orders=[
            {**line, "STD_SKU": "s1", "ORDER_QTY": 5, "BRAND_CODE": "B"}, {**line, "STD_SKU": "s2", "ORDER_QTY": 2, "BRAND_CODE": "B"},
            {**line, "STD_SKU": "s3", "ORDER_QTY": 0, "VENDOR_CODE": "V"},
        ],
        brands=[{"BRAND_CODE": "B", "BRAND_NAME": "Brand", "EMAIL": "x@example.test", "ORDERS_FROM": "B buyer"}],
        vendors=[{"VENDOR_CODE": "V", "VENDOR_NAME": "Vendor", "VENDOR_EMAIL": "a@example.test b@example.test", "ORDERS_FROM": ""}],
        products=[{"PRODUCT_CODE": "P", "PRODUCT_TITLE": "title"}],
        inventory=[stock("s1", PRODUCT_COLOR="x_ red", SIZE_CODE="1"), stock("s2", PRODUCT_COLOR="y_red\t", SIZE_CODE="1"),
                   stock("s3", PRODUCT_COLOR="blue", SIZE_CODE="2"), stock("s4", PRODUCT_COLOR="blue", SIZE_CODE="3")],
        sizes=[{"SIZE_CODE": c, "SHORT_SIZE_CODE": f"S{c}", "SIZE_ORDER": 9 - int(c)} for c in "123"],
        product_map=[{"PRODUCT_CODE": "P", "STD_SKU": s} for s in ("s1", "s2", "s3", "s4")],
        manufacturing_map=[{"PRODUCT_CODE": "P", "STD_SKU": "s3", "MANUFACTURING_CODE": "M", "MANUFACTURING_COLOR": "navy"}],
    )


def test_order_detail_nested(shop):
    rows = purchasing.order_detail_nested(order_detail(shop), "20240101", 12).orderBy("COLOR_NO").collect()
    assert {(r.TOTAL_QTY, r.VENDOR_CODE, r.VENDOR_NAME, r.MANUFACTURING_CODE) for r in rows} == {(7, "V", "Vendor", "M")}
    colors = [("red", "", {"1": 2}), ("blue", "navy", {"2": 0})]
    assert [(r.PRODUCT_COLOR, r.MANUFACTURING_COLOR, {k: v.ORDER_QTY for k, v in r.SIZES.items()}) for r in rows] == colors
    assert all([s.SHORT_SIZE_CODE for s in r.SIZE_VARIANT] == ["S3", "S2", "S1"] for r in rows)
    assert purchasing.order_detail_nested(order_detail(shop), "20240101", 13).isEmpty()
    (row,) = purchasing.order_detail_lists(order_detail(shop), "20240101", 12).collect()
    assert [(c.PRODUCT_COLOR, c.MANUFACTURING_COLOR, {k: v.ORDER_QTY for k, v in c.SIZES.items()}) for c in row.COLOR_VARIANT] == colors


def test_print_grid(shop, got):
    grid = purchasing.order_print_grid(order_detail(shop))
    assert got(grid, "ITEM", "COLOR", "SIZES", "CELLS", "TOTAL_QTY") == [
        ("P (M)", "navy", ["S3", "S2", "S1"], [".", ".", "."], 7), ("P (M)", "red", ["S3", "S2", "S1"], [".", ".", "2"], 7)
    ]


def test_vendor_packets(shop, got):
    packets = purchasing.vendor_packets(order_detail(shop), NOW, "Company")
    assert got(packets, "VENDOR_CODE", "VENDOR_EMAILS", "ORDERS_FROM", "EMPLOYEE_NAME", "ORDER_NO", "ATTACHMENT_NAME", "POSITION", "PRODUCT_CODE") == [
        ("V", ["a@example.test", "b@example.test"], "Company", "Company", "0000000012",
         "Company_Vendor_0000000012 03-01-2024.pdf", 0, "P")
    ]


def test_order_sheet_rows_and_offsets(spark):
    blocks = [
        ("a", "1", "B", "P1", "one", ["S", "M"], ["red"], [[1, 0]], 1),
        ("a", "2", "B", "P2", "two", ["S"], ["red", "blue"], [[2], [3]], 5),
        ("a", "3", "B", "P3", "three", ["S"], [], [], 0),
        ("b", "2", "C", "P4", "four", ["S"], ["x", "y", "z"], [[1], [1], [1]], 3),
    ]
    lines = spark.createDataFrame([
        (*b[:5], b[5], i, len(b[6]), color, quantities, b[8])
        for b in blocks for i, (color, quantities) in enumerate(zip(b[6], b[7]) if b[6] else [(None, None)])
    ], "BATCH_ID string, BLOCK_KEY string, BRAND_NAME string, PRODUCT_CODE string, PRODUCT_TITLE string, SIZES array<string>, "
       "COLOR_NO int, COLORS int, COLOR string, QTYS array<int>, TOTAL_QTY bigint")
    cells = purchasing.order_sheet_cells(lines, NOW).collect()
    assert {(r.BOOK, r.SHEET_TITLE) for r in cells} == {("a", "1st 12:34:56"), ("b", "1st 12:34:56")}
    rows = {(r.BATCH_ID, r.ROW_NO): r.CELLS for r in cells}
    assert rows == {
        ("a", 1): ["VENDOR", "ITEM", "NAME", "COLOR", "S", "M", "TOTAL QTY"],
        ("a", 2): ["B", "P1", "one", "red", "1", "", "1"],
        ("a", 4): ["VENDOR", "ITEM", "NAME", "COLOR", "S", "TOTAL QTY"],
        ("a", 5): ["B", "P2", "two", "red", "2", "5"],
        ("a", 6): ["", "", "", "blue", "3", ""],
        ("a", 8): ["VENDOR", "ITEM", "NAME", "COLOR", "S", "TOTAL QTY"],
        ("a", 9): ["B", "P3", "three", "", "", "0"],
        ("b", 1): ["VENDOR", "ITEM", "NAME", "COLOR", "S", "TOTAL QTY"],
        ("b", 2): ["C", "P4", "four", "x", "1", "3"],
        ("b", 3): ["", "", "", "y", "1", ""],
        ("b", 4): ["", "", "", "z", "1", ""],
    }


def test_sheet_title(spark):
    assert values(spark, dates.sheet_title, ["20240102030405", "20240121030405", "20240111235959"]) == [
        "2nd 03:04:05", "21th 03:04:05", "11th 23:59:59"
    ]


def label_shop(shop, count):
    skus = [f"P-{i:02d}" for i in range(count)]
    return shop(
        inventory=[stock(s, PRODUCT_COLOR="x_dark  NAVY", PRODUCT_SIZE="M") for s in skus] + [stock("Pnodash", PRODUCT_SIZE="M")],
        images=[{"IMAGE_ID": i, "SKU": s, "IMAGE_PATH": f"{s}-{i}"} for s in skus for i in (2, 1)],
    )


def test_label_pages(shop, got):
    for count in (0, 1, 4, 5, 9):
        pages = labels.label_pages(label_shop(shop, count), "P")
        assert got(pages, "STD_SKU", "PAGE", "SLOT") == [(f"P-{i:02d}", i // 4, i % 4) for i in range(count)]
    assert got(labels.label_pages(label_shop(shop, 1), "P"), "COLOR", "IMAGE_PATH") == [(" Dark  Navy", "P-00-1")]


def test_label_split(shop, got):
    t = shop(
        inventory=[stock("P-1", PRODUCT_COLOR="a_", PRODUCT_SIZE="M"), stock("P-2", PRODUCT_COLOR="red", SIZE_CODE="1"),
                   stock("P-3", PRODUCT_COLOR="red", PRODUCT_SIZE="M"), stock("Q-1", PRODUCT_COLOR="red", PRODUCT_SIZE="M")],
        images=[{"IMAGE_ID": 1, "SKU": s, "IMAGE_PATH": "i"} for s in ("P-1", "P-2", "Q-1")],
        sizes=[{"SIZE_CODE": "1", "SIZE_NAME": "Size"}],
    )
    printable, rejects = labels.label_split(t, "P")
    assert got(printable, "STD_SKU", "SIZE") == [("P-2", "Size")]
    assert got(rejects, "PRODUCT_CODE", "STD_SKU", "IMAGE_URL") == [("P", "P-1", "i"), ("P", "P-3", None)]
    assert got(labels.label_rows(t, "_-1"), "STD_SKU") == [("P-1",), ("Q-1",)]


def test_image_pivot(shop, got):
    t = shop(
        inventory=[stock("A"), stock("B", valid="N"), stock("C"), stock("D"), stock("D")],
        images=[{"IMAGE_ID": i, "SKU": s, "IMAGE_PATH": f"{s}{i:02d}"} for s, n in (("A", 12), ("B", 1), ("C", 1), ("D", 7)) for i in range(n)],
    )
    rows = {r[0]: list(r)[1:] for r in jobs.image_pivot(t).collect()}
    assert rows["A"] == [f"A{i:02d}" for i in range(10)]
    assert rows["C"] == ["C00"] + [""] * 9
    assert rows["D"] == [f"D{i // 2:02d}" for i in range(10)]  # two inventory rows show every image twice
    assert set(rows) == {"A", "C", "D"}


def test_harvest(make, got):
    grids = make(SHEET_GRID, [
        {"SHEET_ID": "1", "CELLS": ["a-b-c", "a-b", None, "a-b-c-d"]}, {"SHEET_ID": "1", "CELLS": ["a-b-c", "--"]},
        {"SHEET_ID": "2", "CELLS": ["a-b-c"]},
    ])
    assert got(jobs.harvest_skus(grids)) == [("1", "--"), ("1", "a-b-c"), ("2", "a-b-c")]


def test_punches(shop, make, got):
    t = shop(users=[{"EMPLOYEE_ID": "1"}])
    feed = make(PUNCH, [
        {"EMPLOYEE_ID": e, "PUNCH_DTTM": p} for e, p in (
            ("1", "20240118235959"), ("1", "20240119000000"), ("1", "20240104120000"), ("1", "2024010412000"), ("2", "20240104120000"),
            ("1", None), ("1", "20241399000000"),
        )
    ])
    accepted, rejects = punches.punches_valid(t, feed)
    assert accepted.count() == 4
    assert got(rejects, "EMPLOYEE_ID", "STATUS") == [
        ("1", punches.BAD_TIME[1]), ("1", punches.BAD_TIME[1]), ("2", employees.UNKNOWN_ID[1])
    ]
    periods = punches.with_pay_period(accepted, "2024-01-05", 9)
    assert got(periods, "PUNCH_TIME", "PERIOD_LABEL") == [
        ("2024-01-04 12:00:00", "08 [12/22 - 01/04] Employee Clock In Table"),
        ("2024-01-18 23:59:59", "09 [01/05 - 01/18] Employee Clock In Table"),
        ("2024-01-19 00:00:00", "10 [01/19 - 02/01] Employee Clock In Table"),
        ("2024-13-99 00:00:00", None),
    ]


def test_screen_date(spark):
    assert values(spark, dates.screen_date, ["20240305", "20241399", None]) == ["Mar 05, 2024", "undefined 99, 2024", None]


def test_market_meta(shop, got):
    assert got(orders.market_meta(shop(markets=[MARKET]), unknown=True), "MARKET_ID", "MARKETPLACE_NM") == [
        (1, "Brand Channel"), (99, "Unknown")
    ]


def test_next_period_of_a_title(spark):
    titles = [("07 [01/05 - 01/18] Employee Clock In Table", 2024), ("99 [12/20 - 12/31] Employee Clock In Table", 2023), ("no days", 2024), (None, 2024)]
    frame = spark.createDataFrame(titles, "t string, y int").select(punches.next_period(F.col("t"), F.col("y")).alias("n"))
    assert [r.n and (str(r.n.PERIOD_FROM), r.n.PERIOD_LABEL) for r in frame.collect()] == [
        ("2024-01-19", "08 [01/19 - 02/01] Employee Clock In Table"), ("2024-01-01", "00 [01/01 - 01/14] Employee Clock In Table"), None, None
    ]


def test_repeated_manufacturing_keys(shop, got):
    key = {"PRODUCT_CODE": "P", "STD_SKU": "s"}
    t = shop(manufacturing_map=[key, key, {"PRODUCT_CODE": "P", "STD_SKU": "t"}])
    assert got(catalog.repeated_manufacturing_keys(t)) == [("P", "s", 2)]

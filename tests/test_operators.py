"""Operators against brute force, and results that stay whole when one key is hot."""

import random
from collections import defaultdict

import pytest
from tests.conftest import SAMPLE
from pyspark.sql import functions as F

from tallyhouse.operators.keyed import apply_changes, first_per_key, restrict, single_match
from tallyhouse.operators.ordering import running_total, sorted_page
from tallyhouse.plans import catalog, labels, orders, packing, purchasing, sales
from tallyhouse.sample.tables import tables

ITEM_SCHEMA = "k string, v int, w string"


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_running_total_equals_brute_force(spark, ranges):
    """Null groups, repeated keys told apart by a second column, and a hot group."""
    rng = random.Random(ranges)
    rows = [(rng.choice(["hot"] * 5 + [None, "a", "b"]), rng.choice([None, "x", "y", "z"]), i, rng.randrange(9)) for i in range(600)]
    frame = spark.createDataFrame(rows, "g string, k string, i int, n int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    result = {r.i: r.before for r in running_total(frame, ["g"], ["k", "i"], F.col("n"), "before").collect()}
    spark.conf.set("spark.sql.shuffle.partitions", before)
    totals, expected = defaultdict(int), {}
    for g, k, i, n in sorted(rows, key=lambda r: (r[0] or "", r[1] or "", r[2])):
        expected[i] = totals[g]
        totals[g] += n
    assert result == expected


def test_running_total_of_one_group_and_of_nothing(spark):
    frame = spark.range(200).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("k"))
    assert [r.pos for r in running_total(frame, [], ["k"], F.lit(1), "pos").orderBy("k").collect()] == list(range(200))
    assert running_total(frame.filter("k < ''"), [], ["k"], F.lit(1), "pos").isEmpty()


def test_running_total_spreads_one_hot_group(spark):
    frame = spark.range(20_000).select(F.lit("hot").alias("g"), F.lpad(F.col("id").cast("string"), 6, "0").alias("k"))
    placed = running_total(frame, ["g"], ["k"], F.lit(1), "pos")
    shuffles = placed._jdf.queryExecution().analyzed().toString()
    assert "_range" in shuffles
    sizes = [r["count"] for r in frame.repartitionByRange(4, "g", "k").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * 20_000 / 4


def test_sorted_page(spark):
    rows = [(i % 4, i) for i in range(40)]
    frame = spark.createDataFrame(rows, "c int, id int")
    for direction in ("asc", "desc"):
        expected = sorted(rows, key=lambda r: (r[0] if direction == "asc" else -r[0], r[1]))
        pages = [tuple(r) for p in range(9) for r in sorted_page(frame, "c", direction, p, 5, ["id"]).collect()]
        assert pages == expected
    with pytest.raises(ValueError):
        sorted_page(frame, "c", "up")


def test_first_single_restrict(spark, got):
    frame = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], ITEM_SCHEMA)
    assert got(first_per_key(frame, ["k"], [F.col("v")])) == [("a", 1, "y"), ("b", 5, "z")]
    assert got(single_match(frame, ["k"])) == [("b", 5, "z")]
    wanted = spark.createDataFrame([("a",), ("a",), (None,)], "x string")
    assert got(restrict(frame, "k", wanted), "v") == [(1,), (2,)]
    assert got(restrict(frame, "k", "b"), "v") == [(5,)]
    assert restrict(frame, "k", None) is frame


def test_apply_changes_takes_the_latest(spark, got):
    base = spark.createDataFrame([("a", 1, "old"), ("b", 1, "old")], ITEM_SCHEMA)
    changes = spark.createDataFrame([("a", "one", 1), ("a", None, 3), ("a", "two", 2), ("c", "new", 9)], "k string, w string, seq int")
    assert got(apply_changes(base, changes, ["k"], ["w"], "seq")) == [("a", 1, None), ("b", 1, "old")]


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """Stored sample tables in which one listing SKU, or one order, has a third of all items."""
    root = tmp_path_factory.mktemp("hot")
    t = tables(spark, SAMPLE)
    t.orders.write.parquet(f"{root}/orders")
    stored = spark.read.parquet(f"{root}/orders")
    order = stored.orderBy("CHANNEL_ORDER_NO").select("CHANNEL_ORDER_NO", "MARKET_ID").first()
    third = t.order_items.unionByName(t.order_items).withColumn("UNIT_QTY", F.lit(1))
    sku = t.listings.filter("VALID_YN = 'Y'").agg(F.min("LISTING_SKU")).first()[0]
    cases = {
        "sku": third.filter("MARKET_ID = 1").withColumn("LISTING_SKU", F.lit(sku)).withColumn("UNIT_QTY", F.explode(F.sequence(F.lit(1), F.lit(8)))),
        "order": third.withColumn("CHANNEL_ORDER_NO", F.lit(order[0])).withColumn("MARKET_ID", F.lit(order[1])),
    }
    bundles = {}
    for name, extra in cases.items():
        t.order_items.unionByName(extra).repartition(16).write.parquet(f"{root}/{name}")
        bundles[name] = t.with_tables(orders=stored, order_items=spark.read.parquet(f"{root}/{name}"))
    return bundles


@pytest.fixture
def shuffled_joins(spark):
    """No broadcasts and skew limits low enough for the sample."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def final_plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


SPLIT = {
    "sku": [
        ("LISTING_SKU", lambda t: packing.packing_status(t)),
        ("LISTING_SKU", lambda t: orders.order_document_lines(t)),
    ],
    "order": [
        ("CHANNEL_ORDER_NO", lambda t: packing.packing_status(t)),
        ("CHANNEL_ORDER_NO", lambda t: sales.sales_by_sku_long(t)),
        ("CHANNEL_ORDER_NO", lambda t: orders.order_document_lines(t)),
        ("CHANNEL_ORDER_NO", lambda t: packing.no_item_tag_change_counts(t)),
    ],
}


@pytest.mark.parametrize("case, i", [(c, i) for c, plans in SPLIT.items() for i in range(len(plans))])
def test_hot_join_key_is_split(hot, shuffled_joins, case, i):
    column, plan = SPLIT[case][i]
    frame = plan(hot[case])
    assert frame.collect()
    assert any("SortMergeJoin(skew=true)" in line and column in line for line in final_plan(frame).splitlines())


def test_hot_order_document_is_whole(hot):
    """A third of all items in one order: counted copies, one row per different item, no item lost."""
    t = hot["order"]
    rows = orders.order_document(t)
    assert rows.agg(F.sum("COPIES")).first()[0] == t.order_items.count()
    flat = orders.order_document_lines(t)
    again = rows.filter("COPIES > 0").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("COPIES").cast("int"))))
    assert flat.filter("LISTING_SKU is not null").count() == again.count()


@pytest.fixture(scope="module")
def hot_purchases(spark, tmp_path_factory):
    """Stored purchase-order lines in which a third have one SKU, or no vendor and no brand."""
    root = tmp_path_factory.mktemp("purchases")
    t = tables(spark, SAMPLE)
    sku = t.product_orders.join(t.inventory.join(t.sizes, "SIZE_CODE").select("STD_SKU"), "STD_SKU", "left_semi").select("STD_SKU", "PRODUCT_CODE").first()
    cases = {
        "sku": t.product_orders.withColumn("STD_SKU", F.lit(sku[0])).withColumn("PRODUCT_CODE", F.lit(sku[1])),
        "codes": t.product_orders.withColumn("VENDOR_CODE", F.lit(None).cast("string")),
    }
    bundles = {}
    for name, extra in cases.items():
        many = extra.withColumn("ORDER_QTY", F.explode(F.sequence(F.lit(1), F.lit(8))))
        t.product_orders.unionByName(many).repartition(16).write.parquet(f"{root}/{name}")
        bundles[name] = t.with_tables(product_orders=spark.read.parquet(f"{root}/{name}"))
    return bundles


@pytest.mark.parametrize("case", ["sku", "codes"])
def test_hot_purchase_order_lines_are_whole(hot_purchases, shuffled_joins, case):
    t = hot_purchases[case]
    known = t.inventory.join(t.sizes, "SIZE_CODE").select("STD_SKU")
    lines = t.product_orders.join(t.products, "PRODUCT_CODE", "left_semi").join(known, "STD_SKU")
    total = lines.agg(F.sum("ORDER_QTY")).first()[0]
    nested = purchasing.order_detail_nested(t)
    assert nested.filter("COLOR_NO = 0").agg(F.sum("TOTAL_QTY")).first()[0] == total
    dated = t.product_orders.join(t.products, "PRODUCT_CODE", "left_semi").filter("ORDER_DATE is not null")
    assert purchasing.order_history(t).agg(F.sum("TOTAL_QTY")).first()[0] == dated.agg(F.sum("ORDER_QTY")).first()[0]


def test_a_hot_sku_of_purchase_orders_is_split(hot_purchases, shuffled_joins):
    frame = purchasing.order_detail_rows(hot_purchases["sku"])
    assert frame.collect()
    assert any("SortMergeJoin(skew=true)" in line and "STD_SKU" in line for line in final_plan(frame).splitlines())


def test_colors_of_a_large_set_equal_brute_force(spark):
    """A set with very many colours: the same rows and order as a plain grouping of its lines."""
    t = tables(spark, SAMPLE)
    lines = [(i % 700, i % 3, i) for i in range(2_100)]
    sku = lambda c, z: f"K{c:04d}-{z}"
    stock = spark.createDataFrame([(sku(c, z), f"x_col{c % 350}", str(z + 1)) for c, z, _ in lines], "STD_SKU string, PRODUCT_COLOR string, SIZE_CODE string").distinct()
    inventory = t.inventory.limit(0).unionByName(stock, allowMissingColumns=True)
    bought = spark.createDataFrame([("20240101", 1, sku(c, z), "P", q) for c, z, q in lines], "ORDER_DATE string, ORDER_SEQ long, STD_SKU string, PRODUCT_CODE string, ORDER_QTY int")
    product = t.products.limit(1).withColumn("PRODUCT_CODE", F.lit("P"))
    big = t.with_tables(inventory=inventory, products=product, product_orders=t.product_orders.limit(0).unionByName(bought, allowMissingColumns=True))
    expected = {}
    for c, z, q in lines:
        own = expected.setdefault(f"col{c % 350}", [sku(c, z), {}])
        own[0] = min(own[0], sku(c, z))
        own[1][str(z + 1)] = max(own[1].get(str(z + 1), ("", 0)), (sku(c, z), q))
    rows = purchasing.order_detail_nested(big).orderBy("COLOR_NO").collect()
    assert [r.PRODUCT_COLOR for r in rows] == sorted(expected, key=lambda c: (expected[c][0], c)) and [r.COLOR_NO for r in rows] == list(range(350))
    known = {r[0] for r in t.sizes.select("SIZE_CODE").collect()}
    assert all({s: v.ORDER_QTY for s, v in r.SIZES.items()} == {s: q for s, (_, q) in expected[r.PRODUCT_COLOR][1].items() if s in known} for r in rows)


def test_properties(spark):
    """Totals agree between coarse and fine reports."""
    t = tables(spark, SAMPLE)
    long, wide = sales.sales_by_sku_long(t), sales.sales_by_sku_wide(t)
    assert long.agg(F.sum("ORDER_QTY")).first()[0] == wide.agg(F.sum("TOTAL_ORDER_CNT")).first()[0]
    split = labels.label_split(t, "P")
    assert split.printable.count() + split.rejects.count() == labels.label_rows(t, "P").count()
    listed = long.groupBy("LISTING_SKU", "MARKET_ID").agg(F.count_distinct("INVENTORY_YN").alias("n"))
    assert listed.filter("n > 1").isEmpty()


def test_a_list_of_vendors_and_products_is_made_in_order(shop, got):
    """The result, far larger than both sides, is not shuffled: the last shuffle stands below the join. Null and repeated vendors, repeated links."""
    vendors = [None, "V1", *[f"V{i:02d}" for i in range(30)]]
    links = [{"VENDOR_CODE": v, "BRAND_CODE": b} for i, v in enumerate(vendors) for b in (["A", "B"] if i % 2 else ["B"])] * 2
    t = shop(
        vendor_map=links, products=[{"PRODUCT_CODE": f"P{i:03d}", "BRAND_CODE": "AB"[i % 2]} for i in range(40)],
        product_map=[{"PRODUCT_CODE": f"P{i:03d}", "STD_SKU": "s"} for i in range(36)],
        manufacturing_map=[{"PRODUCT_CODE": "P002", "STD_SKU": "s", "MANUFACTURING_CODE": m} for m in ("M1", "M2")],
    )
    found = catalog.vendor_product_list(t)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and plan.index("Sort [VENDOR_CODE") < plan.index("Join") < plan.index("Exchange")
    rows = [(r.VENDOR_CODE or "", r.PRODUCT_CODE, r.MANUFACTURING_CODE) for r in found.collect()]
    codes = lambda i: ["M1", "M2"] if i == 2 else [""]
    expected = [(link["VENDOR_CODE"] or "", f"P{i:03d}", m) for link in links for i in range(36) if "AB"[i % 2] == link["BRAND_CODE"] for m in codes(i)]
    assert [r[:2] for r in rows] == sorted(r[:2] for r in expected) and sorted(rows) == sorted(expected)
    assert catalog.vendor_product_list(t, "none").isEmpty()

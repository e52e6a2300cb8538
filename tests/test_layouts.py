"""Stored layouts: look-ups that read few row groups, joins without a shuffle, updates of the touched months, pages of a stored order."""

import os
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from tests.conftest import SAMPLE

from tallyhouse.operators import ordering
from tallyhouse.operators.keyed import looked_up
from tallyhouse.plans import orders, packing, sales
from tallyhouse.plans.orders import ORDER_KEY
from tallyhouse.sample import feeds
from tallyhouse.sample.tables import tables
from tallyhouse.schemas import TABLES
from tallyhouse.sources import layouts
from tallyhouse.sources.storage import stored_meanwhile
from tallyhouse.sources.tables import Tables
from tests.test_traps import item, order

NOW = "20240301123456"
NUMBERS = [str(i) for i in range(3, 5000, 100)]


def read(frame, metric="numOutputRows"):
    """What the file scans of a collected frame read: rows after whole row groups and pages were left out, or files."""
    plan = frame._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().get(metric).get().value() for i in range(leaves.size()) if "Scan" in leaves.apply(i).getClass().getSimpleName())


@pytest.fixture(scope="module")
def for_lookups(spark, tmp_path_factory):
    """The sample laid out in many small row groups."""
    root = str(tmp_path_factory.mktemp("lookups"))
    layouts.store_for_lookups(tables(spark, SAMPLE), root, group_bytes=4096)
    return Tables(lambda name: spark.read.parquet(f"{root}/{name}"))


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """Orders and items of the next larger sample, in row groups of some hundred rows."""
    t, root = tables(spark, SAMPLE.replace("0.001", "0.01")), tmp_path_factory.mktemp("large")
    for name in ("orders", "order_items"):
        layouts.write_for_lookups(getattr(t, name), f"{root}/{name}", layouts.LOOKUP_KEYS[name], group_bytes=4096)
    return Tables(lambda name: spark.read.parquet(f"{root}/{name}"))


@pytest.mark.parametrize("table, column, part", [("orders", "TRACKING_NO", 10), ("orders", "CHANNEL_ORDER_NO", 10), ("order_items", "CHANNEL_ORDER_NO", 10), ("order_items", "LISTING_SKU", 2)])
def test_ten_keys_read_a_small_part(spark, large, got, table, column, part):
    """Ten keys lie in ten row groups; items of ten SKUs lie in more of them, which are sorted by order."""
    whole = getattr(large, table)
    keys = whole.select(column).distinct().orderBy(F.xxhash64(column)).limit(10)
    found = looked_up(whole, keys, [column])
    found.collect()
    assert read(found) < whole.count() / part
    assert got(found) == got(whole.join(keys, column, "left_semi").select(*whole.columns))


def test_bloom_filters_leave_out_what_bounds_cannot(spark, for_lookups):
    """A number between all stored ones, that no order has: only the bloom filters know."""
    whole = for_lookups.orders
    missing = whole.filter(F.col("CHANNEL_ORDER_NO") == "100x")
    missing.collect()
    bounds = whole.agg(F.min("CHANNEL_ORDER_NO"), F.max("CHANNEL_ORDER_NO")).first()
    assert bounds[0] < "100x" < bounds[1] and read(missing) == 0


@pytest.mark.parametrize("most", [0, 3, 200])
def test_looked_up_equals_a_semi_join(spark, got, most):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 1), ("c", None), ("d", 4)], "k string, n int")
    for keys in ([("a", 1), ("b", 2), ("d", 4), (None, 1), ("c", None), ("a", 1)], [("x", 9)], []):
        wanted = spark.createDataFrame(keys, "k string, n long")
        expected = {(k, n) for k, n in keys if k is not None and n is not None}
        assert got(looked_up(rows, wanted, ["k", "n"], most)) == sorted(r for r in got(rows) if r in expected)


def test_scanned_documents_equal_the_plan_over_whole_tables(spark, for_lookups, got):
    scans = spark.createDataFrame([(n,) for n in NUMBERS + ["no such number", None]], "t string")
    found, expected = orders.scanned_documents(for_lookups, scans), orders.order_document(for_lookups, scans)
    assert len(got(found)) > 20 and got(found) == got(expected)


def test_scans_are_computed_for_the_look_up_only(spark, for_lookups, got):
    """The document is made of the looked-up orders; it does not compute the scans once more for each of its parts."""
    scans = spark.range(3, 5000, 100).select(F.col("id").cast("string").alias("t"))
    found = orders.scanned_documents(for_lookups, scans)
    assert "Range (" not in found._jdf.queryExecution().executedPlan().toString()
    assert got(found) == got(orders.order_document(for_lookups, scans))


@pytest.fixture(scope="module")
def bucketed(spark, tmp_path_factory):
    """The sample in four buckets; orders with more than six items are stored apart."""
    t = tables(spark, SAMPLE)
    hot = t.order_items.unionByName(t.order_items.filter("CHANNEL_ORDER_NO = '3'").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(400)))).drop("n"))
    empty = t.order_items.limit(2).withColumn("CHANNEL_ORDER_NO", F.lit(None).cast("string"))
    t = t.with_tables(order_items=hot.unionByName(empty))
    buckets = layouts.Buckets(str(tmp_path_factory.mktemp("buckets")), 4, "in_buckets")
    layouts.store_bucketed(t, buckets, hot=6)
    return t, buckets, layouts.open_bucketed(spark, buckets)


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def order_shuffles(frame):
    return re.findall(r"Exchange hashpartitioning\(CHANNEL_ORDER_NO#\d+, MARKET_ID#\d+", frame._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("plan", [sales.sales_by_sku_long, packing.packing_status, packing.no_item_tag_change_counts])
def test_orders_meet_items_without_a_shuffle(spark, bucketed, no_broadcast, got, plan):
    t, _, stored = bucketed
    regular = Tables(lambda name: getattr(stored, name), item_parts=stored.item_parts()[:1])
    assert not order_shuffles(plan(regular)) and len(order_shuffles(plan(t))) == 2
    assert got(plan(stored)) == got(plan(t))


def test_without_hot_orders_there_is_one_part(spark, tmp_path, no_broadcast, got):
    t, buckets = tables(spark, SAMPLE), layouts.Buckets(f"{tmp_path}/b", 2, "none_apart")
    layouts.store_bucketed(t, buckets)
    stored = layouts.open_bucketed(spark, buckets)
    assert len(stored.item_parts()) == 1 and not order_shuffles(sales.sales_by_sku_long(stored))
    assert got(stored.order_items, *t.order_items.columns) == got(t.order_items)


def test_hot_orders_lie_apart_and_nothing_is_lost(spark, bucketed, got):
    t, buckets, stored = bucketed
    regular, apart = stored.item_parts()
    sizes = regular.groupBy(*ORDER_KEY).count().agg(F.max("count")).first()[0]
    assert sizes <= 6 and apart.filter("CHANNEL_ORDER_NO = '3'").count() > 400 and apart.filter("CHANNEL_ORDER_NO is null").count() == 2
    assert got(stored.order_items, *t.order_items.columns) == got(t.order_items) and got(stored.orders, *t.orders.columns) == got(t.orders)


def test_a_hot_order_is_split(spark, bucketed, got):
    """The items stored apart are joined by a shuffle, which Spark splits at run time."""
    t, _, stored = bucketed
    hot = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
           "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in hot}
    for k, v in hot.items():
        spark.conf.set(k, v)
    regular, apart = stored.item_parts()
    apart = Tables(lambda name: getattr(stored, name), item_parts=[regular.limit(0), apart.repartition(8)])  # as from many files
    joined = orders.items_of_orders(apart, [*ORDER_KEY, "LISTING_SKU"], stored.orders.select(*ORDER_KEY, "ORDER_DATE"))
    count = len(joined.collect())
    text = joined._jdf.queryExecution().executedPlan().toString()
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "skew=true" in text and count == apart.item_parts()[1].filter("CHANNEL_ORDER_NO is not null").count()


def test_buckets_open_in_a_new_catalog(spark, bucketed, got):
    t, buckets, stored = bucketed
    ddl = {which: ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in getattr(stored, which).schema) for which in layouts.BUCKETED}
    other = layouts.Buckets(buckets.root, buckets.count, "attached")
    layouts.attach_bucketed(spark, other, ddl)
    again = layouts.open_bucketed(spark, other)
    assert got(sales.sales_by_sku_long(again)) == got(sales.sales_by_sku_long(t))


def files(root):
    return {str(f.relative_to(root)): os.stat(f).st_mtime_ns for f in Path(root).rglob("*.parquet")}


def test_only_touched_months_are_rewritten(spark, tmp_path, got):
    t = tables(spark, SAMPLE)
    layouts.store_by_month(t, str(tmp_path))
    day = t.orders.filter("ORDER_DATE is not null").agg(F.max("ORDER_DATE")).first()[0]
    few = t.orders.filter(F.substring("ORDER_DATE", 1, 6) == day[:6]).select("CHANNEL_ORDER_NO")
    requests = feeds.packing_requests(spark, SAMPLE).join(few, "CHANNEL_ORDER_NO", "left_semi").withColumn("COMPLETE_YN", F.lit("Y"))
    changes, expected = packing.packing_update(requests, NOW), packing.apply_packing(t, requests, NOW)
    before = files(tmp_path)
    for name, rows, keys, columns in (("orders", changes.order_changes, ORDER_KEY, packing.STATUS_COLUMNS), ("order_items", changes.item_changes, packing.ITEM_KEY, packing.FLAG_COLUMNS)):
        done = layouts.update_months(spark, f"{tmp_path}/{name}", rows, keys, columns, "REQUEST_SEQ")
        assert done.rows > 0 and done.partitions == [day[:6]]
        after = files(tmp_path)
        assert all(after[f] == m for f, m in before.items() if not f.startswith(f"{name}/ORDER_MONTH={day[:6]}")) and after != before
        again = layouts.update_months(spark, f"{tmp_path}/{name}", rows, keys, columns, "REQUEST_SEQ")
        assert again == ([], 0) and files(tmp_path) == after
        assert got(layouts.read_months(spark, f"{tmp_path}/{name}"), *TABLES[name].fieldNames()) == got(getattr(expected, name), *TABLES[name].fieldNames())
        before = after


def test_items_without_an_order_have_no_month_and_are_updated_too(spark, tmp_path, got):
    columns = "CHANNEL_ORDER_NO string, MARKET_ID int, ORDER_DATE string, v string"
    t = Tables(lambda name: None, orders=spark.createDataFrame([("1", 1, "20240101", "a"), ("2", 1, None, "b")], columns),
               order_items=spark.createDataFrame([("1", 1, "a"), ("2", 1, "b"), ("9", 9, "c")], "CHANNEL_ORDER_NO string, MARKET_ID int, v string"))
    layouts.store_by_month(t, str(tmp_path))
    changes = spark.createDataFrame([("9", 9, "C", 1), ("1", 1, "a", 1), ("2", 1, "B", 2), ("2", 1, "x", 1), ("8", 1, "n", 1)], "CHANNEL_ORDER_NO string, MARKET_ID int, v string, n int")
    for name, rows in (("orders", 1), ("order_items", 2)):
        assert layouts.update_months(spark, f"{tmp_path}/{name}", changes, ORDER_KEY, ["v"], "n") == ([None], rows)
    assert got(layouts.read_months(spark, f"{tmp_path}/order_items"), "v", "ORDER_MONTH") == [("B", None), ("C", None), ("a", "202401")]


@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_stored_pages(spark, tmp_path, direction):
    rows = [(None if i % 7 == 0 else i % 5, i, f"v{i}") for i in range(230)]
    frame = spark.createDataFrame(rows, "c int, id int, v string").repartition(3)
    ordering.store_order(frame, str(tmp_path), "c", direction, ["id"], ranges=9)
    low = (lambda c: -1 if c is None else c) if direction == "asc" else (lambda c: 99 if c is None else -c)
    expected = sorted(rows, key=lambda r: (low(r[0]), r[1]))
    for page, size in ((0, 25), (2, 25), (9, 25), (45, 5), (46, 5), (0, 500)):
        found = ordering.stored_page(spark, str(tmp_path), frame.schema, page, size)
        assert [tuple(r) for r in found.collect()] == expected[page * size : (page + 1) * size]
    assert len(list(Path(tmp_path / "rows").glob("_range=*"))) >= 5


def test_a_page_reads_the_ranges_it_meets(spark, tmp_path):
    frame = spark.range(4000).withColumn("k", F.lpad(F.col("id").cast("string"), 6, "0"))
    ordering.store_order(frame, str(tmp_path), "k", ranges=16)
    for page in (2, 100, 159):
        found = ordering.stored_page(spark, str(tmp_path), frame.schema, page, 25)
        assert [r.id for r in found.collect()] == list(range(page * 25, page * 25 + 25))
        assert read(found, "numFiles") <= 2


def test_deep_pages_equal_shallow_ones(spark, monkeypatch):
    frame = spark.createDataFrame([(i % 4, i) for i in range(60)], "c int, id int")
    shallow = [tuple(r) for r in ordering.sorted_page(frame, "c", "desc", 5, 5, ["id"]).collect()]
    monkeypatch.setattr(ordering, "SHALLOW", 10)
    assert [tuple(r) for r in ordering.sorted_page(frame, "c", "desc", 5, 5, ["id"]).collect()] == shallow and len(shallow) == 5


def counted(spark, rows, column):
    """The rows, and how many of them were computed so far."""
    seen = spark.sparkContext.accumulator(0)

    def same(value):
        seen.add(1)
        return value

    return rows.withColumn(column, F.udf(same, "string").asNondeterministic()(column)), seen


def test_items_are_computed_once_for_their_buckets(spark, make, shop, tmp_path):
    t = shop(orders=[order("1"), order("2")], order_items=[item("L", no="1"), item("M", no="1"), item("L", no="2"), item("L", no=None)])
    items, seen = counted(spark, t.order_items, "CHANNEL_ORDER_NO")
    buckets = layouts.Buckets(str(tmp_path / "b"), 2, f"once_{tmp_path.name}".replace("-", "_"))
    layouts.store_bucketed(t.with_tables(order_items=items), buckets, 1)
    assert layouts.open_bucketed(spark, buckets).order_items.count() == 4 and seen.value == 4


def test_changes_are_computed_once_for_an_update_of_months(spark, shop, got, tmp_path):
    t = shop(orders=[order("1"), order("2")])
    layouts.store_by_month(t, str(tmp_path))
    changes = spark.createDataFrame([(1, "1", 1, "02"), (2, "1", 1, "01"), (1, "9", 1, "01")], "REQUEST_SEQ long, CHANNEL_ORDER_NO string, MARKET_ID int, SHIPPING_STATUS string")
    changes, seen = counted(spark, changes, "SHIPPING_STATUS")
    done = layouts.update_months(spark, f"{tmp_path}/orders", changes, layouts.ORDER_KEY, ["SHIPPING_STATUS"], "REQUEST_SEQ")
    assert done.rows == 1 and seen.value == 3
    assert ("1", "01") in got(layouts.read_months(spark, f"{tmp_path}/orders"), "CHANNEL_ORDER_NO", "SHIPPING_STATUS")


def aside(spark):
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    return {p.name for p in folder.iterdir()} if folder.exists() else set()


def test_what_is_written_aside_is_deleted(spark, shop, got, tmp_path):
    """Items and marks of their orders, latest changes and new rows of months; a failed block keeps its folder."""
    before = aside(spark)
    t = shop(orders=[order("1"), order("2")], order_items=[item(s, no=n) for s in "LM" for n in ("1", None)] + [item("L", no="2")])
    buckets = layouts.Buckets(str(tmp_path / "b"), 2, f"aside_{tmp_path.name}".replace("-", "_"))
    layouts.store_bucketed(t, buckets, 1)
    regular, apart = layouts.open_bucketed(spark, buckets).item_parts()
    assert got(regular, "CHANNEL_ORDER_NO", "LISTING_SKU") == [("2", "L")]
    assert got(apart, "CHANNEL_ORDER_NO", "LISTING_SKU") == sorted([(n, s) for n in ("1", None) for s in "LM"], key=repr)
    layouts.store_by_month(t, f"{tmp_path}/m")
    changes = spark.createDataFrame([(1, "1", 1, "02")], "REQUEST_SEQ long, CHANNEL_ORDER_NO string, MARKET_ID int, SHIPPING_STATUS string")
    assert layouts.update_months(spark, f"{tmp_path}/m/orders", changes, layouts.ORDER_KEY, ["SHIPPING_STATUS"], "REQUEST_SEQ").rows == 1
    assert aside(spark) == before
    with pytest.raises(ValueError), stored_meanwhile(changes, "failed") as rows:
        raise ValueError
    assert len(aside(spark) - before) == 1 and rows.count() == 1

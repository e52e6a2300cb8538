"""Streams over files that arrive one by one, against the batch results; replays change nothing."""

import random

import pytest
from pyspark.sql import functions as F

from tallyhouse.plans import packing, punches
from tallyhouse.schemas import ORDER_LINE, PACKING_REQUEST, PUNCH
from tallyhouse.streaming import feeds
from tests.test_traps import MARKET, item, order, packing_request

NOW = "20240301123456"


@pytest.fixture
def arriving(spark, tmp_path, make):
    """A stream that reads one file per micro-batch, and the frame of all its rows."""

    def stream(schema, *batches):
        folder = f"{tmp_path}/feed"
        for rows in batches:
            make(schema, rows).coalesce(1).write.mode("append").json(folder)
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder), spark.read.schema(schema).json(folder)

    return stream


def test_packing_updates_and_replay(spark, shop, arriving, got, tmp_path):
    """The clock moves between the runs, the first batch has refusals only, and folding the log changes nothing."""
    t = shop(orders=[order("1"), order("2")], order_items=[item("L", no="1"), item("M", no="2")], markets=[MARKET])
    stream, batch = arriving(
        PACKING_REQUEST,
        [packing_request(2, "2", "N")],
        [packing_request(1, "1", "Y", items=[("L", 1, "Y", "N")])],
        [packing_request(3, "1", "N", "Y", items=[("L", 1, "N", "Y")])],
    )
    ticks = iter(range(100))
    results = []
    for run in ("first", "replay", "folded"):  # a lost checkpoint replays every batch into the same log
        if run == "folded":
            feeds.compact_log(spark, f"{tmp_path}/log")
            feeds.compact_log(spark, f"{tmp_path}/log")
        else:
            feeds.stream_packing_updates(stream, f"{tmp_path}/log", f"{tmp_path}/{run}", lambda: f"202403011234{next(ticks):02d}").awaitTermination()
        after, expected = feeds.packing_state(t, f"{tmp_path}/log"), packing.apply_packing(t, batch, NOW)
        assert got(after.orders.drop("PROC_TM")) == got(expected.orders.drop("PROC_TM"))
        assert got(after.order_items) == got(expected.order_items)
        assert got(spark.read.parquet(f"{tmp_path}/log/rejects"), "REQUEST_SEQ") == [(2,)]
        results.append(got(after.orders))
    assert results[0] == results[1] == results[2]
    assert got(after.orders, "CHANNEL_ORDER_NO", "SHIPPING_STATUS") == [("1", "02"), ("2", None)]


def test_a_batch_of_packing_requests_is_not_cached(spark, shop, arriving, got, tmp_path, monkeypatch):
    """Its requests lie on disk for the three outputs, and those of the batch before are replaced."""
    stream, _ = arriving(PACKING_REQUEST, *[[packing_request(n, str(n), "Y", items=[("L", 1, "Y", "N")])] for n in (1, 2)])
    monkeypatch.delattr(type(spark.range(1)), "persist")
    feeds.stream_packing_updates(stream, f"{tmp_path}/log", f"{tmp_path}/state", lambda: NOW).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/log/aside").count() == 1
    assert got(spark.read.parquet(f"{tmp_path}/log/order_items"), "REQUEST_SEQ") == [(1,), (2,)]


def test_a_log_of_refusals_only(spark, shop, arriving, got, tmp_path):
    t = shop(orders=[order("1")], order_items=[item("L", no="1")])
    stream, _ = arriving(PACKING_REQUEST, [packing_request(1, "1", "N")])
    feeds.stream_packing_updates(stream, f"{tmp_path}/log", f"{tmp_path}/state", lambda: NOW).awaitTermination()
    feeds.compact_log(spark, f"{tmp_path}/log")
    assert got(feeds.packing_state(t, f"{tmp_path}/log").orders) == got(t.orders)


def test_a_replay_without_rows_clears_its_batch(spark, tmp_path):
    feeds._put(spark.range(3), f"{tmp_path}/log", 4)
    feeds._put(spark.range(0), f"{tmp_path}/log", 4)
    assert feeds._recorded(spark, f"{tmp_path}/log", "id long").isEmpty()


def test_state_without_a_log_is_unchanged(shop, got, tmp_path):
    t = shop(orders=[order("1")])
    assert got(feeds.packing_state(t, f"{tmp_path}/none").orders, "CHANNEL_ORDER_NO") == [("1",)]


def test_packing_alerts(spark, shop, arriving, got, tmp_path):
    t = shop(markets=[MARKET])
    stream, batch = arriving(
        PACKING_REQUEST, [packing_request(1, "1", "Y", items=[("L", 1, "Y", "Y")])], [packing_request(2, "2", "N", "Y", items=[("M", 2, "Y", "N")])]
    )
    feeds.run_append(feeds.stream_packing_alerts(t, stream), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert got(spark.read.parquet(f"{tmp_path}/out"), "MESSAGE") == got(packing.packing_alerts(t, batch), "MESSAGE")


@pytest.mark.parametrize("dedupe, expected", [(False, 5), (True, 4)])
def test_punches(spark, shop, arriving, got, tmp_path, dedupe, expected):
    t = shop(users=[{"EMPLOYEE_ID": "1"}])
    punch = lambda stamp, who="1": {"EMPLOYEE_ID": who, "PUNCH_DTTM": stamp}
    stream, batch = arriving(
        PUNCH, [punch("20240105080000"), punch("20240105080000"), punch("20240105080000", "9")],
        [punch("20240118170000"), punch("20240119080000"), punch("bad")], [punch("20240105170000")],
    )
    rows = feeds.stream_punches(t, stream, "2024-01-05", 1, dedupe)
    feeds.run_append(rows, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == expected
    if not dedupe:
        assert got(out.drop("TS")) == got(punches.punch_pay_periods(t, batch, "2024-01-05", 1))


def test_punch_counts(spark, shop, arriving, got, tmp_path):
    t = shop(users=[{"EMPLOYEE_ID": "1"}])
    stream, _ = arriving(PUNCH, *[[{"EMPLOYEE_ID": "1", "PUNCH_DTTM": p}] for p in ("20240105080000", "20240118235959", "20240119000000")])
    counts = feeds.stream_punch_counts(feeds.stream_punches(t, stream, "2024-01-05"), "2024-01-05")
    for run in ("first", "replay"):
        feeds.run_punch_counts(counts, f"{tmp_path}/counts", f"{tmp_path}/{run}").awaitTermination()
        found = feeds.punch_counts(spark, f"{tmp_path}/counts").collect()
        assert {str(r.PERIOD_FROM): r.PUNCHES for r in found} == {"2024-01-05": 2, "2024-01-19": 1}


def test_purchase_orders_and_replay(spark, shop, arriving, got, tmp_path):
    t = shop(product_orders=[{"ORDER_DATE": "20240101", "ORDER_SEQ": 7}])
    line = lambda sku: {"ORDER_DATE": "20240201", "STD_SKU": sku, "ORDER_QTY": 1}
    stream, _ = arriving(ORDER_LINE, [line("a"), line("b")], [line("c")])
    for run in ("first", "replay"):
        feeds.stream_purchase_orders(
            t.product_orders, stream, f"{tmp_path}/placed", f"{tmp_path}/ledger", f"{tmp_path}/{run}"
        ).awaitTermination()
        placed = got(spark.read.parquet(f"{tmp_path}/placed"), "STD_SKU", "ORDER_SEQ")
        assert sorted(s for _, s in placed) in ([8, 8, 9], [8, 9, 9])
        assert len({s for sku, s in placed if sku in "ab"}) == 1 and [sku for sku, _ in placed] == ["a", "b", "c"]


def test_latest_changes_kept_by_the_stream(spark, shop, arriving, got, tmp_path):
    """Requests out of order across micro-batches, equal and missing numbers, a restart, and a start with a lost checkpoint."""
    t = shop(orders=[order("1"), order("2"), order("3")], order_items=[item("L", no="1"), item("M", no="2"), item("L", no="3")], markets=[MARKET])
    first = [packing_request(5, "1", "Y", items=[("L", 1, "Y", "N")]), packing_request(None, "2", "Y", items=[("M", 1, "Y", "Y")])]
    later = [packing_request(3, "1", "N", "Y", items=[("L", 1, "N", "Y")]), packing_request(1, "2", "N", "Y", items=[("M", 1, "N", "N")])]
    last = [packing_request(7, "3", "Y", items=[("L", 1, None, "Y")]), packing_request(7, "3", "N", "Y", items=[("L", 1, "Y", None)])]
    stream, _ = arriving(PACKING_REQUEST, first, later)
    start = lambda rows, state: feeds.run_latest_changes(feeds.stream_latest_changes(rows, F.lit(NOW)), f"{tmp_path}/latest", f"{tmp_path}/{state}").awaitTermination()
    start(stream, "state")
    stream, batch = arriving(PACKING_REQUEST, last)
    start(stream, "state")  # goes on where it stopped
    expected = packing.apply_packing(t, batch, NOW)
    for lost in (False, True):
        if lost:
            start(stream, "other")  # reads every file again
        after = feeds.current_state(t, f"{tmp_path}/latest")
        assert got(after.orders) == got(expected.orders) and got(after.order_items) == got(expected.order_items)
        rows = feeds.latest_changes(spark, f"{tmp_path}/latest")
        assert rows.count() == rows.select(*feeds._CHANGE_KEY).distinct().count() == 5  # items name their order, the first one by default
    assert got(after.orders, "CHANNEL_ORDER_NO", "SHIPPING_STATUS") == [("1", "01"), ("2", "02"), ("3", "02")]


def test_the_stream_reads_only_the_parts_it_changes(spark, arriving, tmp_path):
    stream, _ = arriving(PACKING_REQUEST, [packing_request(1, str(i), "Y") for i in range(40)])
    run = lambda s: feeds.run_latest_changes(feeds.stream_latest_changes(s, F.lit(NOW)), f"{tmp_path}/latest", f"{tmp_path}/state").awaitTermination()
    run(stream)
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "latest" / "current").rglob("*.parquet")}
    stream, _ = arriving(PACKING_REQUEST, [packing_request(2, "7", "Y")])
    run(stream)
    after = {f: f.stat().st_mtime_ns for f in (tmp_path / "latest" / "current").rglob("*.parquet")}
    assert len(before) > 20 and len(set(before.items()) - set(after.items())) == 1


@pytest.mark.parametrize("seed", range(2))
def test_late_punches_are_kept_and_folded_in(spark, shop, arriving, got, tmp_path, seed):
    """Punches of seven months in any order: what comes in time and what comes late are all punches."""
    rng = random.Random(seed)
    t = shop(users=[{"EMPLOYEE_ID": str(i)} for i in range(3)])
    stamp = lambda: f"2024{rng.randrange(1, 8):02d}{rng.randrange(1, 29):02d}{rng.randrange(24):02d}3000"
    batches = [[{"EMPLOYEE_ID": str(rng.randrange(4)), "PUNCH_DTTM": stamp()} for _ in range(60)] for _ in range(4)]
    stream, batch = arriving(PUNCH, *batches)
    timed = feeds.stream_punches(t, stream, "2024-01-05")
    for run in ("first", "replay"):
        feeds.run_counts_with_late(timed, f"{tmp_path}/out", f"{tmp_path}/{run}").awaitTermination()
        whole = punches.punch_pay_periods(t, batch, "2024-01-05", 1).groupBy("PERIOD_FROM", "EMPLOYEE_ID").agg(F.count("*").alias("PUNCHES"))
        late, in_time = feeds.late_punches(spark, f"{tmp_path}/out"), feeds.counts_in_time(spark, f"{tmp_path}/out")
        assert got(feeds.fold_late(spark, f"{tmp_path}/out")) == got(whole)
        assert late.count() > 10 and in_time.agg(F.sum("PUNCHES")).first()[0] > 30
        assert late.count() + in_time.agg(F.sum("PUNCHES")).first()[0] == whole.agg(F.sum("PUNCHES")).first()[0]


def test_punches_in_order_are_never_late(spark, shop, arriving, tmp_path):
    t = shop(users=[{"EMPLOYEE_ID": "1"}])
    days = ["20240105080000", "20240118235959", "20240119000000", "20240118120000", "20240301080000", "20240118120000"]
    stream, _ = arriving(PUNCH, *[[{"EMPLOYEE_ID": "1", "PUNCH_DTTM": d}] for d in days])
    feeds.run_counts_with_late(feeds.stream_punches(t, stream, "2024-01-05"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert [r.PUNCH_DTTM for r in feeds.late_punches(spark, f"{tmp_path}/out").collect()] == ["20240118120000"]  # the second one, after March began


def test_latest_changes_hold_no_state_but_the_table(spark, arriving, got, tmp_path):
    """A request without items, one with a missing item, and equal orders; the executors keep nothing between micro-batches."""
    empty, broken = packing_request(1, "1", "Y"), packing_request(2, "1", "N", "Y", items=[("L", 1, "Y", "N")])
    empty["ORDER_LIST"], broken["ORDER_LIST"] = None, [*broken["ORDER_LIST"], None]
    stream, _ = arriving(PACKING_REQUEST, [empty], [broken])
    query = feeds.run_latest_changes(feeds.stream_latest_changes(stream, F.lit(NOW)), f"{tmp_path}/latest", f"{tmp_path}/state")
    query.awaitTermination()
    assert query.lastProgress["stateOperators"] == []
    rows = feeds.latest_changes(spark, f"{tmp_path}/latest")
    assert got(rows, "KIND", "LISTING_SKU", "REQUEST_SEQ") == [("order_items", "L", 2), ("order_items", None, 2), ("orders", None, 2)]

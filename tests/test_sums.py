"""Sums that are kept up to date against sums taken anew."""

import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from tests.conftest import SAMPLE

from tallyhouse.plans import purchasing, sales
from tallyhouse.sample.tables import tables
from tallyhouse.sources import sums

KEYS = ["D", "K"]


def files(path):
    return {str(f.relative_to(path)): os.stat(f).st_mtime_ns for f in Path(path).rglob("*.parquet")}


def expected(rows):
    out = {}
    for d, k, v in rows:
        total, count = out.get((d, k), (None, 0))
        out[d, k] = (total if v is None else (total or 0) + v, count + 1)
    return sorted(((d, k, t, c) for (d, k), (t, c) in out.items()), key=repr)


@pytest.mark.parametrize("seed, grain", [(0, 8), (2, 6)])
def test_three_batches_equal_a_recomputation(spark, tmp_path, got, seed, grain):
    """Additions, withdrawals, a day that loses its last row, null days, keys and values; a batch applied twice changes nothing."""
    rng, kept = random.Random(seed), sums.Sums(str(tmp_path), KEYS, "V", "D", grain)
    schema = "D string, K string, V int"
    make = lambda n: [(rng.choice(["20240101", "20240102", "20240203", None]), rng.choice(["a", "b", None]), rng.choice([1, 5, -2, None])) for _ in range(n)]
    held = make(40) + [("20240909", "only", 3)]
    sums.store_sums(spark.createDataFrame(held, schema), kept)
    for batch in range(3):
        added, gone = make(5) + [(f"2024020{batch}", "new", 1)], rng.sample(held, 6)
        if batch == 1:
            gone = [r for r in held if r[0] == "20240909"]
        for r in gone:
            held.remove(r)
        held += added
        args = (spark, kept, batch, spark.createDataFrame(added, schema), spark.createDataFrame(gone, schema))
        before = files(f"{tmp_path}/sums")
        done = sums.apply_deltas(*args)
        touched = {r[0][:grain] if r[0] else "none" for r in added + gone}
        assert set(done.partitions) <= touched and done.rows > 0
        after = files(f"{tmp_path}/sums")
        assert all(after.get(f) == m for f, m in before.items() if f.split("/")[0].split("=")[1] not in touched)
        assert got(sums.read_sums(spark, kept, "T", "N"), "D", "K", "T", "N") == expected(held)
        assert sums.apply_deltas(*args) == ([], 0) and files(f"{tmp_path}/sums") == after


def test_reports_over_kept_sums(spark, tmp_path, got):
    """Sales and purchase history from sums of the first part of the rows and a batch with the rest, some of it withdrawn again."""
    t = tables(spark, SAMPLE)
    half = F.pmod(F.xxhash64("CHANNEL_ORDER_NO"), F.lit(2)) == 0
    first, rest = t.with_tables(orders=t.orders.filter(half)), t.with_tables(orders=t.orders.filter(~half))
    extra = sales.sold_items(rest).filter("UNIT_QTY > 30")
    kept = sums.Sums(f"{tmp_path}/sales", sales.SUM_KEY, "UNIT_QTY", "ORDER_DATE", 6)
    sums.store_sums(sales.sold_items(first).unionByName(extra), kept)
    sums.apply_deltas(spark, kept, 0, sales.sold_items(rest), extra)
    found = sums.read_sums(spark, kept, "ORDER_QTY", "ORDER_CNT")
    assert got(sales.sales_by_sku_long(t, sums=found)) == got(sales.sales_by_sku_long(t))
    assert got(sales.sales_by_sku_wide(t, "19950101", "19961231", sums=found)) == got(sales.sales_by_sku_wide(t, "19950101", "19961231"))


def test_sums_may_start_empty(spark, tmp_path, got):
    t, kept = tables(spark, SAMPLE), sums.Sums(str(tmp_path), purchasing.LINE_KEY, "ORDER_QTY", "ORDER_DATE", 4)
    lines = t.product_orders
    sums.store_sums(lines.limit(0), kept)
    assert sums.read_sums(spark, kept, "ORDER_QTY", "LINES").count() == 0
    sums.apply_deltas(spark, kept, 0, lines, lines.limit(0))
    summed = sums.read_sums(spark, kept, "ORDER_QTY", "LINES")
    assert got(purchasing.order_history(t.with_tables(product_orders=summed))) == got(purchasing.order_history(t))


def test_a_batch_is_grouped_in_one_shuffle(spark, got):
    kept = sums.Sums("unused", KEYS, "V", "D")
    rows = lambda *r: spark.createDataFrame(list(r), "D string, K string, V int")
    delta = kept.taken(rows(("20240101", "a", 5), ("20240101", "a", None), (None, "b", 2)), rows(("20240101", "a", 3)))
    assert delta._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert got(delta, "K", "_sum", "_filled", "_rows") == [("a", 2, 0, 1), ("b", 2, 1, 1)]

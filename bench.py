"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR is the data folder, BENCH_CPUS the number of cores. Each query runs end to end from
the driver's tables into a sink that reads every row; the best of the timed runs counts.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks.queries import QUERIES
from tallyhouse.plans import orders, packing, purchasing, sales
from tallyhouse.sample.tables import tables
from tallyhouse.session import session
from tallyhouse.sources import layouts
from tallyhouse.sources.tables import Tables

HEADLINE = [
    "sales_by_sku_long", "sales_by_sku_wide", "packing_status", "no_item_tag_change_counts", "order_history",
    "order_detail_nested", "order_document_lines", "update_order_status", "label_rows", "label_pages",
    "extract_by_market", "image_pivot", "punch_pay_periods", "order_document", "order_print_grid", "vendor_packets", "order_sheet_cells",
]
# The same plans over the domain tables as a user would have them stored, without deriving them from the star schema.
STORED = {
    "sales_by_sku_long": sales.sales_by_sku_long, "packing_status": packing.packing_status, "order_history": purchasing.order_history,
    "order_detail_nested": purchasing.order_detail_nested, "order_document_lines": orders.order_document_lines,
    "order_print_grid": purchasing.order_print_grid,
}
# Plans whose orders meet their items; timed over plain and bucketed tables, without broadcasts, as large tables would have it.
ORDER_JOINS = {"sales_by_sku_long": sales.sales_by_sku_long, "packing_status": packing.packing_status}
RUNS = 2


def seconds(frame: Callable[[], DataFrame]) -> float:
    start = time.perf_counter()
    frame().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def best(frame: Callable[[], DataFrame]) -> float:
    return round(min(seconds(frame) for _ in range(RUNS)), 3)


def stored(spark: SparkSession, folder: str, root: str) -> Tables:
    """The sample tables, each written when it is first asked for."""
    derived = tables(spark, folder)

    def load(name: str) -> DataFrame:
        getattr(derived, name).write.parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    return Tables(load)


def order_shuffles(frame: DataFrame) -> int:
    return len(re.findall(r"Exchange hashpartitioning\(CHANNEL_ORDER_NO#\d+, MARKET_ID#\d+", frame._jdf.queryExecution().executedPlan().toString()))


def order_joins(spark: SparkSession, own: Tables, cpus: int) -> dict[str, dict[str, float]]:
    """Seconds and shuffles by order key of ORDER_JOINS, over plain tables and over buckets."""
    buckets = layouts.Buckets(tempfile.mkdtemp(prefix="bench-buckets-"), cpus, "bench")
    layouts.store_bucketed(own, buckets)
    bundles = {"plain": own, "bucketed": layouts.open_bucketed(spark, buckets)}
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    for setting, value in settings.items():
        spark.conf.set(setting, value)
    found = {f"{name}, {kind}": {"sec": best(lambda: plan(t)), "shuffles": order_shuffles(plan(t))}  # noqa: B023
             for name, plan in ORDER_JOINS.items() for kind, t in bundles.items()}
    for setting in settings:
        spark.conf.unset(setting)
    return found


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": "16g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": f"file://{tempfile.mkdtemp(prefix='bench-')}",
    })
    spark.sparkContext.setLogLevel("ERROR")
    seconds(lambda: QUERIES["market_meta"](spark, folder))  # start-up is not part of the first query
    timings = {name: best(lambda name=name: QUERIES[name](spark, folder)) for name in names}
    own = stored(spark, folder, tempfile.mkdtemp(prefix="bench-tables-"))
    for plan in STORED.values():
        plan(own)  # writes the tables it needs
    over_stored = {name: best(lambda plan=plan: plan(own)) for name, plan in STORED.items() if name in names}
    joins = order_joins(spark, own, int(cpus)) if set(ORDER_JOINS) <= set(names) else {}
    print(json.dumps({
        "metric": "total seconds over headline queries", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "stored": over_stored, "order_joins": joins, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()

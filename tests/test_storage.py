"""Readers and writers."""

import threading

import pytest
from tests.conftest import SAMPLE
from pyspark.sql import functions as F

from tallyhouse.plans import labels, packing, sales
from tallyhouse.sample.tables import tables
from tallyhouse.schemas import TABLES
from tallyhouse.sources import storage
from tallyhouse.sources.tables import Tables, read_parquet


def lines(spark, path):
    return [r.value for r in spark.read.text(str(path)).collect()]


def test_tsv_prints_nulls_and_raw_text(spark, tmp_path):
    frame = spark.createDataFrame([(' a "quoted", text ', None, ""), ("x", "1", "y")], "`Order #` string, b string, c string")
    storage.write_tsv(frame.coalesce(1), f"{tmp_path}/out")
    assert lines(spark, tmp_path / "out") == ["Order #\tb\tc", ' a "quoted", text \tnull\t', "x\t1\ty"]
    storage.write_tsv(frame.limit(1), f"{tmp_path}/rejects", header=False)
    storage.write_tsv(frame.limit(1), f"{tmp_path}/rejects", header=False, mode="append")
    assert len(lines(spark, tmp_path / "rejects")) == 2


def test_report_exports(spark, tmp_path):
    t = tables(spark, SAMPLE)
    for name, frame in (("sales", sales.sales_by_sku_tsv(t)), ("packing", packing.packing_status_tsv(t)),
                        ("rejects", labels.label_split(t, "%").rejects)):
        storage.write_tsv(frame, f"{tmp_path}/{name}")
        back = spark.read.csv(f"{tmp_path}/{name}", sep="\t", header=True, quote="")
        assert back.count() == frame.count()
        assert not frame.count() or back.columns == frame.columns


def test_json_keeps_nulls_and_nesting(spark, tmp_path):
    frame = spark.createDataFrame([("a", None, [(1, "x")])], "k string, n string, l array<struct<i: int, s: string>>")
    storage.write_json(frame, f"{tmp_path}/out")
    assert lines(spark, tmp_path / "out") == ['{"k":"a","n":null,"l":[{"i":1,"s":"x"}]}']


def test_lines_append(spark, tmp_path):
    frame = spark.createDataFrame([("a-b-c",)], "SKU string")
    for _ in range(2):
        storage.write_lines(frame, "SKU", f"{tmp_path}/out")
    assert lines(spark, tmp_path / "out") == ["a-b-c", "a-b-c"]


def test_snapshots_may_read_the_version_they_replace(spark, tmp_path, got):
    root = f"{tmp_path}/users"
    assert storage.write_snapshot(spark.range(3), root) == 1
    assert storage.write_snapshot(storage.read_snapshot(spark, root).filter("id > 0"), root) == 2
    assert got(storage.read_snapshot(spark, root)) == [(1,), (2,)]
    spark.range(9).write.parquet(f"{root}/version=3")
    (tmp_path / "users" / "version=3" / "_SUCCESS").unlink()  # a version whose job was lost
    assert got(storage.read_snapshot(spark, root)) == [(1,), (2,)]


def test_replaced_partitions_leave_the_others(spark, tmp_path, got):
    frame = spark.createDataFrame([(1, "a"), (2, "b")], "p int, v string")
    storage.replace_partitions(frame, f"{tmp_path}/t", ["p"])
    storage.replace_partitions(frame.filter("p = 2").withColumn("v", F.lit("c")), f"{tmp_path}/t", ["p"])
    assert got(spark.read.parquet(f"{tmp_path}/t"), "p", "v") == [(1, "a"), (2, "c")]


def test_tables_load_lazily_and_by_contract(spark, tmp_path, make):
    seen = []
    bundle = Tables(lambda name: seen.append(name) or spark.range(1))
    assert bundle.orders is bundle.orders and seen == ["orders"]
    other = bundle.with_tables(orders=spark.range(2))
    assert other.orders.count() == 2 and bundle.orders.count() == 1
    assert sorted(n for n in Tables.__annotations__) == sorted(TABLES)
    make(TABLES["markets"], [{"MARKET_ID": 1}]).write.parquet(f"{tmp_path}/markets")
    assert read_parquet(spark, str(tmp_path)).markets.schema == TABLES["markets"]


def test_grids_keep_every_cell(spark, tmp_path):
    wide = ",".join(f"c{i}" for i in range(300))
    long = "x" * 50_000
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "same.csv").write_text(f'a-b-c,x,,d,e\n{wide}\n"say ""hi"", all","two\nlines"\n\n,last\r\n"{long}",z\n')
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "same.csv").write_text("a-b-c,,p-q-r")
    rows = storage.read_grids(spark, f"{tmp_path}/*").collect()
    cells = {k: [r.CELLS for r in rows if f"/{k}/" in r.SHEET_ID] for k in ("one", "two")}
    assert cells["one"] == [["a-b-c", "x", None, "d", "e"], [f"c{i}" for i in range(300)], ['say "hi", all', "two\nlines"], [None, "last"], [long, "z"]]
    assert cells["two"] == [["a-b-c", None, "p-q-r"]] and len({r.SHEET_ID for r in rows}) == 2


def test_work_folder_needs_a_shared_one():
    class Bare:
        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError):
        storage.work_folder(Bare, "x")


def test_work_folder_uses_the_shared_setting():
    class Shared:
        class conf:
            get = staticmethod(lambda key, default: {"spark.checkpoint.dir": "/shared/place/"}.get(key, default))

    first, second = (storage.work_folder(Shared, "x") for _ in range(2))
    assert first.startswith("/shared/place/x-") and first != second


def test_jobs_run_side_by_side(spark):
    """Jobs that wait for one another end; the failure of one is raised when the others are done."""
    meeting, done = threading.Barrier(2, timeout=60), []

    def wait():
        meeting.wait()
        done.append(spark.range(5).count())

    storage.side_by_side(spark, [wait, wait], most=2)
    assert done == [5, 5]
    with pytest.raises(ZeroDivisionError):
        storage.side_by_side(spark, [lambda: 1 / 0, lambda: done.append(1)], most=1)
    assert done == [5, 5, 1]

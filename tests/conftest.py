import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tallyhouse.schemas import TABLES  # noqa: E402
from tallyhouse.session import session  # noqa: E402
from tallyhouse.sources.tables import Tables  # noqa: E402

SAMPLE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark = session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4",
        "spark.default.parallelism": "2",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.shuffle.compress": "false",  # so that hot partitions show in the small data
        "spark.sql.maxMetadataStringLength": "2000",
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}",
    })
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture
def make(spark):
    """Frames of a given schema from dicts; columns not named are null."""

    def frame(schema, rows):
        return spark.createDataFrame([tuple(r.get(f) for f in schema.fieldNames()) for r in rows], schema)

    return frame


@pytest.fixture
def shop(make):
    """Tables from dicts by table name; tables not named are empty."""

    def tables(**rows):
        return Tables(lambda name: make(TABLES[name], rows.get(name, [])))

    return tables


@pytest.fixture
def got():
    """Sorted tuples of the named columns."""

    def rows(frame, *columns):
        return sorted((tuple(r) for r in frame.select(*columns or frame.columns).collect()), key=repr)

    return rows

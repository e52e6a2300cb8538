import pytest

SAMPLE = "/root/testdata/sf0.001"


@pytest.fixture
def table(spark):
    """A frame of rows; a few partitions, and columns whose names the operators use inside."""

    def make(schema, rows, clash=("_row", "_digest", "_text", "fingerprint", "shard", "kind", "class", "n")):
        frame = spark.createDataFrame(rows, schema).repartition(3)
        return frame.selectExpr("*", *(f"'x' as `{name}`" for name in clash))

    return make


@pytest.fixture
def rows():
    def of(frame, *columns):
        return sorted((tuple(r) for r in frame.select(*columns or frame.columns).collect()), key=repr)

    return of

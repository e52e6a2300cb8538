"""Runs registered queries in Spark and DuckDB and compares them: `python -m checks.compare <folder> [names]`."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from checks.oracles import ORACLES
from checks.queries import QUERIES
from tallyhouse.session import session


def database(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in Path(folder).glob("*.parquet"):
        connection.execute(f"create view {file.stem} as select * from read_parquet('{file}')")
    return connection


def _normal(rows: list[tuple], columns: list[str]) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


def difference(spark: SparkSession, connection: duckdb.DuckDBPyConnection, folder: str, name: str) -> str | None:
    """What differs between the two results of a query, or None. Whole results are compared, types included."""
    frame = QUERIES[name](spark, folder)
    found = _normal([tuple(r) for r in frame.collect()], frame.columns)
    cursor = connection.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    expected = _normal(cursor.fetchall(), columns)
    if sorted(frame.columns) != sorted(columns):
        return f"columns {sorted(frame.columns)} != {sorted(columns)}"
    if found != expected:
        extra, missing = list((found - expected).items())[:2], list((expected - found).items())[:2]
        return f"rows {found.total()} vs {expected.total()}\n   only Spark: {extra}\n   only DuckDB: {missing}"
    one, other = next(iter(found), ()), next(iter(expected), ())
    return None if [type(v) for v in one if v is not None] == [type(v) for v in other if v is not None] or one != other else "types"


def main() -> None:
    folder, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    connection = database(folder)
    for name in names:
        start = time.time()
        try:
            problem = difference(spark, connection, folder, name) if name in ORACLES else "no oracle"
        except Exception as error:  # reported, and the other queries still run
            problem = f"{type(error).__name__} {str(error)[:600]}"
        print(f"{'ok  ' if problem is None else 'DIFF'} {name:30s} {time.time() - start:6.2f}s {problem or ''}", flush=True)


if __name__ == "__main__":
    main()

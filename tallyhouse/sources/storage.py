"""Text exports, appends, table snapshots and the shared work folder."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


# The cluster's setting, and one for sessions without it, as it cannot be set later.
SHARED_SETTINGS = ("spark.checkpoint.dir", "spark.tallyhouse.shared.dir")


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder for intermediate tables and stream state, in the shared folder that the session names.

    Driver and executors must see the same files, so there is no local stand-in.
    """
    shared = next(filter(None, (spark.conf.get(setting, None) for setting in SHARED_SETTINGS)), None)
    if not shared:
        raise ValueError(f"set {' or '.join(SHARED_SETTINGS)} to a folder that the driver and all executors share")
    return f"{shared.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored_once(rows: DataFrame, purpose: str) -> DataFrame:
    """The rows, written to a work folder and read from there, for what several writes or joins need and would compute anew each."""
    return _stored_at(rows, work_folder(rows.sparkSession, purpose))


def _stored_at(rows: DataFrame, path: str) -> DataFrame:
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@contextmanager
def stored_meanwhile(rows: DataFrame, purpose: str) -> Iterator[DataFrame]:
    """`stored_once` for the time of a block: its folder is deleted when the block ends, and stays if it fails, as it may hold the only copy of rows that were being replaced."""
    path = work_folder(rows.sparkSession, purpose)
    yield _stored_at(rows, path)
    _delete(rows.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def side_by_side(spark: SparkSession, jobs: Sequence[Callable[[], None]], most: int = 4) -> None:
    """Runs jobs that do not need each other, up to `most` at a time, in order of their start.

    The tasks of the next job fill the cores that the last tasks of one leave idle, so small tables cost little beside large ones. All jobs are done, or
    the first failure is raised, when this returns.
    """
    with ThreadPoolExecutor(most) as pool:
        for started in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]:
            started.result()


def write_tsv(rows: DataFrame, path: str, *, mode: str = "error", header: bool = True, null_text: str = "null") -> None:
    """Tab-separated text without quoting; nulls are written as the word `null` by default."""
    (
        rows.write.mode(mode)
        .option("sep", "\t")
        .option("header", header)
        .option("nullValue", null_text)
        .option("emptyValue", "")
        .option("quote", "\u0000")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_json(rows: DataFrame, path: str, mode: str = "error") -> None:
    """JSON lines; null fields are kept."""
    rows.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_lines(rows: DataFrame, column: str, path: str, mode: str = "append") -> None:
    rows.select(F.col(column).cast("string").alias("value")).write.mode(mode).text(path)


def append_rows(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Appends to a Parquet table, optionally partitioned."""
    writer = rows.write.mode("append")
    if by:
        writer = writer.partitionBy(*by)
    writer.parquet(path)


def replace_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Rewrites only the partitions present in `rows`, so that a repeated write changes nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_judged(judged: DataFrame, path: str, refusal: str = "CODE") -> dict[str, int]:
    """Writes judged requests once, accepted and refused ones in folders of their own (ACCEPTED=true, false), and returns how many there are of each.

    A request is refused where `refusal` is not null. The counts are observed while the rows are written, in the same scan.
    """
    seen, accepted = Observation(), F.col(refusal).isNull()
    rows = judged.observe(seen, F.count_if(accepted).alias("accepted"), F.count_if(~accepted).alias("refused"))
    rows.withColumn("ACCEPTED", accepted).write.partitionBy("ACCEPTED").parquet(path)
    return seen.get


def by_month(rows: DataFrame, date_column: str = "ORDER_DATE") -> DataFrame:
    """Adds ORDER_MONTH, the partition column of the order tables."""
    return rows.withColumn("ORDER_MONTH", F.substring(date_column, 1, 6))


def _versions(spark: SparkSession, root: str, marker: str = "") -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/version=*{marker}")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(int(re.search(r"version=(\d+)", s.getPath().toString())[1]) for s in found)


def _complete_versions(spark: SparkSession, root: str) -> list[int]:
    return _versions(spark, root, "/_SUCCESS")


def write_snapshot(rows: DataFrame, root: str, by: list[str] | None = None) -> int:
    """Writes a new version of a table next to the old one and returns its number.

    The new version becomes the current one only when its success marker is there, so `rows` may
    read the version it replaces, and a lost job leaves the old version in force. A folder that is there already, of a lost job or
    of another writer, is never written into: its number is passed over, or the write fails.
    """
    version = max(_versions(rows.sparkSession, root), default=0) + 1
    writer = rows.write.mode("error")
    if by:
        writer = writer.partitionBy(*by)
    writer.parquet(f"{root}/version={version}")
    return version


def drop_versions(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Deletes all but the newest complete versions of a table written by `write_snapshot`."""
    for version in _complete_versions(spark, root)[:-keep]:
        _delete(spark, f"{root}/version={version}")


def read_snapshot(spark: SparkSession, root: str, schema: StructType | None = None) -> DataFrame | None:
    """The current version of a table written by `write_snapshot`, or None if there is none. An empty version needs its schema."""
    versions = _complete_versions(spark, root)
    if not versions:
        return None
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{root}/version={versions[-1]}")


def _quoted_lines(spark: SparkSession, path: str) -> DataFrame:
    """(SHEET_ID, _block, _at, value, _starts, _even): every line of the files, whether a row starts with it, and whether its quotes are even.

    A block is what one task reads of a file. A line starts a row if an even number of quotes comes before it in the file: that of the
    blocks before, summed per file, and that of the lines before in its block. A last quote without a partner is no quote; the line ends there.
    """
    text = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("SHEET_ID"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"), "value", (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("_quotes"),
    )
    place = ["SHEET_ID", "_block"]
    in_file = Window.partitionBy("SHEET_ID").orderBy("_block")
    blocks = text.groupBy(*place).agg(F.sum("_quotes").alias("_own"))
    whole = Window.partitionBy("SHEET_ID")
    blocks = blocks.select(
        *place, "_own", F.coalesce(F.sum("_own").over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        (F.sum("_own").over(whole) % 2 == 1).alias("_odd"), F.max(F.when(F.col("_own") > 0, F.col("_block"))).over(whole).alias("_last"),
    )
    in_block = Window.partitionBy(*place).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    lines = text.join(blocks, place).withColumn("_seen", F.coalesce(F.sum("_quotes").over(in_block), F.lit(0)))
    unmatched = F.col("_odd") & (F.col("_block") == F.col("_last")) & (F.col("_quotes") > 0) & (F.col("_seen") + F.col("_quotes") == F.col("_own"))
    starts = (F.col("_before") + F.col("_seen")) % 2 == 0
    # Behind the last quote of a file all quotes are matched, or the last one does not count.
    starts = starts | (F.col("_odd") & ((F.col("_block") > F.col("_last")) | ((F.col("_block") == F.col("_last")) & (F.col("_seen") == F.col("_own")))))
    return lines.select(
        *place, "_at", F.when(unmatched, F.regexp_replace("value", '"([^"]*)$', "\n$1")).otherwise(F.col("value")).alias("value"),
        starts.alias("_starts"), ((F.col("_quotes") - unmatched.cast("int")) % 2 == 0).alias("_even"),
    )


def read_grids(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Exported sheets (one delimited file each) as rows of cells; a row has all its cells, however many.

    Quoted cells may hold separators, doubled quotes and line ends; these read as a line feed. A file is read by many tasks: whether a line
    end stands in quotes follows from the quotes before it, which are counted by block and summed in order. Rows that run over several lines are
    put together, also across blocks. An empty cell is null, empty lines are left out. The sheet is the file's path; ROW_NO counts a
    sheet's rows from 1, empty ones included. Rows come in order; a plan that does not need it drops the sort.
    """
    aside = work_folder(spark, "lines")
    flagged = _quoted_lines(spark, path)
    flagged.write.parquet(aside)
    lines = spark.read.schema(flagged.schema).parquet(aside)
    block = ["SHEET_ID", "_block"]
    # A row is named by the line it starts with. Lines before the first start of a block go on with the last row that started before.
    so_far = Window.partitionBy(*block).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumns({
        "_row": F.max(F.when(F.col("_starts"), F.col("_at"))).over(so_far), "_nth": F.sum(F.col("_starts").cast("int")).over(so_far)})
    per_block = lines.groupBy(*block).agg(F.sum(F.col("_starts").cast("int")).alias("_rows"))
    earlier = Window.partitionBy("SHEET_ID").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    per_block = per_block.select(*block, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_above"))
    numbered = numbered.join(per_block, block).withColumn("ROW_NO", F.col("_above") + F.coalesce("_nth", F.lit(0)))
    single = F.col("_starts") & F.col("_even")
    alone = numbered.filter(single).select("SHEET_ID", "ROW_NO", "value")
    several = numbered.filter(~single).groupBy("SHEET_ID", "ROW_NO").agg(F.array_sort(F.collect_list(F.struct("_block", "_at", "value"))).alias("_lines"))
    several = several.select("SHEET_ID", "ROW_NO", F.array_join(F.transform("_lines", lambda line: line["value"]), "\n").alias("value"))
    rows = alone.unionByName(several).select("SHEET_ID", "ROW_NO", F.explode(_rows_of("value")).alias("value"))
    return rows.select("SHEET_ID", "ROW_NO", _cells_of("value", sep).alias("CELLS")).orderBy("SHEET_ID", "ROW_NO")


def _rows_of(text: str) -> Column:
    """The rows of a text whose quotes are matched; empty ones are left out."""
    return F.regexp_extract_all(text, F.lit(r'(?:[^"\r\n]++|"[^"]*+")++'), F.lit(0))


def _cells_of(row: str, sep: str) -> Column:
    mark = re.escape(sep)
    cell = rf'{mark}("(?:[^"]++|"")*+"|[^"{mark}][^{mark}]*+|)'
    plain = lambda c: F.when(c == "", F.lit(None)).when(
        c.startswith('"'), F.replace(F.substr(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
    ).otherwise(c)
    return F.transform(F.regexp_extract_all(F.concat(F.lit(sep), row), F.lit(cell), F.lit(1)), plain)


def write_range(sheet: DataFrame, block: DataFrame, row: int = 1, column: int = 1) -> DataFrame:
    """The sheet (SHEET_ID, ROW_NO, CELLS) after a block of cells was written into it with its upper left cell at `row` and `column`, from 1.

    `block` has SHEET_ID, ROW_NO (from 1 within the block) and CELLS. Its cells replace what is there, a null one too; rows and cells
    beyond the sheet's ends are added, and what lies between is null. Rows of a sheet meet by number, so neither is gathered. The ROW_NO
    of a sheet is unique; sheets that only the block names are new.
    """
    placed = block.select("SHEET_ID", (F.col("ROW_NO") + (row - 1)).alias("ROW_NO"), F.col("CELLS").alias("_new"))
    both = sheet.select("SHEET_ID", "ROW_NO", "CELLS").join(placed, ["SHEET_ID", "ROW_NO"], "full")
    old, new = F.coalesce("CELLS", F.array().cast("array<string>")), F.col("_new")
    width = F.greatest(F.size(old), F.size(new) + (column - 1))
    cell = lambda i: F.when((i >= column) & (i < column + F.size(new)), F.get(new, i - column)).otherwise(F.get(old, i - 1))
    cells = F.when(new.isNull() | (F.size(new) == 0), old).otherwise(F.transform(F.sequence(F.lit(1), width), cell))
    return both.select("SHEET_ID", "ROW_NO", cells.alias("CELLS"))


def write_grid(rows: DataFrame, path: str, sep: str = ",", mode: str = "error") -> None:
    """A grid (SHEET_ID, ROW_NO, CELLS) as one delimited file per sheet, in a folder of its name, for `read_grids`.

    A file has its rows in order, so one task writes a sheet. Cells with separators, quotes or line ends are
    quoted; null cells are empty. Rows without cells and gaps in ROW_NO are empty lines.
    """
    special = rf'[{re.escape(sep)}"\r\n]'
    quoted = lambda c: F.when(c.rlike(special), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    line = F.array_join(F.transform("CELLS", lambda c: F.coalesce(quoted(c), F.lit(""))), sep)
    before = Window.partitionBy("SHEET_ID").orderBy("ROW_NO")
    gap = F.col("ROW_NO") - F.coalesce(F.lag("ROW_NO").over(before), F.lit(0)) - 1
    text = rows.select("SHEET_ID", "ROW_NO", F.concat(F.repeat(F.lit("\n"), gap.cast("int")), F.coalesce(line, F.lit(""))).alias("value"))
    text.repartition("SHEET_ID").sortWithinPartitions("SHEET_ID", "ROW_NO").select("SHEET_ID", "value").write.mode(mode).partitionBy("SHEET_ID").text(path)

"""Delimited sheets read by many tasks, against a plain reader of whole files."""

import random
import re

import pytest

from tallyhouse.sources import storage


def plain(text):
    """(row number, cells) by walking the characters: quotes toggle, line ends outside quotes end a row, a last unmatched quote ends one too."""
    text = re.sub(r"\r\n|\r", "\n", text)
    if text.count('"') % 2:
        at = text.rindex('"')
        text = text[:at] + "\0" + text[at + 1 :]
    rows, number, row, quoted = [], 1, "", False
    for c in text + "\n":
        if c == '"':
            quoted = not quoted
        if c in "\n\0" and not quoted:
            if row:
                rows.append((number, row))
            row, number = "", number + (c == "\n")
        else:
            row += c
    out = []
    for number, row in rows:
        cells, cell, quoted = [], "", False
        for c in row + ",":
            if c == '"':
                quoted = not quoted
            if c == "," and not quoted:
                cells.append(cell)
                cell = ""
            else:
                cell += c
        out.append((number, [None if c == "" else c[1:-1].replace('""', '"') if c.startswith('"') else c for c in cells]))
    return out


def sheet(rng, rows):
    def cell():
        kind = rng.randrange(7)
        if kind < 3:
            return rng.choice(["", "a-b-c", "plain", "x y", "é" * rng.randrange(9)])
        inner = "".join(rng.choice(["a", ",", '""', "\n", "\r\n", "\n\n", "long" * 9, "é"]) for _ in range(rng.randrange(12)))
        return f'"{inner}"'

    return "".join(",".join(cell() for _ in range(rng.randrange(1, 6))) + rng.choice(["\n", "\n", "\r\n", "\n\n"]) for _ in range(rows))


@pytest.fixture
def small_blocks(spark):
    """Files are cut every few dozen bytes, so that quotes and line ends lie on either side of a cut."""
    names = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def found(spark, path):
    by_sheet = {}
    for r in storage.read_grids(spark, str(path)).collect():
        by_sheet.setdefault(r.SHEET_ID.rsplit("/", 1)[-1], []).append((r.ROW_NO, r.CELLS))
    return {k: sorted(v, key=repr) for k, v in by_sheet.items()}


def test_many_small_blocks_equal_a_plain_reader(spark, tmp_path, small_blocks):
    rng = random.Random(8)
    texts = {f"s{i}.csv": sheet(rng, rng.choice([1, 5, 60])) for i in range(6)}
    texts["open.csv"] = 'a,b\n"c,d\ne,f\n' + sheet(rng, 20).replace('"', "'") + "tail"  # a quote that is never closed
    texts["late.csv"] = sheet(rng, 30) + 'x,"y\nz\n'
    texts["long.csv"] = '"' + "row\n" * 200 + '",end\nnext,"' + "q" * 500 + '"\n'
    texts["blank.csv"] = "\n\n\r\n"
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    result = found(spark, tmp_path)
    for name, text in texts.items():
        assert result.get(name, []) == sorted(plain(text), key=repr), name


def test_a_file_is_read_by_many_tasks(spark, tmp_path, small_blocks):
    (tmp_path / "one.csv").write_text("a,b,c\n" * 400)
    lines = storage._quoted_lines(spark, str(tmp_path))
    assert lines.select("_block").distinct().count() > 20
    rows = storage.read_grids(spark, str(tmp_path)).collect()
    assert sorted(r.ROW_NO for r in rows) == list(range(1, 401)) and all(r.CELLS == ["a", "b", "c"] for r in rows)


GRID = "SHEET_ID string, ROW_NO long, CELLS array<string>"


def plain_range(sheet, block, row, column):
    out = {(s, n): list(c or []) for s, n, c in sheet}
    for s, n, cells in block:
        own = out.setdefault((s, n + row - 1), [])
        if cells:
            own += [None] * (column - 1 + len(cells) - len(own))
            own[column - 1 : column - 1 + len(cells)] = cells
    return sorted(((s, n, c) for (s, n), c in out.items()), key=repr)


@pytest.mark.parametrize("row, column", [(1, 1), (2, 3), (4, 1), (9, 7)])
def test_a_range_is_written_into_a_sheet(spark, row, column):
    """Overlaps, growth to the right and below, ragged rows, null and missing cells, a new sheet."""
    sheet = [("s", 1, ["a", "b", "c"]), ("s", 2, ["d"]), ("s", 3, None), ("s", 4, ["e", None, "f", "g"]), ("t", 1, ["z"])]
    block = [("s", 1, ["1", None]), ("s", 2, []), ("s", 3, ["2", "3", "4"]), ("u", 1, ["n"]), ("s", 4, None)]
    found = storage.write_range(spark.createDataFrame(sheet, GRID), spark.createDataFrame(block, GRID), row, column)
    assert sorted(map(tuple, found.collect()), key=repr) == plain_range(sheet, block, row, column)


def test_a_written_grid_reads_the_same(spark, tmp_path, small_blocks):
    rows = [("one", 1, ["a", None, 'say "hi"', "x,y"]), ("one", 2, ["two\nlines", "é"]), ("one", 5, ["after a gap"]), ("two", 3, ["b", "c"]), ("one", 7, None)]
    storage.write_grid(spark.createDataFrame(rows, GRID), f"{tmp_path}/out")
    found = storage.read_grids(spark, f"{tmp_path}/out/*").collect()
    got = sorted((re.search("SHEET_ID=([^/]+)", r.SHEET_ID)[1], r.ROW_NO, r.CELLS) for r in found)
    assert got == sorted(r for r in rows if r[2] and r[0] == "one") + [("two", 3, ["b", "c"])]

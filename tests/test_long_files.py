"""Files whose tables have many blocks of lines, and text at the bounds of slices."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from seaward.sources import ctf

HEAD = '%Site: TEST ""\n%Origin: 40.0 -73.0\n'


def table(kind, rows, no=1, mark=""):
    names = "TIME MWHT DIST" if kind == "WAVL" else "TIME AMP1 XTRP"
    return f"%TableType: {kind} x\n%TableColumns: 3\n%TableColumnTypes: {names}\n%TableRows: {len(rows)}\n%TableStart: {no}\n" + "".join(f"{mark} {r}\n" for r in rows) + f"%TableEnd: {no}\n%%\n"


@pytest.mark.parametrize("lines", [1, 3, 1000])
def test_rows_of_many_blocks(spark, monkeypatch, lines):
    monkeypatch.setattr(ctf, "BLOCK_LINES", lines)
    rows = [f"{i}  {i * 2}   a{i}" for i in range(10)]
    text = HEAD + table("rads", rows[:7]) + table("rcvr", [*rows, ""], 2, "%") + "%End:\n"
    parsed = ctf.parse_files(spark.createDataFrame([("a", text), ("b", HEAD + table("rads", []) + "%End:\n")], "path string, content string"))
    assert sorted((r.n_rows, r.n_cols_row) for r in ctf.file_table(parsed).collect()) == [(0, 0), (7, 3)]
    got = ctf.table_rows(parsed, "rcvr", {"TIME": "int", "AMP1": "int", "XTRP": "string"}).orderBy("row_no").collect()
    assert [(r.row_no, r.TIME_S, r.AMP1, r.XTRP) for r in got] == [(i, i, i * 2, f"a{i}") for i in range(10)] + [(10, None, None, None)]
    mine = ctf.table_rows(parsed, "rads", {"TIME": "int", "AMP1": "int", "XTRP": "string"})
    out = {r.path: r.value.splitlines() for r in ctf.export_files(mine, parsed, {"TIME": "int", "AMP1": "int", "XTRP": "string"}).collect()}
    at = out["a"].index("%TableStart: 2")
    assert out["a"][at + 1 : at + 13] == [*(f"%  {i}  {i * 2}  a{i}" for i in range(10)), "%  ", "%TableEnd: 2"]


@pytest.mark.parametrize("size", [1, 5, 64, 1 << 20])
def test_lines_of_slices(monkeypatch, size):
    monkeypatch.setattr(ctf, "SLICE_BYTES", size)
    for text in ("", "a", "a\r\nb\rc\n\nd\x85e f é漢\n", "x" * 300 + "\ny\n", "\n\n", "é" * 70):
        assert list(ctf.lines_of(text.encode(), "utf-8")) == text.splitlines()
    assert list(ctf.lines_of("a\xe9\x85b\n".encode("ISO-8859-1"), "ISO-8859-1")) == ["a\xe9", "b"]


def test_kind_is_that_of_any_row_of_the_first_table(spark, monkeypatch):
    monkeypatch.setattr(ctf, "BLOCK_LINES", 2)
    files = [("late", ["0 1 nan"] * 5 + ["5 1 3.0"]), ("none", ["0 1 nan", "0 1", "", "0 1 x"])]
    made = [(n, HEAD + table("WAVL", rows) + table("WAVL", ["9 1 4.0"], 2) + "%End:\n") for n, rows in files]
    parsed = ctf.parse_files(spark.createDataFrame([(n, t.encode()) for n, t in made], "path string, content binary"))
    assert {r.path: r.kind for r in parsed.collect()} == {"late": "ranged", "none": "averaged"}
    assert ctf.read_waves(parsed).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy("kind").collect() == [("averaged", 3), ("ranged", 7)]


def test_memory_of_a_large_file():
    """A file of 12 MB is parsed in less than eight times its size (values as Python lists took over forty times)."""
    code = """
import resource, sys
from seaward.sources import ctf
rows = "".join(f"{i}  12345  2024  1  2  3  4  5\\n" for i in range(400_000))
data = ("%TableType: rads x\\n%TableColumnTypes: TIME AMP1 TYRS TMON TDAY THRS TMIN TSEC\\n%TableStart:\\n" + rows + "%TableEnd:\\n%End:\\n").encode()
del rows
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024
before = peak()
assert ctf.parse_lines(ctf.lines_of(data, "utf-8"))["tables"][0]["n_rows"] == 400_000
print((peak() - before) / len(data))
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(__file__)))
    assert float(out.stdout) < 8

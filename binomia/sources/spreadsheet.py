"""Spreadsheets (.xlsx) as a Spark data source: the rows of each sheet, streamed from the zip by one task.

A file is read as ``sheet, row, cells``; :func:`read_sheet` makes a table of it. Files must be
on a path that every executor can open. Only the standard library parses them: sheets are
streamed, shared strings are held by the task that needs them.
"""

from __future__ import annotations

import os
import re
import uuid
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse
from xml.etree.ElementTree import iterparse
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, sheet string, row int, cells array<string>"
#: Rows of a batch; rows that a sheet can have.
BATCH, MOST_ROWS = 2000, 1_048_576
#: Header rows that are tried, and rows below one that are looked at.
HEADS, PROBES = 20, 10


def local(path: str) -> str:
    """A path or file URL as a path."""
    return unquote(urlparse(path).path) if path.startswith("file:") else path


def files_of(path: str) -> list[str]:
    """The file, or all spreadsheets in a folder, by name."""
    path = local(path)
    if os.path.isdir(path):
        return [os.path.join(path, f) for f in sorted(os.listdir(path)) if f.endswith(".xlsx") and not f.startswith(("~", "."))]
    return [path]


def _plain(tag: str) -> str:
    return tag.rpartition("}")[2]


def _walk(z: zipfile.ZipFile, name: str, wanted: str) -> Iterator:
    """Elements of one kind of a part of the zip, each dropped once it was seen."""
    with z.open(name) as f:
        stack = []
        for event, e in iterparse(f, ("start", "end")):
            if event == "start":
                stack.append(e)
                continue
            stack.pop()
            if _plain(e.tag) == wanted:
                yield e
                e.clear()
                if stack:
                    stack[-1].remove(e)


def sheets_of(z: zipfile.ZipFile) -> dict[str, str]:
    """Names of sheets in order, and their parts of the zip."""
    parts = {e.get("Id"): e.get("Target") for e in _walk(z, "xl/_rels/workbook.xml.rels", "Relationship")}
    out = {}
    for e in _walk(z, "xl/workbook.xml", "sheet"):
        target = next((parts.get(v) for k, v in e.attrib.items() if _plain(k) == "id"), None)
        if target:
            out[e.get("name")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return out


def _text(e) -> str:
    """The runs of a string, without phonetic ones."""
    runs = [x.text or "" for x in e if _plain(x.tag) == "t"]
    return "".join(runs + [t.text or "" for r in e if _plain(r.tag) == "r" for t in r if _plain(t.tag) == "t"])


def column_number(ref: str) -> int:
    """0 for A, 26 for AA."""
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _value(c, shared: list[str]) -> str | None:
    kind, v = c.get("t", "n"), next((x.text for x in c if _plain(x.tag) == "v"), None)
    if kind == "inlineStr":
        return next((_text(x) for x in c if _plain(x.tag) == "is"), None)
    if v is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(v)]
    if kind == "b":
        return "true" if v == "1" else "false"
    if kind == "n" and re.fullmatch(r"-?\d+\.0+", v):
        return v.partition(".")[0]
    return v


def sheet_rows(z: zipfile.ZipFile, part: str, most: int = MOST_ROWS) -> Iterator[tuple[int, list[str | None]]]:
    """Row numbers from 1 and cells of a sheet, to row ``most``; rows that the file leaves out are left out."""
    shared = [_text(e) for e in _walk(z, "xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in z.namelist() else []
    at = 0
    for e in _walk(z, part, "row"):
        at = int(e.get("r", at + 1))
        if at > most:
            return
        cells: list[str | None] = []
        for c in e:
            if _plain(c.tag) != "c":
                continue
            k = column_number(c.get("r")) if c.get("r") else len(cells)
            cells += [None] * (k - len(cells))
            cells.append(_value(c, shared))
        yield at, cells


class _Sheet(InputPartition):
    def __init__(self, file: str, sheet: str, part: str) -> None:
        self.file, self.sheet, self.part = file, sheet, part


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.sheet, self.most = options["path"], options.get("sheet"), int(options.get("rows", MOST_ROWS))

    def partitions(self) -> list[_Sheet]:
        """One per sheet; only names are read here."""
        out = []
        for file in files_of(self.path):
            with zipfile.ZipFile(file) as z:
                there = sheets_of(z)
            if self.sheet is not None and self.sheet.isdigit() and self.sheet not in there:
                there = dict([list(there.items())[int(self.sheet) - 1]])
            elif self.sheet is not None:
                if self.sheet not in there:
                    raise ValueError(f"no sheet {self.sheet!r} in {file}; there are {', '.join(there)}")
                there = {self.sheet: there[self.sheet]}
            out += [_Sheet(file, name, part) for name, part in there.items()]
        return out

    def read(self, partition: _Sheet) -> Iterator[pa.RecordBatch]:
        def batch(rows: list) -> pa.RecordBatch:
            n = len(rows)
            cols = [pa.array([partition.file] * n), pa.array([partition.sheet] * n), pa.array([r for r, _ in rows], pa.int32()), pa.array([c for _, c in rows], pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays(cols, ["file", "sheet", "row", "cells"])

        held = []
        with zipfile.ZipFile(partition.file) as z:
            for row in sheet_rows(z, partition.part, self.most):
                held.append(row)
                if len(held) >= BATCH:
                    yield batch(held)
                    held = []
        if held:
            yield batch(held)


class Spreadsheet(DataSource):
    """``spark.read.format("xlsx").option("sheet", ..).load(path)``: a row of cells at a time."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def cells(spark: SparkSession, path: str, sheet: str | int | None = None, rows: int | None = None) -> DataFrame:
    """``file, sheet, row, cells`` of one sheet (by name, or number from 1) or all, to row ``rows``."""
    spark.dataSource.register(Spreadsheet)
    r = spark.read.format("xlsx")
    for k, v in (("sheet", sheet), ("rows", rows)):
        r = r if v is None else r.option(k, str(v))
    return r.load(path)


def headings(cells_: list[str | None]) -> list[str]:
    """Names of columns: blank ones by their place, repeated ones with a number."""
    out: list[str] = []
    for k, c in enumerate(cells_):
        name = (c or "").strip() or f"column_{k + 1}"
        n = 2
        while name in out:
            name, n = f"{(c or '').strip() or f'column_{k + 1}'}_{n}", n + 1
        out.append(name)
    return out


def read_sheet(spark: SparkSession, path: str, sheet: str | int | None = None, start_row: int = 1) -> DataFrame:
    """A sheet (the first one without name) as a table: names in ``start_row``, rows below it.

    A column whose cells are all numbers is a double, whole ones a long, others are text;
    blank cells are null, blank rows are left out. Of a folder every file's sheet is read, with
    the first file's names.
    """
    rows = cells(spark, path, sheet if sheet is not None else 1)
    head = cells(spark, path, sheet if sheet is not None else 1, start_row).filter(F.col("row") == start_row).orderBy("file").first()
    if head is None:
        raise ValueError(f"no row {start_row} in {path}")
    names = headings(head["cells"])
    blank = lambda c: F.when(F.trim(c) != "", c)
    body = rows.filter(F.col("row") > start_row).select(*[blank(F.get("cells", k)).alias(f"c{k}") for k in range(len(names))])
    body = body.filter(F.coalesce(*body.columns).isNotNull())
    of = lambda c, t: F.col(c).try_cast(t)
    checks = [F.struct(F.count(c).alias("n"), F.count(of(c, "double")).alias("d"), F.count(F.when(F.col(c).rlike(r"^-?\d{1,18}$"), 1)).alias("l")).alias(c) for c in body.columns]
    seen = body.agg(*checks).first()  # a row of counts
    kind = lambda s: "long" if s["n"] and s["l"] == s["n"] else "double" if s["n"] and s["d"] == s["n"] else "string"
    return body.select(*[of(c, kind(seen[c])).alias(n) for c, n in zip(body.columns, names, strict=True)])


def detect_sheet(spark: SparkSession, path: str, matches: Callable[[DataFrame], DataFrame]) -> tuple[str, int, str]:
    """(sheet, header row, column) whose first cells below the header match best.

    ``matches`` gives those of distinct ``input_name`` that are names. Looked at are header
    rows 1 to :data:`HEADS` and :data:`PROBES` cells below each, of all sheets, in one job; the
    first with four fifths of matches wins, else the best one; below a tenth none does.
    """
    top = cells(spark, path, rows=HEADS + PROBES).select("sheet", "row", F.posexplode("cells").alias("at", "value"))
    top = top.filter(F.trim("value") != "")
    names = matches(top.select(F.col("value").alias("input_name")).distinct()).select(F.col("input_name").alias("value"), F.lit(True).alias("hit")).distinct()
    got = top.join(names, "value", "left").select("sheet", "row", "at", "value", F.coalesce("hit", F.lit(False)).alias("hit")).collect()  # bounded by rows and columns of sheets
    order = {s: k for k, s in enumerate(dict.fromkeys(p.sheet for f in files_of(path)[:1] for p in _Reader({"path": f}).partitions()))}
    best, grid = (0.0, "", 0, ""), {(r["sheet"], r["row"], r["at"]): r for r in got}
    for sheet, row, at in sorted(grid, key=lambda k: (order.get(k[0], len(order)), k[1], k[2])):
        if row > HEADS:
            continue
        below = [grid[sheet, row + k, at] for k in range(1, PROBES + 1) if (sheet, row + k, at) in grid]
        if len(below) < 2:
            continue
        rate = sum(c["hit"] for c in below) / len(below)
        if rate > best[0]:
            best = (rate, sheet, row, grid[sheet, row, at]["value"].strip())
        if rate >= 0.8:
            break
    if best[0] < 0.1:
        raise ValueError("no column of names found in any sheet; name sheet, row and column")
    return best[1:]


_PARTS = {
    "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/workbook.xml": '<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="data" sheetId="1" r:id="rId1"/></sheets></workbook>',
}


def _cell(v: object) -> str:
    if v is None:
        return "<c/>"
    if isinstance(v, bool):
        return f'<c t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)) and v == v and abs(v) != float("inf"):
        return f"<c><v>{v!r}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(re.sub(r"[^\t\n\r -퟿-�\U00010000-\U0010ffff]", "", str(v)))}</t></is></c>'


def write_sheets(df: DataFrame, path: str) -> None:
    """Write a table as a folder of spreadsheets, one or more a partition, each up to the rows that a sheet can have.

    Numbers, booleans and text keep their kind, other values become text. A file appears under
    its name when it is complete; an existing folder is an error.
    """
    path, names = local(path), df.columns
    if os.path.exists(path):
        raise FileExistsError(path)
    os.makedirs(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        first, count = next(rows, None), 0
        while first is not None:
            final = f"{path}/part-{TaskContext.get().partitionId():05d}-{count:03d}.xlsx"
            part = f"{final}.{uuid.uuid4().hex}"
            with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED) as z:
                for name, text in _PARTS.items():
                    z.writestr(name, text)
                with z.open("xl/worksheets/sheet1.xml", "w") as f:
                    line = lambda r: ("<row>" + "".join(map(_cell, r)) + "</row>").encode()
                    f.write(b'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
                    f.write(line(names))
                    for _ in range(MOST_ROWS - 1):
                        if first is None:
                            break
                        f.write(line(first))
                        first = next(rows, None)
                    f.write(b"</sheetData></worksheet>")
            os.replace(part, final)
            count += 1
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int32())], ["files"])

    df.mapInArrow(run, "files int").agg(F.sum("files")).first()

"""Sheets of Excel workbooks (.xlsx) as text, by the standard library's zip and XML readers."""

from __future__ import annotations

import datetime
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a task holds at once.
BATCH = 4096
#: Number formats that show a date or a time, of those that a workbook needn't declare (fixed values of the file format).
DATE_FORMATS = {*range(14, 23), *range(45, 48)}


def _tag(element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _text(element) -> str:
    """What the t elements of a string hold, but for phonetic hints."""
    return "".join(t.text or "" for part in element if _tag(part) != "rPh" for t in part.iter() if _tag(t) == "t")


def _number(text: str, dated: bool, since: datetime.datetime) -> str:
    if dated:
        moment = since + datetime.timedelta(days=float(text))
        moment = (moment + datetime.timedelta(microseconds=500_000)).replace(microsecond=0)
        return moment.date().isoformat() if moment.time() == datetime.time() else moment.isoformat(" ")
    value = float(text)
    return str(int(value)) if value.is_integer() and abs(value) < 2**53 else text if "E" not in text.upper() else repr(value)


class _Workbook:
    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self.zip.namelist())
        book = self._xml("xl/workbook.xml")
        old = next((p.get("date1904") in ("1", "true") for p in book.iter() if _tag(p) == "workbookPr"), False)
        self.since = datetime.datetime(1904, 1, 1) if old else datetime.datetime(1899, 12, 30)
        targets = {r.get("Id"): r.get("Target") for r in self._xml("xl/_rels/workbook.xml.rels")}
        self.sheets = []
        for s in book.iter():
            if _tag(s) == "sheet":
                target = targets[next(v for k, v in s.attrib.items() if k.endswith("}id"))]
                self.sheets.append((s.get("name"), posixpath.normpath(target[1:] if target.startswith("/") else posixpath.join("xl", target))))
        self.shared = [_text(s) for s in self._xml("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in self.names else []
        self.dated = self._dated() if "xl/styles.xml" in self.names else []

    def _xml(self, name: str):
        return ElementTree.fromstring(self.zip.read(name))

    def _dated(self) -> list[bool]:
        """For each cell style, whether it shows numbers as dates."""
        root = self._xml("xl/styles.xml")
        own = {f.get("numFmtId"): f.get("formatCode", "") for f in root.iter() if _tag(f) == "numFmt"}
        shows = lambda code: bool(re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code.lower())))
        styles = next((x for x in root if _tag(x) == "cellXfs"), [])
        return [shows(own[x.get("numFmtId")]) if x.get("numFmtId") in own else int(x.get("numFmtId", 0)) in DATE_FORMATS for x in styles]

    def _value(self, cell) -> str | None:
        kind, parts = cell.get("t", "n"), {_tag(x): x for x in cell}
        if kind == "inlineStr":
            return _text(parts["is"]) if "is" in parts else None
        text = parts["v"].text if "v" in parts else None
        if text is None or kind == "e":
            return None
        if kind == "s":
            return self.shared[int(text)]
        if kind == "b":
            return "True" if text == "1" else "False"
        style = int(cell.get("s", 0))
        return text if kind in ("str", "d") else _number(text, style < len(self.dated) and self.dated[style], self.since)

    def rows(self, part: str) -> Iterator[tuple[int, list[str | None]]]:
        """Number and cells of each row with a value; the XML is read as it comes and forgotten row by row."""
        number = 0
        with self.zip.open(part) as stream:
            parent = None
            for event, element in ElementTree.iterparse(stream, ("start", "end")):
                if event == "start":
                    parent = element if _tag(element) == "sheetData" else parent
                elif _tag(element) == "row":
                    number = int(element.get("r", number + 1))
                    cells: list[str | None] = []
                    for c in element:
                        if _tag(c) != "c":
                            continue
                        letters = re.match("[A-Z]*", c.get("r", ""))[0]
                        at = 0
                        for x in letters:
                            at = at * 26 + ord(x) - 64
                        cells += [None] * ((at or len(cells) + 1) - 1 - len(cells)) + [self._value(c)]
                    if any(x is not None for x in cells):
                        yield number, cells
                    parent.clear()


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            book = _Workbook(content)
            for place, (sheet, part) in enumerate(book.sheets):
                if not part.startswith("xl/worksheets/"):
                    continue
                held = []
                for number, cells in book.rows(part):
                    held.append((path, sheet, place, number, cells))
                    if len(held) == BATCH:
                        yield pd.DataFrame(held, columns=["path", "sheet", "place", "row", "cells"])
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=["path", "sheet", "place", "row", "cells"])


def cells(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, place (of the sheet, from 0), row (as the sheet numbers it), cells: all rows with a value of all sheets of the workbooks at a path, cells as text.

    Whole numbers have no fraction, dates are ISO, true is True, errors and empty cells are null; of a formula the value that the file keeps. A workbook is one task's: the format
    itself ends a sheet at 1,048,576 rows, and its XML is streamed. A file that is no workbook is an error.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content").repartition("path")
    return files.mapInPandas(_cells, "path string, sheet string, place int, row long, cells array<string>")


def read_sheets(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """The rows of a sheet, the first if none is named, of workbooks, with columns named by each one's first row; what a workbook doesn't have is null. All text.

    A name that a header repeats stands for its first column, a column without a name is left out. Names are collected: one row a file. No rows, no columns.
    """
    all_ = cells(spark, path)
    mine = all_.where(F.col("sheet") == sheet) if sheet is not None else all_.where("place = 0")
    heads = mine.groupBy("path").agg(F.min_by("cells", "row").alias("_header"), F.min("row").alias("_first"))
    names = [r.name for r in heads.select(F.posexplode("_header").alias("at", "name")).where("trim(name) <> ''").groupBy("name").agg(F.min("at").alias("at")).orderBy("at", "name").collect()]
    at = mine.join(heads, "path").where("row > _first")
    return at.select(*(F.try_element_at("cells", F.nullif(F.array_position("_header", n), F.lit(0)).cast("int")).alias(n) for n in names))

"""Excel workbooks (.xlsx) read on executors, from whole files in a binary column.

A workbook is a zip of XML. Sheets are read as they stream out of their entry,
a row at a time, so a long sheet costs no more memory than a short one; only
the table of shared strings is held. A file that is no workbook gives one row
with its error.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
DATES = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}  # built-in number formats of dates and times
CELLS = "path string, sheet string, row int, col int, kind string, text string, number double, at timestamp, error string"
_TYPES = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.timestamp("us", "UTC"), pa.string()]


def column_number(name: str) -> int:
    """A is 1, Z is 26, AA is 27."""
    n = 0
    for c in name:
        n = 26 * n + ord(c) - 64
    return n


def _is_date(code: str) -> bool:
    """Whether a number format shows a date or time: a letter of one outside quotes, escapes and brackets (but those of elapsed time)."""
    plain = re.sub(r'"[^"]*"|\\.|_.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", code.lower())
    return bool(re.search("[dmyhs]", plain)) and "general" not in plain


def _plain_text(node: ElementTree.Element) -> str:
    """Runs of text without phonetic hints."""
    return "".join(t.text or "" for run in node for t in ([run] if run.tag == MAIN + "t" else run.findall(MAIN + "t") if run.tag == MAIN + "r" else []))


def _dated(book: zipfile.ZipFile) -> list[bool]:
    """By style: whether it shows dates."""
    if "xl/styles.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId", -1)): f.get("formatCode", "") for f in root.iter(MAIN + "numFmt")}
    styles = root.find(MAIN + "cellXfs")
    ids = [int(x.get("numFmtId", 0)) for x in styles] if styles is not None else []
    return [_is_date(own[i]) if i in own else i in DATES for i in ids]


def workbook(data: bytes) -> Iterator[tuple]:
    """(sheet, row, col, kind, text, number, at) of every cell that holds something."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        root = ElementTree.fromstring(book.read("xl/workbook.xml"))
        relations = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        strings = [_plain_text(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in book.namelist() else []
        dated = _dated(book)
        about = root.find(MAIN + "workbookPr")
        zero = datetime(1904, 1, 1) if about is not None and about.get("date1904") in ("1", "true") else datetime(1899, 12, 30)
        for sheet in root.iter(MAIN + "sheet"):
            target = relations[sheet.get(LINK)]
            entry = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
            if entry not in book.namelist():  # a chart sheet
                continue
            with book.open(entry) as stream:
                yield from ((sheet.get("name"), *cell) for cell in _sheet(stream, strings, dated, zero))


def _sheet(stream: io.BufferedIOBase, strings: list[str], dated: list[bool], zero: datetime) -> Iterator[tuple]:
    row, col = 0, 0
    above: list[ElementTree.Element] = []
    for event, node in ElementTree.iterparse(stream, ("start", "end")):
        if event == "start":
            above.append(node)
            if node.tag == MAIN + "row":
                row, col = int(node.get("r", row + 1)), 0
            continue
        above.pop()
        if node.tag == MAIN + "c":
            place = re.match("[A-Z]+", node.get("r", ""))
            col = column_number(place[0]) if place else col + 1
            found = _cell(node, strings, dated, zero)
            if found:
                yield (row, col, *found)
        if node.tag in (MAIN + "row", MAIN + "c") and above:
            above[-1].remove(node)  # what has been read is let go


def _cell(node: ElementTree.Element, strings: list[str], dated: list[bool], zero: datetime) -> tuple | None:
    kind, raw = node.get("t", "n"), node.findtext(MAIN + "v")
    if kind == "inlineStr":
        inside = node.find(MAIN + "is")
        return ("text", _plain_text(inside), None, None) if inside is not None else None
    if raw is None:
        return None
    if kind == "s":
        return "text", strings[int(raw)], None, None
    if kind in ("str", "d"):
        return "text", raw, None, None
    if kind == "e":
        return "error", raw, None, None
    if kind == "b":
        return "bool", "true" if raw == "1" else "false", float(raw), None
    number = float(raw)
    style = int(node.get("s", 0))
    if style < len(dated) and dated[style] and abs(number) < 3e6:
        at = zero + timedelta(seconds=round(number * 86400, 3))
        return "date", at.isoformat(sep=" "), number, at
    return "number", f"{number:g}" if number != int(number) or abs(number) > 1e15 else str(int(number)), number, None


def cells(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """A row for each cell of each sheet (``CELLS``), or one with an error for a file that is no workbook. A null content has none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in CELLS.split(", ")]
        for batch in batches:
            for name, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held: list[tuple] = []
                try:
                    for cell in workbook(data) if data is not None else ():
                        held.append((name, *cell, None))
                        if len(held) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _TYPES, strict=True)], names)
                            held = []
                except (zipfile.BadZipFile, KeyError, ValueError, IndexError, ElementTree.ParseError) as e:
                    held.append((name, *[None] * 7, f"{type(e).__name__}: {e}"))
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _TYPES, strict=True)], names)

    return files.select(F.col(path).cast("string").alias("path"), F.col(content).alias("content")).mapInArrow(run, CELLS)


def matched(text: Column, fragments: list[str]) -> Column:
    """Whether a header holds one of the fragments, letters and digits alone and without case."""
    plain = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")
    return F.exists(F.array(*[F.lit("".join(c for c in f.lower() if c.isalnum())) for f in fragments]), lambda f: F.contains(plain, f))


def table(found: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """Rows (path, sheet, row, and the wanted columns as text) below each sheet's header.

    ``found`` is ``cells``; ``wanted`` gives fragments of each column's header.
    The header is the first row of a sheet that has a text for every wanted
    column, where the leftmost that fits counts; a sheet without one has no
    rows. Rows without any wanted cell are left out.
    """
    texts = found.where("error is null and kind = 'text'")
    marks = texts.select("path", "sheet", "row", "col", *[matched(F.col("text"), f).alias(f"_{c}") for c, f in wanted.items()])
    each = marks.groupBy("path", "sheet", "row").agg(*[F.min(F.when(F.col(f"_{c}"), F.col("col"))).alias(f"_{c}") for c in wanted])
    full = each.dropna(subset=[f"_{c}" for c in wanted])
    first = Window.partitionBy("path", "sheet").orderBy("row")
    heads = full.withColumn("_i", F.row_number().over(first)).where("_i = 1").drop("_i").withColumnRenamed("row", "_head")
    below = found.where("error is null").join(heads, ["path", "sheet"]).where("row > _head")
    values = [F.max(F.when(F.col("col") == F.col(f"_{c}"), F.col("text"))).alias(c) for c in wanted]
    return below.groupBy("path", "sheet", "row").agg(*values).dropna(how="all", subset=list(wanted))

"""Workbooks and MAT files, made here."""

import io
import struct
import zipfile
import zlib
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparknorm.sources import matfile, sheets

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def book(rows_of, date1904=False, shared=("Participant ID", "AGE (years)", "Gender", "sub-1", " f ")):
    """A workbook of sheets of raw cell XML by name."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        listed = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(rows_of, 1))
        z.writestr("xl/workbook.xml", f'<workbook {NS}><workbookPr date1904="{int(date1904)}"/><sheets>{listed}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(rows_of) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(f'<si><r><t>{s[:2]}</t></r><r><t xml:space="preserve">{s[2:]}</t></r><rPh><t>no</t></rPh></si>' for s in shared) + "</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {NS}><numFmts><numFmt numFmtId="170" formatCode="[Red]0.0&quot; days&quot;"/><numFmt numFmtId="171" formatCode="yyyy\\-mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        for i, rows in enumerate(rows_of.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {NS}><sheetData>" + "".join(rows) + "</sheetData></worksheet>")
    return out.getvalue()


PEOPLE = [
    '<row r="1"><c r="A1" t="inlineStr"><is><t>Study</t></is></c></row>',
    '<row r="3"><c r="B3" t="s"><v>1</v></c><c r="C3" t="s"><v>0</v></c><c r="AA3" t="s"><v>2</v></c></row>',
    '<row r="4"><c r="B4"><v>9.5</v></c><c r="C4" t="s"><v>3</v></c><c r="AA4" t="s"><v>4</v></c></row>',
    '<row r="5"><c r="B5" s="1"><v>45000.25</v></c><c r="C5" t="str"><f>A1</f><v>sub-2</v></c></row>',
    '<row><c><v>1</v></c><c s="2"><v>12</v></c><c t="b"><v>1</v></c><c t="e"><v>#N/A</v></c></row>',
    '<row r="9"><c r="A9"><v>7</v></c><c r="B9" s="3"/></row>',
]


def test_types_of_cells():
    got = {(r, c): v for _, r, c, *v in sheets.workbook(book({"People": PEOPLE}))}
    assert got[1, 1] == ["text", "Study", None, None] and got[3, 27][1] == "Gender" and got[4, 2] == ["number", "9.5", 9.5, None]
    assert got[5, 2] == ["date", "2023-03-15 06:00:00", 45000.25, datetime(2023, 3, 15, 6)] and got[5, 3][1] == "sub-2"
    assert got[6, 1][1] == "1" and got[6, 2][0] == "number" and got[6, 3] == ["bool", "true", 1.0, None] and got[6, 4][0] == "error"
    assert (9, 2) not in got and len(got) == 14
    old = {(r, c): v for _, r, c, *v in sheets.workbook(book({"People": PEOPLE}, True))}
    assert old[5, 2][3] == datetime(2027, 3, 16, 6)
    assert sheets._is_date("[h]:mm") and sheets._is_date('"x"d') and not sheets._is_date("[Red]0.0") and not sheets._is_date('0" days"') and not sheets._is_date("General")


def test_tables_by_header(spark):
    many = ['<row><c t="s"><v>0</v></c><c t="s"><v>1</v></c><c t="s"><v>2</v></c></row>'] + [f"<row><c><v>{i}</v></c><c><v>{i / 2}</v></c></row>" for i in range(9000)]
    files = [("a.xlsx", book({"Notes": PEOPLE[:1], "People": PEOPLE})), ("b.xlsx", book({"Long": many})), ("bad.xlsx", b"PK no zip"), ("none.xlsx", None)]
    found = sheets.cells(spark.createDataFrame(files, "path string, content binary"))
    assert [r["path"] for r in found.where("error is not null").collect()] == ["bad.xlsx"]
    got = sheets.table(found, {"participant": ["participant", "subject"], "age": ["age"], "gender": ["gender", "sex"]})
    assert {(r["sheet"], r["row"], r["participant"], r["age"], r["gender"]) for r in got.where("path = 'a.xlsx'").collect()} == {("People", 4, "sub-1", "9.5", " f "), ("People", 5, "sub-2", "2023-03-15 06:00:00", None), ("People", 6, "true", "12", None)}
    assert got.where("path = 'b.xlsx'").count() == 9000 and got.where("path = 'b.xlsx' and age = cast(participant as int) / 2").count() == 9000


def element(kind, data):
    return struct.pack("<II", kind, len(data)) + data + bytes(-len(data) % 8)


def small(kind, data):
    return struct.pack("<HH", kind, len(data)) + data.ljust(4, b"\0") if 0 < len(data) <= 4 else element(kind, data)


def matrix(name, cls, dims, *body, flags=0):
    return element(14, element(6, struct.pack("<II", cls | flags, 0)) + element(5, struct.pack(f"<{len(dims)}i", *dims)) + small(1, name.encode()) + b"".join(body))


def text(name, value, rows=1):
    return matrix(name, 4, [rows, len(value) // rows], small(4, value.encode("utf-16-le")))


def record(name, dims, **fields):
    cells = list(zip(*[v if isinstance(v, list) else [v] for v in fields.values()], strict=True))
    return matrix(name, 2, dims, small(5, struct.pack("<i", 16)), element(1, b"".join(f.encode().ljust(16, b"\0") for f in fields)), *[c for row in cells for c in row])


def mat(*elements):
    return b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x100) + b"IM" + b"".join(elements)


def squeezed(e):
    packed = zlib.compress(e)
    return struct.pack("<II", 15, len(packed)) + packed


def recording():
    data = np.random.default_rng(1).standard_normal(200_000)
    places = record("", [1, 2], labels=[text("", "Fz"), text("", "Cz ")], X=[matrix("", 6, [1, 1], element(9, struct.pack("<d", 0.5))), matrix("", 6, [0, 0], element(9, b""))])
    return record("EEG", [1, 1], setname=text("", "rest"), data=matrix("", 6, [2, 100_000], element(9, data.tobytes())), chanlocs=places, srate=matrix("", 9, [1, 1], small(2, b"\x80")), comments=text("", "acbd", 2), empty=element(14, b""))


@pytest.mark.parametrize("pack", [lambda e: e, squeezed])
def test_walk(pack):
    rows = {n: (c, d, t, v) for n, c, d, t, v in matfile.walk(mat(pack(recording()), pack(matrix("list", 1, [1, 2], text("", "a"), matrix("", 7, [2, 2], element(7, struct.pack("<4f", 1, 2, 3, 4)))))))}
    assert rows["EEG.setname"] == ("char", [1, 4], "rest", None) and rows["EEG.srate"][3] == [128.0] and rows["EEG.data"] == ("double", [2, 100_000], None, None)
    assert rows["EEG.chanlocs[1].labels"][2] == "Cz " and rows["EEG.chanlocs[0].X"][3] == [0.5] and rows["EEG.chanlocs[1].X"][3] == [] and rows["EEG.empty"][1] == [0, 0]
    assert rows["EEG.comments"] == ("char", [2, 2], "ab\ncd", None)
    assert rows["list{0}"][2] == "a" and rows["list{1}"][3] == [1, 2, 3, 4] and rows["list"][0] == "cell"


def test_metadata_of_files(spark):
    whole = mat(squeezed(recording()))
    one = mat(record("EEG", [1, 1], chanlocs=record("", [1, 1], labels=text("", "Oz"))))
    files = [("a.set", whole), ("one.set", one), ("cut.set", whole[:-1000]), ("text.set", b"x" * 300), ("none.set", None)]
    rows = matfile.metadata(spark.createDataFrame(files, "path string, content binary"))
    assert sorted(r["path"] for r in rows.where("error is not null").collect()) == ["cut.set", "text.set"]
    labels = matfile.channel_labels(rows).orderBy("path", "ch_idx").collect()
    assert [tuple(r) for r in labels if r["path"] != "cut.set"] == [("a.set", 0, "Fz"), ("a.set", 1, "Cz"), ("one.set", 0, "Oz")]
    assert rows.where(F.col("name") == "EEG.setname").where("path = 'a.set'").first()["text"] == "rest"
    assert rows.where("error is null and path = 'none.set'").count() == 0

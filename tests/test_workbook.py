"""Workbooks, made by hand and written by the library."""

import datetime
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from sentograph.sources import workbook

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def book(sheets, strings="", styles="", old=False):
    """An archive from the XML of its sheets (name -> rows)."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as files:
        names = "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets, 1))
        files.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><workbookPr date1904="{int(old)}"/><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{k}" Target="{"/xl/" if k % 2 else ""}worksheets/s{k}.xml"/>' for k in range(1, len(sheets) + 1))
        files.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for k, rows in enumerate(sheets.values(), 1):
            files.writestr(f"xl/worksheets/s{k}.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{rows}</sheetData></worksheet>')
        if strings:
            files.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{strings}</sst>')
        if styles:
            files.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}">{styles}</styleSheet>')
    return out.getvalue()


STRINGS = "<si><t>name</t></si><si><t>when</t></si><si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si><si><t xml:space='preserve'> x &amp; y </t></si><si><t>n</t></si><si><t>ok</t></si>"
STYLES = "<numFmts><numFmt numFmtId='164' formatCode='yyyy\\-mm\\-dd'/><numFmt numFmtId='165' formatCode='0.00 &quot;days&quot;'/></numFmts><cellXfs><xf numFmtId='0'/><xf numFmtId='14'/><xf numFmtId='164'/><xf numFmtId='165'/></cellXfs>"
HEAD = "<row r='1'><c r='A1' t='s'><v>0</v></c><c r='B1' t='s'><v>1</v></c><c r='C1' t='s'><v>4</v></c><c r='D1' t='s'><v>5</v></c></row>"
ROWS = (
    HEAD + "<row r='2'><c r='A2' t='s'><v>2</v></c><c r='B2' s='1'><v>45292</v></c><c r='C2' s='3'><v>7</v></c><c r='D2' t='b'><v>1</v></c></row>"
    "<row r='4'><c r='A4' t='s'><v>3</v></c><c r='C4'><v>1.5E-3</v></c><c r='D4' t='e'><v>#N/A</v></c></row>"
    "<row r='5'><c r='B5' s='2'><v>45292.75</v></c></row><row r='6'/><row r='7'><c r='A7' t='str'><f>1</f><v>made</v></c><c r='D7' t='b'><v>0</v></c></row>"
)


def test_cells(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xlsx").write_bytes(book({"first": ROWS, "second": "<row><c t='inlineStr'><is><t>z</t></is></c></row><row><c><v>3</v></c></row>"}, STRINGS, STYLES))
    found = workbook.read_workbooks(spark, str(tmp_path / "in"))
    assert found.dtypes == [("name", "string"), ("when", "timestamp_ntz"), ("n", "double"), ("ok", "boolean")]
    day = datetime.datetime(2024, 1, 1)
    assert [tuple(r) for r in found.collect()] == [("rich", day, 7.0, True), (" x & y ", None, 0.0015, None), (None, day.replace(hour=18), None, None), ("made", None, None, False)]
    assert workbook.read_workbooks(spark, str(tmp_path / "in"), sheet="second").collect()[0][:] == (3,)
    given = workbook.read_workbooks(spark, str(tmp_path / "in"), "n string, when date, more int")
    assert [tuple(r) for r in given.collect()][:2] == [("7", day.date(), None), ("0.0015", None, None)]
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "a.xlsx").write_bytes(book({"s": ROWS}, STRINGS, STYLES, old=True))
    assert workbook.read_workbooks(spark, str(tmp_path / "old")).first()["when"] == day + datetime.timedelta(days=1462)


def test_odd_workbooks(spark, tmp_path):
    for name, rows in (("twice", HEAD.replace("<v>1</v>", "<v>0</v>")), ("gap", "<row><c r='A1' t='s'><v>0</v></c><c r='C1' t='s'><v>1</v></c></row>")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.xlsx").write_bytes(book({"s": rows}, STRINGS))
        with pytest.raises(Exception, match="empty or repeated name"):
            workbook.read_workbooks(spark, str(tmp_path / name)).collect()
    (tmp_path / "mixed").mkdir()
    (tmp_path / "mixed" / "a.xlsx").write_bytes(workbook.workbook(["a", "b"], [(1, "x"), (2, None)]))
    (tmp_path / "mixed" / "b.xlsx").write_bytes(workbook.workbook(["c", "a"], [(True, "t"), (None, 2.5)]))
    (tmp_path / "mixed" / "c.xlsx").write_bytes(workbook.workbook([], []))
    (tmp_path / "mixed" / "other.txt").write_text("no workbook")
    found = workbook.read_workbooks(spark, str(tmp_path / "mixed"))
    assert sorted(map(str, (tuple(r[c] for c in "abc") for r in found.collect()))) == sorted(map(str, [("1", "x", None), ("2", None, None), ("t", None, True), ("2.5", None, None)]))


def test_round_trip(spark, tmp_path):
    stamp = datetime.datetime(2001, 2, 3, 4, 5, 6, 789000)
    rows = [(i, i / 7, f"t{i} <&> \u00e9\n" if i % 3 else None, bool(i % 2), stamp + datetime.timedelta(hours=i)) for i in range(25)]
    frame = spark.createDataFrame(rows, "i long, x double, t string, b boolean, s timestamp_ntz").repartition(2)
    files = workbook.write_workbooks(frame, str(tmp_path / "out"), 10).collect()
    assert sum(r["rows"] for r in files) == 25 and all(r["rows"] <= 10 for r in files)
    back = workbook.read_workbooks(spark, str(tmp_path / "out"))
    assert back.dtypes == frame.dtypes and sorted(tuple(r) for r in back.collect() if r["t"]) == sorted(r for r in rows if r[2]) and back.where(F.col("t").isNull()).count() == 9
    with pytest.raises(ValueError):
        workbook.write_workbooks(frame, str(tmp_path / "out"), workbook.MOST_ROWS)


def test_rows_are_read_and_written_without_an_object_a_cell(monkeypatch):
    """A sheet makes no tree of its cells, and equal texts and times are made once; formulas, comments, phonetic runs, gaps and empty values as before."""
    import pyarrow as pa

    inline = "<c t='inlineStr'><is><r><t>a</t></r><rPh><t>no</t></rPh><r><t> b</t></r></is></c>"
    rows = HEAD + f"<row>{inline}<c r='C2'><f>1+1</f><v>2<!-- x --></v></c><c t='str'><v/></c></row><row><c t='str'><v><![CDATA[<&>]]></v></c><c t='inlineStr'><is/></c><c><v>-12</v></c><c/></row>"
    monkeypatch.setattr(workbook.ElementTree, "iterparse", None)
    found = workbook.Book(book({"s": rows}, STRINGS, STYLES)).rows(None)
    assert list(found) == [["name", "when", "n", "ok"], ["a b", None, 2, None], ["<&>", "", -12, None]]
    values = [None, "x&y", "x&y", "z"] * 50
    stamps = [None, datetime.datetime(2020, 1, 1)] * 100
    want = [workbook._line(map(workbook._cell, r)) for r in zip(values, stamps)]
    made, one = [], workbook._cell
    monkeypatch.setattr(workbook, "_cell", lambda x: made.append(x) or one(x))
    assert [workbook._line(r) for r in zip(workbook._cells(pa.array(values)), workbook._cells(pa.array(stamps)))] == want
    assert len(made) == 5

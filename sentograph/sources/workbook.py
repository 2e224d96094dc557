"""Workbooks (.xlsx): a folder or file of them as a table, and a table as a folder of them.

A sheet holds at most 1,048,576 rows by its format, so a file is what a task takes: Spark lists and reads the files, a task streams the sheet's XML out of the archive and gives
rows on in Arrow batches. Rows of several files are one table, by the names in their first rows.

Defined results: an empty cell, an error value and a missing cell at a row's end are null; a date is a timestamp without zone; numbers that are whole in all rows are
longs, else doubles; a column of several kinds is text; a column without values is text of nulls; a header that is empty or there twice is an error; a file without rows adds none.
"""

from __future__ import annotations

import datetime
import io
import re
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from itertools import chain, islice
from xml.etree import ElementTree
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: rows of a sheet at most, namespaces, and the numbers of the built-in date formats.
MOST_ROWS = 1_048_576
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_DATES = frozenset((*range(14, 23), *range(27, 37), 45, 46, 47, *range(50, 59)))
#: Rows of an Arrow batch.
BATCH = 4096
_BOOK, _REL = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _text(node) -> str:
    """The text of a string item, whose runs may have formats of their own; phonetic runs don't count."""
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t")) if node.find(f"{_MAIN}rPh") is None else "".join(t.text or "" for r in node if r.tag in (f"{_MAIN}r", f"{_MAIN}t") for t in r.iter(f"{_MAIN}t"))


#: Bytes of a sheet's XML at a time, and the tags in it that count, as the parser calls them.
_CHUNK = 1 << 16
_ROW, _C, _V, _IS, _T, _PHONETIC = (_MAIN[1:] + x for x in ("row", "c", "v", "is", "t", "rPh"))
_whole = re.compile(r"-?\d{1,18}").fullmatch


def _column(letters: str) -> int:
    """The number of a cell's column from 0, from the letters of a reference such as AB12."""
    n = 0
    for c in re.match("[A-Z]+", letters)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


class Book:
    """An archive's sheets, strings and formats."""

    def __init__(self, content: bytes):
        self.files = zipfile.ZipFile(io.BytesIO(content))
        book = self._xml("xl/workbook.xml")
        links = {r.get("Id"): r.get("Target") for r in self._xml("xl/_rels/workbook.xml.rels")}
        self.sheets = {s.get("name"): "xl/" + links[s.get(_RELATION)].removeprefix("/xl/") for s in book.iter(f"{_MAIN}sheet")}
        old = next(book.iter(f"{_MAIN}workbookPr"), None)
        self.first_day = datetime.datetime(1904, 1, 1) if old is not None and old.get("date1904") in ("1", "true") else datetime.datetime(1899, 12, 30)
        names = set(self.files.namelist())
        self.strings = [_text(x) for x in self._xml("xl/sharedStrings.xml").iter(f"{_MAIN}si")] if "xl/sharedStrings.xml" in names else []
        self.dates: list[bool] = []
        if "xl/styles.xml" in names:
            styles = self._xml("xl/styles.xml")
            own = {int(f.get("numFmtId")): bool(re.search("[dmyhs]", re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", f.get("formatCode").lower()))) for f in styles.iter(f"{_MAIN}numFmt")}
            cells = styles.find(f"{_MAIN}cellXfs")
            self.dates = [own.get(n := int(x.get("numFmtId", 0)), n in _DATES) for x in (cells if cells is not None else ())]

    def _xml(self, name: str):
        return ElementTree.fromstring(self.files.read(name))

    def _value(self, cell: dict, text: str | None):
        """The value of a cell from its attributes and its text, None if it has none."""
        kind = cell.get("t", "n")
        if kind == "inlineStr":
            return text
        if not text or kind == "e":
            return None
        if kind in ("s", "str"):
            return self.strings[int(text)] if kind == "s" else text
        if kind == "b":
            return text == "1"
        if kind == "d":
            return datetime.datetime.fromisoformat(text)
        style = int(cell.get("s", 0))
        if style < len(self.dates) and self.dates[style]:
            return self.first_day + datetime.timedelta(milliseconds=round(float(text) * 86_400_000))
        return int(text) if _whole(text) else float(text)

    def rows(self, sheet: str | None) -> Iterator[list]:
        """The values of each row of a sheet (None: the first), cells that are missing as None; the XML is read as it goes."""
        name = next(iter(self.sheets.values())) if sheet is None else self.sheets[sheet]
        done: list[list] = []
        row: list = []
        cell, text, phonetic = None, None, 0
        columns: dict[str, int] = {}
        parser = expat.ParserCreate(namespace_separator="}")
        parser.buffer_text = True

        def start(tag, attributes):
            nonlocal row, cell, text, phonetic
            if tag == _C:
                cell, text = attributes, None
            elif tag == _V or tag == _T:
                if not phonetic and cell is not None and (tag == _T) == (cell.get("t") == "inlineStr"):
                    text = text or ""
                    parser.CharacterDataHandler = more
            elif tag == _IS:
                text = ""
            elif tag == _ROW:
                row = []
            elif tag == _PHONETIC:
                phonetic += 1

        def more(data):
            nonlocal text
            text += data

        def end(tag):
            nonlocal cell, phonetic
            if tag == _V or tag == _T:
                parser.CharacterDataHandler = None
            elif tag == _C:
                if at := cell.get("r"):
                    letters = at.rstrip("0123456789")
                    if letters not in columns:
                        columns[letters] = _column(letters)
                    row.extend([None] * (columns[letters] - len(row)))
                row.append(self._value(cell, text))
                cell = None
            elif tag == _ROW:
                done.append(row)
            elif tag == _PHONETIC:
                phonetic -= 1

        parser.StartElementHandler, parser.EndElementHandler = start, end
        with self.files.open(name) as stream:
            while chunk := stream.read(_CHUNK):
                parser.Parse(chunk, False)
                yield from done
                done.clear()
            parser.Parse(b"", True)
            yield from done


_KINDS = {bool: "boolean", int: "long", float: "double", datetime.datetime: "timestamp_ntz"}


def _named(content: bytes, sheet: str | None, path: str) -> tuple[list[str], Iterator[list]]:
    """(names, rows that are as long) of a file: its first row is the header."""
    rows = Book(content).rows(sheet)
    names = next(rows, [])
    if None in names or "" in names or len({str(n) for n in names}) < len(names):
        raise ValueError(f"{path}: the header has an empty or repeated name")
    return [str(n) for n in names], ((r + [None] * (len(names) - len(r)))[: len(names)] for r in rows if any(x is not None for x in r))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path).select("path", "content")


def inferred(spark: SparkSession, path: str, sheet: str | None = None) -> str:
    """The columns of the workbooks and their kinds, over all rows, in order of the names."""

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                names, rows = _named(content.as_py(), sheet, file)
                found: list[set] = [set() for _ in names]
                while some := list(islice(rows, BATCH)):
                    for own, column in zip(found, zip(*some)):
                        own.update(map(type, column))
                pairs = [(n, None if k is type(None) else _KINDS.get(k, "string"), at) for at, n in enumerate(names) for k in (found[at] or {type(None)})]
                yield pa.RecordBatch.from_pydict({"name": [p[0] for p in pairs], "kind": pa.array([p[1] for p in pairs], pa.string()), "at": pa.array([p[2] for p in pairs], pa.int32())})

    rows = _files(spark, path).mapInArrow(kinds, "name string, kind string, at int").groupBy("name").agg(F.collect_set("kind").alias("kinds"), F.min("at").alias("at")).orderBy("at", "name").collect()
    one = lambda k: k.pop() if len(k) == 1 else "double" if k == {"long", "double"} else "string"
    return ", ".join(f"`{r['name'].replace('`', '``')}` {one(set(r['kinds']))}" for r in rows)


def read_workbooks(spark: SparkSession, path: str, schema: str | None = None, sheet: str | None = None) -> DataFrame:
    """The rows of all .xlsx files under a path. schema: columns and kinds (None: inferred, which reads the files once more); columns that a file lacks are null."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = schema or inferred(spark, path, sheet)
    own = StructType.fromDDL(schema)
    kinds = to_arrow_schema(own)

    def fitting(x, kind):
        if x is None:
            return None
        if pa.types.is_string(kind):
            return x if isinstance(x, str) else ("true" if x else "false") if isinstance(x, bool) else str(x)
        if pa.types.is_date(kind):
            return x.date()
        return float(x) if pa.types.is_floating(kind) else x

    fits = lambda kind: pa.types.is_string(kind) or pa.types.is_date(kind) or pa.types.is_floating(kind)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                names, rows = _named(content.as_py(), sheet, file)
                place = [names.index(f.name) if f.name in names else None for f in kinds]
                while some := list(islice(rows, BATCH)):
                    own = list(zip(*some))
                    columns = [pa.nulls(len(some), f.type) if p is None else pa.array([fitting(x, f.type) for x in own[p]] if fits(f.type) else own[p], f.type) for p, f in zip(place, kinds)]
                    yield pa.RecordBatch.from_arrays(columns, schema=kinds)

    return _files(spark, path).mapInArrow(read, schema)


_STYLES = f'<styleSheet xmlns="{_BOOK}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>'
_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook xmlns="{_BOOK}" xmlns:r="{_REL}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{_REL}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{_REL}/styles" Target="styles.xml"/></Relationships>',
    "xl/styles.xml": _STYLES,
}


def _cell(x) -> str:
    if x is None:
        return "<c/>"
    if isinstance(x, bool):
        return f'<c t="b"><v>{int(x)}</v></c>'
    if isinstance(x, (int, float)):
        return f"<c><v>{x!r}</v></c>" if abs(x) <= 2**53 or isinstance(x, float) else f'<c t="inlineStr"><is><t>{x}</t></is></c>'
    if isinstance(x, datetime.date):
        at = x if isinstance(x, datetime.datetime) else datetime.datetime(x.year, x.month, x.day)
        return f'<c s="1"><v>{(at.replace(tzinfo=None) - datetime.datetime(1899, 12, 30)) / datetime.timedelta(days=1)!r}</v></c>'
    return f'<c t="inlineStr"><is><t xml:space={quoteattr("preserve")}>{escape(str(x))}</t></is></c>'


def _cells(column: pa.Array) -> list[str]:
    """The cells of a column; texts and times that are there several times are made once."""
    values, kind = column.to_pylist(), column.type
    if pa.types.is_string(kind) or pa.types.is_timestamp(kind) or pa.types.is_date(kind):
        made = {x: _cell(x) for x in set(values)}
        return [made[x] for x in values]
    return [_cell(x) for x in values]


def _line(cells: Iterable[str]) -> str:
    return f"<row>{''.join(cells)}</row>"


def workbook(names: list[str], rows) -> bytes:
    """A workbook of one sheet with a header."""
    return _archive(names, (_line(map(_cell, row)) for row in rows))


def _archive(names: list[str], lines: Iterable[str]) -> bytes:
    """The workbook of a header and the XML of its rows."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as files:
        for name, text in _PARTS.items():
            files.writestr(name, text)
        with files.open("xl/worksheets/sheet1.xml", "w") as sheet:
            sheet.write(f'<worksheet xmlns="{_BOOK}"><sheetData>'.encode())
            lines = chain([_line(map(_cell, names))], lines)
            while some := list(islice(lines, 256)):
                sheet.write("".join(some).encode())
            sheet.write(b"</sheetData></worksheet>")
    return out.getvalue()


def write_workbooks(df: DataFrame, folder: str, rows: int = 100_000) -> DataFrame:
    """Writes the rows as .xlsx files of at most ``rows`` into the folder, some for each task; returns (file, rows) of them. Nothing is written before that is read.

    A file is written under a name of its own and then moved, so a task that runs twice leaves whole files of the same names."""
    if not 0 < rows < MOST_ROWS:
        raise ValueError(f"a sheet has from 1 to {MOST_ROWS - 1} rows and a header")
    names = df.columns

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        files, at = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        files.create_dir(at, recursive=True)
        part, held, nth = TaskContext.get().partitionId(), [], 0

        def flush(some):
            nonlocal nth
            name, draft = f"{at}/part-{part:06d}-{nth:04d}.xlsx", f"{at}/.{uuid.uuid4().hex}.draft"
            nth += 1
            with files.open_output_stream(draft) as out:
                out.write(_archive(names, some))
            files.move(draft, name)
            return pa.RecordBatch.from_pydict({"file": [name], "rows": pa.array([len(some)], pa.int64())})

        for batch in batches:
            held += map(_line, zip(*map(_cells, batch.columns)))
            while len(held) >= rows:
                yield flush(held[:rows])
                held = held[rows:]
        if held:
            yield flush(held)

    return df.mapInArrow(write, "file string, rows long")

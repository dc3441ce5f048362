"""Workbooks (Office Open XML, .xlsx and .xlsm) as a Spark data source.

``register(spark)`` makes the format ``workbook`` known. Reading gives one row for each
row of a sheet, whatever its columns are, so that no schema has to be found on the driver:

    file, sheet, row (0: the header), cells: map of column name to (kind, text)

Each sheet is a partition; its XML is parsed as a stream, only shared strings are held.
``read_workbook`` turns these rows into a table: names and kinds of columns come from one
aggregation over all sheets, so files of a folder may differ in their columns. Files are
opened by pyarrow's file systems; where it has none for a path, Spark reads the bytes.

The first row of a sheet names its columns, from the first used column to the last: a missing name
is ``__EMPTY``, a repeated one gets ``_1``, ``_2`` and so on. Rows without any value are left
out, error cells are empty, dates are serial numbers, empty texts are null.
"""

from __future__ import annotations

import io
import os
import re
import uuid
import zipfile
from collections.abc import Callable, Iterator
from decimal import Decimal
from itertools import chain, islice
from urllib.parse import unquote, urlsplit
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import BooleanType, NumericType, StructType

ENDINGS = (".xlsx", ".xlsm")
#: Files over which sheets are not listed on the driver: a task then reads all sheets of its file.
MANY_FILES = 1000
#: Rows of a batch that a task passes on.
BATCH = 1000
#: Rows of a sheet that is written, at most; this many fit the file format, with a header.
SHEET_ROWS = 1_048_575

SCHEMA = "file string, sheet string, row long, cells map<string, struct<kind: string, text: string>>"
SHEETS = "file string, sheet string, position int"
_ARROW = pa.schema([("file", pa.string()), ("sheet", pa.string()), ("row", pa.int64()), ("cells", pa.map_(pa.string(), pa.struct([("kind", pa.string()), ("text", pa.string())])))])

# ---- the file format

_COLUMN = re.compile(rb'<(?:\w+:)?c [^>]*?\br="([A-Z]{1,3})')
_CELL = re.compile(rb"<(?:\w+:)?c(?=[\s/]|$)|<(?:\w+:)?c>")
_ESCAPED = re.compile(r"_x([0-9A-Fa-f]{4})_")


def _tag(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def _attribute(element: ElementTree.Element, name: str) -> str | None:
    """An attribute, with or without a namespace."""
    return next((v for k, v in element.attrib.items() if k.rpartition("}")[2] == name), None)


def _place(letters: str) -> int:
    """A column's number, from 0, by its letters."""
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n - 1


def _letters(place: int) -> str:
    out = ""
    place += 1
    while place:
        place, rest = divmod(place - 1, 26)
        out = chr(65 + rest) + out
    return out


def number_text(x: float) -> str:
    """A number as text: whole ones without a point, no exponent between 1e-6 and 1e21."""
    if x == int(x) and abs(x) < 2**53:
        return str(int(x))
    if 1e-6 <= abs(x) < 1e21:
        return format(Decimal(repr(x)), "f").removesuffix(".0")
    return re.sub(r"e([+-])0", r"e\1", repr(x))


def _unescaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), text) if "_x" in text else text


def _text(element: ElementTree.Element) -> str:
    """All runs of a rich text, without what tells its pronunciation."""
    return _unescaped("".join(t.text or "" for part in ([element] if _tag(element) == "t" else element) if _tag(part) in ("t", "r") for t in ([part] if _tag(part) == "t" else part) if _tag(t) == "t"))


class Workbook:
    """One open workbook: ``sheets`` in order, by name, and the rows of each as a stream."""

    def __init__(self, file: io.BufferedIOBase, name: str = ""):
        self.name = name
        try:
            self.zip = zipfile.ZipFile(file)
            book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
            links = ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
            raise ValueError(f"not a workbook: {name}") from e
        parts = {_attribute(r, "Id"): _attribute(r, "Target") or "" for r in links}
        listed = [(s.get("name") or "", next((v for k, v in s.attrib.items() if k.endswith("}id")), None)) for s in book.iter() if _tag(s) == "sheet"]
        where = {n: parts.get(i, "") for n, i in listed}
        inside = set(self.zip.namelist())
        self.sheets = {n: p for n, t in where.items() if (p := t.lstrip("/") if t.startswith("/") else f"xl/{t}") in inside and "worksheets" in p}
        self._strings: list[str] | None = None

    def strings(self) -> list[str]:
        """The workbook's shared strings."""
        if self._strings is None:
            self._strings = []
            if "xl/sharedStrings.xml" in self.zip.namelist():
                with self.zip.open("xl/sharedStrings.xml") as f:
                    for _, e in ElementTree.iterparse(f):
                        if _tag(e) == "si":
                            self._strings.append(_text(e))
                            e.clear()
        return self._strings

    def _columns(self, part: str) -> tuple[int, int]:
        """First and last used column: those of the stated dimension and of all cells; (0, -1) of an empty sheet."""
        found, seen, unnamed, rest = set(), False, 0, b""
        with self.zip.open(part) as f:
            while chunk := f.read(1 << 20):
                chunk, _, rest = (rest + chunk).rpartition(b">")
                if not seen and (stated := re.search(rb'<(?:\w+:)?dimension [^>]*?ref="([A-Z]+)\d+:([A-Z]+)\d+"', chunk)):
                    seen = True
                    found.update(stated.groups())
                at = _COLUMN.findall(chunk)
                found.update(at)
                unnamed += len(_CELL.findall(chunk)) - len(at)
        if unnamed:  # cells that do not say where they are stand behind the one before
            found.update(_letters(k).encode() for _, cells in self.rows(part) for k in cells)
        places = [_place(x.decode()) for x in found]
        return (min(places), max(places)) if places else (0, -1)

    def _cell(self, c: ElementTree.Element) -> tuple[str, str] | None:
        """Kind (n: number, b: truth value, s: text) and text; None of an empty or an error cell."""
        kind, value = c.get("t", "n"), next((e for e in c if _tag(e) in ("v", "is")), None)
        if value is None or kind == "e":
            return None
        if kind == "inlineStr" or _tag(value) == "is":
            return "s", _text(value)
        text = value.text or ""
        if kind == "s":
            return "s", self.strings()[int(text)]
        if kind == "b":
            return "b", "true" if text.strip() in ("1", "true") else "false"
        if kind in ("str", "d"):
            return "s", _unescaped(text)
        return ("n", number_text(float(text))) if text.strip() else None

    def rows(self, part: str) -> Iterator[tuple[int, dict[int, tuple[str, str]]]]:
        """Number (from 0) and cells, by column number, of each stated row of a sheet's part; cells with empty text are left out."""
        row, cells, at = -1, {}, -1
        with self.zip.open(part) as f:
            for event, e in ElementTree.iterparse(f, events=("start", "end")):
                tag = _tag(e)
                if event == "start" and tag == "row":
                    row, cells, at = int(e.get("r", row + 2)) - 1, {}, -1
                elif event == "end" and tag == "c":
                    stated = re.match("[A-Z]+", e.get("r", ""))
                    at = _place(stated[0]) if stated else at + 1
                    if (cell := self._cell(e)) is not None and cell[1] != "":
                        cells[at] = cell
                elif event == "end" and tag == "row":
                    yield row, cells
                    e.clear()
                elif event == "end" and tag == "sheetData":
                    e.clear()

    def records(self, sheet: str, row_limit: int | None = None) -> Iterator[tuple[int, dict[str, tuple[str, str]]]]:
        """Rows by names of columns. First row 0, where each name has kind ``#`` and its place; then each row with a value, with its number."""
        if sheet not in self.sheets:
            raise ValueError(f"no sheet {sheet!r} in {self.name}")
        first, last = self._columns(self.sheets[sheet])
        names: list[str] | None = None
        n = 0
        for number, cells in self.rows(self.sheets[sheet]):
            if names is None:
                names = header([cells[k][1] if number == 0 and k in cells else None for k in range(first, last + 1)])
                yield 0, {name: ("#", str(k)) for k, name in enumerate(names)}
                if number == 0:
                    continue
            if cells:
                n += 1
                if row_limit is not None and n > row_limit:
                    raise ValueError(f"sheet {sheet!r} of {self.name} has more than {row_limit:,} rows")
                yield number, {names[k - first]: v for k, v in cells.items()}


def header(found: list[str | None]) -> list[str]:
    """Names of columns: ``__EMPTY`` where there is none, and a number behind a name that is taken."""
    used: dict[str, int] = {}
    out = []
    for name in found:
        name = "__EMPTY" if name is None else name
        new, k = name, used.get(name, 0)
        if k:
            while (new := f"{name}_{k}") in used:
                k += 1
            used[name] = k + 1
        used.setdefault(new, 1)
        out.append(new)
    return out


# ---- files


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path) if parts.scheme else path
    return fs.FileSystem.from_uri(path)


def _files(path: str) -> list[str]:
    """Workbooks at a path: the file itself, or those in a folder, by name; hidden and temporary ones are left out."""
    system, place = _file_system(path)
    info = system.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    found = sorted(x.path for x in system.get_file_info(fs.FileSelector(place, recursive=True)) if x.is_file and x.path.lower().endswith(ENDINGS))
    base = place.rstrip("/")
    inner = [f[len(base) + 1 :] for f in found]
    shown = [f"{path.rstrip('/')}/{f}" for f in inner if not any(p[0] in "._~" for p in f.split("/"))]
    if not shown:
        raise FileNotFoundError(f"no workbooks in {path}")
    return shown


def _open(path: str, max_bytes: int | None) -> Workbook:
    system, place = _file_system(path)
    if max_bytes is not None and system.get_file_info(place).size > max_bytes:
        raise ValueError(f"{path} is larger than {max_bytes:,} bytes")
    return Workbook(system.open_input_file(place), path)


def _batches(book: Workbook, file: str, sheets: list[str], row_limit: int | None) -> Iterator[pa.RecordBatch]:
    for sheet in sheets:
        held: list[tuple[int, dict]] = []

        def batch(sheet=sheet) -> pa.RecordBatch:
            cells = [[(k, {"kind": kind, "text": text}) for k, (kind, text) in c.items()] for _, c in held]
            return pa.RecordBatch.from_arrays([pa.array([file] * len(held)), pa.array([sheet] * len(held)), pa.array([n for n, _ in held], pa.int64()), pa.array(cells, _ARROW.field("cells").type)], schema=_ARROW)

        for record in book.records(sheet, row_limit):
            held.append(record)
            if len(held) >= BATCH:
                yield batch()
                held.clear()
        if held:
            yield batch()


class _Sheet(InputPartition):
    """One sheet of one file; without a name, all sheets."""

    def __init__(self, file: str, sheet: str | None):
        self.file, self.sheet = file, sheet


class WorkbookReader(DataSourceReader):
    """Options: path, sheet (a name; else all sheets), rowLimit (a sheet with more rows is an error), maxBytes (a larger file is), list (true: one row for each sheet)."""

    def __init__(self, options: dict):
        self.path, self.sheet = options["path"], options.get("sheet")
        self.row_limit, self.max_bytes = (int(v) if (v := options.get(k)) else None for k in ("rowLimit", "maxBytes"))
        self.list = str(options.get("list", "")).lower() == "true"

    def partitions(self) -> list[_Sheet]:
        files = _files(self.path)
        if self.list or self.sheet is not None or len(files) > MANY_FILES:
            return [_Sheet(f, self.sheet) for f in files]
        return [_Sheet(f, s) for f in files for s in _open(f, self.max_bytes).sheets]

    def read(self, partition: _Sheet) -> Iterator[pa.RecordBatch] | Iterator[tuple]:
        if partition is None:
            return iter(())
        book = _open(partition.file, self.max_bytes)
        if self.list:
            return iter([(partition.file, s, k) for k, s in enumerate(book.sheets)])
        return _batches(book, partition.file, [partition.sheet] if partition.sheet is not None else list(book.sheets), self.row_limit)


class _Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WorkbookWriter(DataSourceWriter):
    """Each task writes workbooks below the path under hidden names; the commit gives them their own. Options: path, sheet (default Sheet1), sheetRows.

    Rows over those that one sheet holds go to a further workbook, so that all of them are in sheets of the same name.
    """

    def __init__(self, options: dict, schema: StructType):
        self.path, self.sheet = options["path"], options.get("sheet", "Sheet1")
        self.sheet_rows = int(options.get("sheetRows", SHEET_ROWS))
        self.names, self.run = schema.names, uuid.uuid4().hex[:12]
        self.kinds = ["n" if isinstance(f.dataType, NumericType) else "b" if isinstance(f.dataType, BooleanType) else "s" for f in schema.fields]

    def write(self, iterator: Iterator) -> _Written:
        system, place = _file_system(self.path)
        done: list[str] = []
        while (first := next(iterator, None)) is not None:
            system.create_dir(place, recursive=True)
            name = f"part-{self.run}-{uuid.uuid4().hex[:12]}.xlsx"
            with system.open_output_stream(f"{place}/.{name}") as out:
                write_rows(out, self.names, self.kinds, chain([first], islice(iterator, self.sheet_rows - 1)), self.sheet)
            done.append(name)
        return _Written(done)

    def commit(self, messages: list) -> None:
        system, place = _file_system(self.path)
        for m in messages:
            for name in m.names if m else []:
                system.move(f"{place}/.{name}", f"{place}/{name}")

    def abort(self, messages: list) -> None:
        system, place = _file_system(self.path)
        if system.get_file_info(place).type == fs.FileType.Directory:
            for x in system.get_file_info(fs.FileSelector(place)):
                if os.path.basename(x.path).startswith(f".part-{self.run}-"):
                    system.delete_file(x.path)


def _escaped(text: str) -> str:
    """Text for XML; characters that it can't hold, and what looks like their escape, are written as _xHHHH_."""
    text = re.sub(r"[\x00-\x08\x0b-\x1f\ufffe\uffff\r]|_(?=x[0-9A-Fa-f]{4}_)", lambda m: f"_x{ord(m[0]):04X}_", text)
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'


def write_rows(out: io.RawIOBase, names: list[str], kinds: list[str], rows: Iterator, sheet: str = "Sheet1", sheet_rows: int = SHEET_ROWS) -> None:
    """A workbook of plain values as a stream; rows over ``sheet_rows`` go to further sheets. A blank name gets no header cell."""

    def cell(k: int, n: int, kind: str, v) -> str:
        at = f'<c r="{_letters(k)}{n}"'
        if v is None:
            return ""
        if kind == "n" and v == v and abs(v) != float("inf"):
            return f"{at}><v>{v}</v></c>"
        return f'{at} t="b"><v>{int(v)}</v></c>' if kind == "b" else f'{at} t="inlineStr"><is><t xml:space="preserve">{_escaped(str(v))}</t></is></c>'

    sheets: list[str] = []
    head = '<row r="1">' + "".join(cell(k, 1, "s", n) for k, n in enumerate(names) if n.strip()) + "</row>"
    row = next(rows, None)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        while row is not None or not sheets:
            sheets.append(sheet if not sheets else f"{sheet[:25]} {len(sheets) + 1}")
            with z.open(f"xl/worksheets/sheet{len(sheets)}.xml", "w", force_zip64=True) as f:
                f.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>{head}'.encode())
                n = 1
                while row is not None and n <= sheet_rows:
                    n += 1
                    f.write((f'<row r="{n}">' + "".join(cell(k, n, kind, v) for k, (kind, v) in enumerate(zip(kinds, row, strict=True))) + "</row>").encode())
                    row = next(rows, None)
                f.write(b"</sheetData></worksheet>")
        ids = range(1, len(sheets) + 1)
        z.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_LINKS}"><sheets>' + "".join(f'<sheet name="{_escaped(s).replace(chr(34), "&quot;")}" sheetId="{k}" r:id="rId{k}"/>' for k, s in zip(ids, sheets, strict=True)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="{_LINKS}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in ids) + "</Relationships>")
        z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k in ids) + "</Types>")


# ---- Spark


class WorkbookSource(DataSource):
    """The format ``workbook``."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SHEETS if str(self.options.get("list", "")).lower() == "true" else SCHEMA

    def reader(self, schema: StructType) -> WorkbookReader:
        return WorkbookReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WorkbookWriter:
        if overwrite:
            raise ValueError("workbooks are only added to a folder")
        return WorkbookWriter(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkbookSource)


def _reachable(path: str) -> bool:
    try:
        _file_system(path)
    except (ValueError, OSError, pa.ArrowInvalid, pa.ArrowNotImplementedError):
        return False
    return True


def _by_bytes(listing: bool, sheet: str | None, row_limit: int | None, max_bytes: int | None) -> Callable:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data = content.as_buffer()
                if max_bytes is not None and data.size > max_bytes:
                    raise ValueError(f"{path} is larger than {max_bytes:,} bytes")
                book = Workbook(pa.BufferReader(data), path)
                if listing:
                    yield pa.RecordBatch.from_pylist([{"file": path, "sheet": s, "position": k} for k, s in enumerate(book.sheets)], schema=pa.schema([("file", pa.string()), ("sheet", pa.string()), ("position", pa.int32())]))
                else:
                    yield from _batches(book, path, [sheet] if sheet is not None else list(book.sheets), row_limit)

    return read


def _load(spark: SparkSession, path: str, listing: bool, sheet: str | None = None, row_limit: int | None = None, max_bytes: int | None = None) -> DataFrame:
    if _reachable(path):
        register(spark)
        options = {"list": str(listing).lower(), "sheet": sheet, "rowLimit": row_limit, "maxBytes": max_bytes}
        return spark.read.format("workbook").options(**{k: v for k, v in options.items() if v is not None}).load(path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xls[xm]").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInArrow(_by_bytes(listing, sheet, row_limit, max_bytes), SHEETS if listing else SCHEMA)


def list_sheets(spark: SparkSession, path: str) -> DataFrame:
    """file, sheet, position: every sheet of a workbook or of all workbooks in a folder."""
    return _load(spark, path, True)


def sheet_rows(spark: SparkSession, path: str, sheet: str | None = None, row_limit: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """file, sheet, row, cells of one sheet or all; row 0 holds the names. A sheet of more than ``row_limit`` rows or a file of more than ``max_bytes`` is an error, not cut."""
    return _load(spark, path, False, sheet, row_limit, max_bytes)


def _typed(name: str, kinds: set[str]) -> Column:
    text = F.col("cells")[F.lit(name)]["text"]
    if kinds == {"n"}:
        return text.cast("double")
    return text.cast("boolean") if kinds == {"b"} else text


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None, row_limit: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """The rows of a sheet as a table, or of the same sheet (or all sheets) of every workbook in a folder, joined by names of columns.

    A column of numbers alone is double, one of truth values alone is boolean, all others
    are text. Columns stand in the order in which the first file (by name) has them, new ones of later files behind
    them. A sheet without rows has its columns and no rows; without any cell, an error.
    """
    rows = sheet_rows(spark, path, sheet, row_limit, max_bytes)
    cells = rows.select("file", "sheet", "row", F.explode("cells").alias("name", "cell"))
    place = F.min(F.when(F.col("row") == 0, F.struct("file", "sheet", F.col("cell.text").cast("int").alias("k"))))
    found = cells.groupBy("name").agg(place.alias("place"), F.collect_set(F.when(F.col("row") > 0, F.col("cell.kind"))).alias("kinds")).orderBy("place").collect()
    if not found:
        raise ValueError(f"no columns in {path}")
    return rows.filter("row > 0").select(*(_typed(r["name"], set(r["kinds"])).alias(r["name"]) for r in found))


def write_workbooks(df: DataFrame, path: str, sheet: str = "Sheet1") -> None:
    """``df`` as workbooks of plain values below ``path``, one for each partition that has rows, more where a partition has more than a sheet holds; numbers and truth values keep their type."""
    register(df.sparkSession)
    df.write.format("workbook").option("sheet", sheet).mode("append").save(path)

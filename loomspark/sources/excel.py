"""Workbooks as tables: Office Open XML (`.xlsx`), and the Spark source and sink of that name.

read_xlsx() reads the files through Spark's `binaryFile`, so from any file system that the cluster knows; `spark.read.format("xlsx")` reads a path that driver and
executors share. One task a file, read as a stream of rows with the standard library alone: plain rows by one pattern, a sheet with others by its parser from there on. The first row names the columns; rows without any value are
left out, missing cells are null. Without a schema all columns are strings as they are stored (dates as days from 1899-12-30, or from 1904-01-01
where the workbook says so). With a schema, cells are read as its types: a cell that isn't one is null. Options: path, sheet (from 1). Old binary workbooks: see biff.py.
"""

from __future__ import annotations

import codecs
import datetime
import decimal
import functools
import io
import itertools
import posixpath
import re
import sys
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import BinaryIO
from xml.etree.ElementTree import iterparse

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, StringType, StructField, StructType, TimestampNTZType, TimestampType

from loomspark.sinks import excel as sink

register_pickle_by_value(sys.modules[__name__])  # workers need not have the package

#: Rows that a task gives at once.
ROWS = 5000
#: Bytes of a sheet that are read at once.
BLOCK = 1 << 20
#: Values of a column whose conversion is kept.
MOST_KEPT = 1 << 14
_ESCAPE = re.compile(r"_x([0-9A-Fa-f]{4})_")
# a cell as most programs write it, and what is left to the parser
_CELL = re.compile(r'(<c r="([A-Z]{1,3})[0-9]+"(?: s="[0-9]+")?(?: t="(n|b|s|str|inlineStr)")?(?:/>|><v>([^<]*)</v></c>|><is><t(?: xml:space="preserve")?>([^<]*)</t></is></c>))')
_OTHER = re.compile(r"[\x00-\x08\x0b-\x1f\ufffe\uffff]|<!|&(?!(?:amp|lt|gt|quot|apos);)")
_ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'"}
_ENTITY = re.compile("|".join(_ENTITIES))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


@functools.lru_cache(MOST_KEPT)
def _place(reference: str) -> int:
    """Column number, from 0, of a cell such as AB12."""
    at = 0
    for letter in re.match(r"[A-Z]*", reference)[0]:
        at = at * 26 + ord(letter) - 64
    return at - 1


def _said(node) -> str:
    """The text of all runs, phonetic guides aside, with escaped characters restored."""
    found: list[str] = []

    def walk(x) -> None:
        for y in x:
            if _local(y.tag) == "t":
                found.append(y.text or "")
            elif _local(y.tag) == "r":
                walk(y)

    walk(node)
    return _ESCAPE.sub(lambda m: chr(int(m[1], 16)), "".join(found))


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, node in iterparse(f):
            if _local(node.tag) == "si":
                out.append(_said(node))
                node.clear()
    return out


def _sheet(book: zipfile.ZipFile, number: int) -> tuple[str, bool]:
    """File name of a sheet, in the workbook's own order, and whether days are counted from 1904."""
    links, ids, late = {}, [], False
    with book.open("xl/_rels/workbook.xml.rels") as f:
        for _, node in iterparse(f):
            if _local(node.tag) == "Relationship":
                links[node.get("Id")] = node.get("Target")
    with book.open("xl/workbook.xml") as f:
        for _, node in iterparse(f):
            if _local(node.tag) == "sheet":
                ids.append(next(v for k, v in node.attrib.items() if _local(k) == "id"))
            elif _local(node.tag) == "workbookPr":
                late = node.get("date1904") in ("1", "true")
    if not 1 <= number <= len(ids):
        raise ValueError(f"no sheet {number}: the workbook has {len(ids)}")
    return posixpath.normpath(posixpath.join("/xl", links[ids[number - 1]])).lstrip("/"), late


def _text(cell, shared: list[str]) -> str | None:
    value = next((x.text for x in cell if _local(x.tag) == "v"), None)
    if cell.get("t") == "s":
        return None if value is None else shared[int(value)]
    if cell.get("t") == "inlineStr":
        return next((_said(x) for x in cell if _local(x.tag) == "is"), "")
    if cell.get("t") == "b":
        return None if value is None else "true" if value == "1" else "false"
    if cell.get("t") == "str":
        return None if value is None else _ESCAPE.sub(lambda m: chr(int(m[1], 16)), value)
    return value


def _parsed_rows(f: BinaryIO, shared: list[str]) -> Iterator[dict[int, str]]:
    for _, node in iterparse(f):
        if _local(node.tag) != "row":
            continue
        cells: dict[int, str] = {}
        after = 0
        for c in (x for x in node if _local(x.tag) == "c"):
            at = _place(c.get("r")) if c.get("r") else after
            after = at + 1
            if (text := _text(c, shared)) is not None:
                cells[at] = text
        node.clear()
        if cells:
            yield cells


def _plain_cells(body: str, shared: list[str]) -> dict[int, str] | None:
    """The cells of a row's text; None if it has anything but plain cells."""
    cells: dict[int, str] = {}
    size = 0
    for whole, column, kind, value, said in _CELL.findall(body):
        size += len(whole)
        inline = kind == "inlineStr"
        if inline != whole.endswith("</is></c>"):
            return None
        text = said if inline else value
        if "&" in text:
            text = _ENTITY.sub(lambda m: _ENTITIES[m[0]], text)
        if not inline:
            if not text:
                continue
            if kind == "s":
                text = shared[int(text)]
            elif kind == "b":
                text = "true" if text == "1" else "false"
        if "_x" in text and (inline or kind == "str"):
            text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)), text)
        cells[_place(column)] = text
    return cells if size == len(body) else None


def _plain_rows(f: BinaryIO, shared: list[str]) -> Iterator[dict[int, str] | None]:
    """As _parsed_rows(), without a parser; None, and nothing more, from where the sheet isn't as most programs write it."""
    decode, left, begun = codecs.getincrementaldecoder("utf-8")().decode, "", False
    while True:
        raw = f.read(BLOCK)
        try:
            left += decode(raw, not raw)
        except UnicodeDecodeError:
            yield None
            return
        if not begun:
            head, begun, rest = left.partition("<sheetData>")
            if not begun:
                if not raw or len(left) > BLOCK:
                    yield None
                    return
                continue
            if "<!" in head or (said := re.search(r"""encoding=["']([^"']*)""", head)) and said[1].lower() != "utf-8":
                yield None
                return
            left = rest
        *rows, left = left.split("</row>")
        for row in rows:
            if _OTHER.search(row):
                yield None
                return
            while True:
                end = row.find(">")
                if not row.startswith("<row") or row[4:5] not in (" ", ">", "/"):
                    yield None
                    return
                empty = row[end - 1] == "/"
                row = row[end + 1 :]
                if not empty:
                    break
            cells = _plain_cells(row, shared)
            if cells is None:
                yield None
                return
            if cells:
                yield cells
        if not raw:
            if not left.startswith("</sheetData>"):
                yield None
            return


def read_rows(file: str | BinaryIO, sheet: int = 1) -> Iterator[dict[int, str]]:
    """Cells of each row that has any, by column number."""
    with zipfile.ZipFile(file) as book:
        shared, path, n = _shared(book), _sheet(book, sheet)[0], 0
        with book.open(path) as f:
            for cells in _plain_rows(f, shared):
                if cells is None:
                    break
                n += 1
                yield cells
            else:
                return
        with book.open(path) as f:
            yield from itertools.islice(_parsed_rows(f, shared), n, None)


def days_before(file: str | BinaryIO, sheet: int = 1) -> int:
    """What is added to a workbook's days to count them from 1899-12-30."""
    with zipfile.ZipFile(file) as book:
        return 1462 if _sheet(book, sheet)[1] else 0


def _time(text: str, shift: int) -> datetime.datetime:
    try:
        micros = round((decimal.Decimal(text) + shift) * 86_400_000_000)
    except decimal.InvalidOperation:
        return datetime.datetime.fromisoformat(text)
    return sink.ZERO + datetime.timedelta(microseconds=micros)


def converter(kind: DataType, shift: int = 0) -> Callable[[str], object]:
    """From a cell's text to a value; raises where it isn't one."""
    name = kind.typeName()
    if name == "string":
        return str
    if name in ("byte", "short", "integer", "long"):
        bits = {"byte": 7, "short": 15, "integer": 31, "long": 63}[name]

        def whole(text: str) -> int:
            try:
                value = int(text)
            except ValueError:
                value = decimal.Decimal(text)
                if value != value.to_integral_value():
                    raise
            if not -(2**bits) <= value < 2**bits:
                raise ValueError(text)
            return int(value)

        return whole
    if name in ("float", "double"):
        return float
    if name == "boolean":
        return lambda text: {"true": True, "1": True, "false": False, "0": False}[text.lower()]
    if name == "decimal":

        def exact(text: str) -> decimal.Decimal:
            value = decimal.Decimal(text).quantize(decimal.Decimal(1).scaleb(-kind.scale), context=decimal.Context(prec=60))
            if len(value.as_tuple().digits) > kind.precision:
                raise ValueError(text)
            return value

        return exact
    if name == "date":
        return functools.lru_cache(MOST_KEPT)(lambda text: _time(text, shift).date())
    if name in ("timestamp", "timestamp_ntz"):
        return functools.lru_cache(MOST_KEPT)(lambda text: _time(text, shift))
    raise ValueError(f"a cell can't be read as {name}")


def _or_null(convert: Callable[[str], object], text: str | None) -> object:
    try:
        return None if text is None else convert(text)
    except (ValueError, KeyError, ArithmeticError):
        return None


def table_rows(rows: Iterator[dict[int, str]], shift: int, schema: StructType) -> Iterator[list]:
    """Values of the named columns of each row; the first one has the names. Of columns with one name the first counts."""
    own: dict[str, int] = {}
    for at, name in sorted(next(rows, {}).items()):
        own.setdefault(name, at)
    places = [own.get(n, -1) for n in schema.names]
    converters = [converter(f.dataType, shift) for f in schema]
    for cells in rows:
        yield [_or_null(c, cells.get(at)) for c, at in zip(converters, places)]


def header(file: str | BinaryIO, sheet: int = 1) -> StructType:
    head = next(read_rows(file, sheet), {})
    return StructType([StructField(name, StringType()) for name in dict.fromkeys(head[at] for at in sorted(head))])


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, files: list[str], sheet: int, schema: StructType):
        self.files, self.sheet, self.schema = files, sheet, schema

    def partitions(self) -> list[InputPartition]:
        return [_File(f) for f in self.files]

    def read(self, partition: _File) -> Iterator[tuple]:
        for row in table_rows(read_rows(partition.path, self.sheet), days_before(partition.path, self.sheet), self.schema):
            yield tuple(row)


class Xlsx(sink.XlsxSink):
    """Source and sink: a path that driver and executors share."""

    def _files(self) -> list[str]:
        path = Path(re.sub(r"^file:(//(?=/))?", "", self.options["path"]))
        found = sorted(map(str, path.glob("*.xlsx"))) if path.is_dir() else [str(path)]
        if not found or not all(f.lower().endswith(".xlsx") for f in found):
            raise ValueError(f"no .xlsx files at {path}")
        return found

    def schema(self) -> StructType:
        return header(self._files()[0], int(self.options.get("sheet", "1")))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self._files(), int(self.options.get("sheet", "1")), schema)


def registered(spark: SparkSession) -> type[DataSource]:
    spark.dataSource.register(Xlsx)
    return Xlsx


def binary_tables(spark: SparkSession, path: str, pattern: str, schema: StructType | None, head: Callable[[BinaryIO], StructType], rows: Callable[[BinaryIO, StructType], Iterator[list]]) -> DataFrame:
    """Files that Spark reads whole, a task each, as tables; head and rows get a file's bytes. The first file by name tells the columns where no schema is given."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    if schema is None:
        first = files.select("path").orderBy("path").first()
        if first is None:
            raise ValueError(f"no {pattern} files at {path}")
        schema = head(io.BytesIO(spark.read.format("binaryFile").load(first["path"]).first()["content"]))
    # a cell's time is a wall clock's; Spark makes it the session's moment
    wanted = StructType([StructField(f.name, TimestampNTZType() if f.dataType == TimestampType() else f.dataType) for f in schema])
    arrow = to_arrow_schema(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held: list[list] = []
                for row in rows(io.BytesIO(content.as_py()), wanted):
                    held.append(row)
                    if len(held) == ROWS:
                        yield packed(held)
                        held = []
                if held:
                    yield packed(held)

    def packed(held: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], arrow.field(i).type) for i in range(len(arrow))], schema=arrow)

    cells = files.select("content").mapInArrow(run, wanted)
    return cells.select(*(F.col(f"`{f.name}`").cast(f.dataType) for f in schema))


def read_xlsx(spark: SparkSession, path: str, sheet: int = 1, schema: StructType | None = None) -> DataFrame:
    def rows(file: BinaryIO, wanted: StructType) -> Iterator[list]:
        return table_rows(read_rows(file, sheet), days_before(file, sheet), wanted)

    return binary_tables(spark, path, "*.[xX][lL][sS][xX]", schema, lambda file: header(file, sheet), rows)

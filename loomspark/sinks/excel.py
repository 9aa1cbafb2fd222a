"""Spark sink `xlsx`: tables as folders of formatted Office Open XML workbooks.

Each task streams its rows into workbooks of its own (one sheet each, a further workbook at every MOST_ROWS rows), so no workbook passes through one task or the driver.
Workbooks are written in a hidden folder beside the target's and moved when all tasks are done; a task that fails removes its file, a job that fails
removes the folder. The target is a folder that driver and executors share (or file:...).

Column widths come before the rows of a sheet, so write_xlsx() finds the longest value of each column in one aggregate beforehand; all workbooks look alike.
Numbers, booleans, dates (from 1900-03-01 on) and timestamps (in the session's time zone) are typed cells; decimals, whole numbers beyond 15 digits and
numbers that aren't finite are texts, as a workbook's numbers would change them. Nulls are no cells; rows of nulls only are kept by the row count
but left out when read. Control characters and carriage returns are escaped. A text beyond MOST_CHARACTERS, which a spreadsheet program refuses,
is an error unless long is "keep". Nested columns must be made visible first (write_xlsx() does).
"""

from __future__ import annotations

import datetime
import decimal
import functools
import json
import math
import os
import re
import shutil
import sys
import uuid
import zipfile
from collections.abc import Iterator
from typing import NamedTuple
from xml.sax.saxutils import escape, quoteattr

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

register_pickle_by_value(sys.modules[__name__])  # workers need not have the package

#: What a spreadsheet program takes: rows with the header, columns, characters in a cell.
MOST_ROWS, MOST_COLUMNS, MOST_CHARACTERS = 1_048_576, 16_384, 32_767
#: Characters that are put into a workbook at once, about.
HELD = 1 << 16
#: Days are counted from here; before FIRST_DATE a program counts otherwise.
ZERO, FIRST_DATE = datetime.datetime(1899, 12, 30), datetime.date(1900, 3, 1)


class Style(NamedTuple):
    """How a sheet looks. A column is as wide as its longest value plus `extra`, within `narrowest` and `widest`, unless `widths` has it."""

    sheet: str = "Sheet1"
    header_fill: str | None = None
    header_color: str | None = None
    header_align: tuple[str, str] | None = None
    cell_align: tuple[str | None, str] | None = None
    border: str | None = None
    extra: int = 0
    narrowest: int = 8
    widest: int | None = None
    widths: dict[str, int] = {}
    header_height: int | None = None
    row_height: int | None = None
    freeze: bool = False
    filter: bool = False


# Sheets, colours, widths and heights of the exports, by what they hold.
_WIDE = dict.fromkeys(("effects", "preventive_strategies", "corrective_strategies", "indicators", "metrics", "risks"), 50)
STYLES = {
    "plain": Style(),
    "cleaned": Style(header_align=("center", "center"), cell_align=(None, "top"), extra=2, narrowest=0, widest=60, header_height=25, row_height=60),
    "noise": Style("Dataset_Limpio", "1F4E78", "FFFFFF", ("center", "center"), (None, "top"), "D9D9D9", 3, 0, 50, freeze=True, filter=True),
    "classified": Style(header_align=("left", "top"), cell_align=("left", "top"), extra=5, narrowest=20, widest=80, header_height=60, row_height=60),
    "mapped": Style(
        "dataset_mapeo", "D9EAF7", None, ("center", "center"), ("left", "top"), None, 3, 12, 35,
        {"comment_body_raw": 70, "comment_body_clean_final": 70, "repo": 22, "comment_author": 22, "comment_created_at": 22, "final_cause": 45, "cause_label": 45, "cause_label_llm": 45, "cause_rule": 45},
        28, 80, True, True,
    ),
    "enriched": Style(header_align=("left", "top"), cell_align=("left", "top"), extra=2, narrowest=15, widest=50),
    "leading": Style(
        "Dataset TOP-K", "1F4E78", "FFFFFF", ("center", "center"), ("left", "top"), None, 0, 8, None,
        {"repo": 28, "issue_number": 15, "comment_id": 18, "comment_created_at": 22, "comment_body_raw": 55, "comment_body_clean_final": 55, "final_cause_for_analysis": 42, "macro_cause_clean": 42,
         "primary_microcause_id": 38, "primary_microcause_name": 40, "primary_microcause_type": 25, "microcause_2_id": 38, "microcause_2_name": 40, "microcause_2_type": 25,
         "microcause_3_id": 38, "microcause_3_name": 40, "microcause_3_type": 25, "top_microcause_ids": 45, "top_microcause_names": 50, "top_microcause_types": 35, "community_smells": 40, **_WIDE},
        35, None, True, True,
    ),
}

_NAMESPACE = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
#: Characters that XML can't hold or changes, and what would be read as such an escape.
_SPECIAL = re.compile(r"[\x00-\x08\x0b-\x1f\ufffe\uffff&<>]|_x")
_UNSAFE = re.compile(r"[\x00-\x08\x0b-\x1f\ufffe\uffff]|_(?=x[0-9A-Fa-f]{4}_)")


def letters(at: int) -> str:
    """A column's name, from its number (from 0)."""
    out = ""
    at += 1
    while at:
        at, rest = divmod(at - 1, 26)
        out = chr(65 + rest) + out
    return out


def cell_text(text: str) -> str:
    if not _SPECIAL.search(text):
        return text
    return escape(_UNSAFE.sub(lambda m: f"_x{ord(m[0]):04X}_", text))


def _styles(style: Style) -> str:
    """Formats 0 (none), 1 (header), 2 (cells), 3 (dates), 4 (timestamps)."""

    def align(to: tuple[str | None, str] | None) -> str:
        if to is None:
            return ""
        return f'<alignment{f" horizontal={quoteattr(to[0])}" if to[0] else ""} vertical={quoteattr(to[1])} wrapText="1"/>'

    side = "".join(f'<{s} style="thin"><color rgb="FF{style.border}"/></{s}>' for s in ("left", "right", "top", "bottom")) if style.border else "<left/><right/><top/><bottom/>"
    fill = f'<fill><patternFill patternType="solid"><fgColor rgb="FF{style.header_fill}"/></patternFill></fill>' if style.header_fill else ""
    xf = lambda number, font, fill, to: f'<xf numFmtId="{number}" fontId="{font}" fillId="{fill}" borderId="1" xfId="0" applyNumberFormat="1" applyFont="1" applyFill="1" applyBorder="1" applyAlignment="1">{align(to)}</xf>'
    color = f'<color rgb="FF{style.header_color}"/>' if style.header_color else ""
    return (
        f'{_HEAD}<styleSheet xmlns="{_NAMESPACE}"><numFmts count="1"><numFmt numFmtId="164" formatCode="yyyy-mm-dd hh:mm:ss.000"/></numFmts>'
        f'<fonts count="2"><font><sz val="11"/><name val="Calibri"/></font><font><b/><sz val="11"/>{color}<name val="Calibri"/></font></fonts>'
        f'<fills count="{2 + bool(fill)}"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{fill}</fills>'
        f'<borders count="2"><border><left/><right/><top/><bottom/><diagonal/></border><border>{side}<diagonal/></border></borders>'
        '<cellStyleXfs count="1"><xf numFmtId="0" fontId="0" fillId="0" borderId="0"/></cellStyleXfs>'
        f'<cellXfs count="5"><xf numFmtId="0" fontId="0" fillId="0" borderId="0" xfId="0"/>{xf(0, 1, 2 if fill else 0, style.header_align)}{xf(0, 0, 0, style.cell_align)}{xf(14, 0, 0, style.cell_align)}{xf(164, 0, 0, style.cell_align)}</cellXfs>'
        '<cellStyles count="1"><cellStyle name="Normal" xfId="0" builtinId="0"/></cellStyles></styleSheet>'
    )


def _parts(style: Style) -> dict[str, str]:
    """Everything of a workbook but its sheet."""
    main = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    types = "".join(f'<Override PartName="/xl/{p}.xml" ContentType="{main}.{t}+xml"/>' for p, t in (("workbook", "sheet.main"), ("worksheets/sheet1", "worksheet"), ("styles", "styles")))
    link = lambda i, kind, to: f'<Relationship Id="rId{i}" Type="{_RELATIONS}/{kind}" Target="{to}"/>'
    return {
        "[Content_Types].xml": f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{types}</Types>',
        "_rels/.rels": f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">{link(1, "officeDocument", "xl/workbook.xml")}</Relationships>',
        "xl/workbook.xml": f'{_HEAD}<workbook xmlns="{_NAMESPACE}" xmlns:r="{_RELATIONS}"><sheets><sheet name={quoteattr(style.sheet)} sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">{link(1, "worksheet", "worksheets/sheet1.xml")}{link(2, "styles", "styles.xml")}</Relationships>',
        "xl/styles.xml": _styles(style),
    }


def day_number(moment: datetime.datetime) -> str:
    """Days with 16 decimal places, which tell microseconds apart."""
    return _day_number(moment.replace(tzinfo=None))


@functools.lru_cache(1 << 14)
def _day_number(moment: datetime.datetime) -> str:
    past = moment - ZERO
    part = (past.seconds * 1_000_000 + past.microseconds) * 10**16 // 86_400_000_000
    return f"{past.days}.{part:016d}"


def _cell(place: str, value: object, long: str) -> str:
    if type(value) is str and len(value) <= MOST_CHARACTERS:  # most cells
        return f'<c r="{place}" s="2" t="inlineStr"><is><t xml:space="preserve">{cell_text(value)}</t></is></c>'
    if isinstance(value, bool):
        return f'<c r="{place}" s="2" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int) and abs(value) < 10**15 or isinstance(value, float) and math.isfinite(value):
        return f'<c r="{place}" s="2"><v>{value!r}</v></c>'
    if isinstance(value, datetime.date) and not isinstance(value, datetime.datetime) and value >= FIRST_DATE:
        return f'<c r="{place}" s="3"><v>{(value - ZERO.date()).days}</v></c>'
    if isinstance(value, datetime.datetime) and value.date() >= FIRST_DATE:
        return f'<c r="{place}" s="4"><v>{day_number(value)}</v></c>'
    text = format(value, "f") if isinstance(value, decimal.Decimal) else str(value)
    if len(text) > MOST_CHARACTERS and long != "keep":
        raise ValueError(f"a text of {len(text)} characters at {place}: a cell takes {MOST_CHARACTERS}")
    return f'<c r="{place}" s="2" t="inlineStr"><is><t xml:space="preserve">{cell_text(text)}</t></is></c>'


class Workbook:
    """One workbook of one sheet, written as a stream of rows; about HELD characters of them are held."""

    def __init__(self, path: str, names: list[str], style: Style, widths: list[float], long: str):
        self.names, self.style, self.long, self.rows = [letters(i) for i in range(len(names))], style, long, 1
        self.zip = zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED, compresslevel=4)
        for name, text in _parts(style).items():
            self.zip.writestr(name, text)
        self.sheet = self.zip.open("xl/worksheets/sheet1.xml", "w", force_zip64=True)
        pane = '<pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/>' if style.freeze else ""
        columns = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths, 1))
        self._put(f'{_HEAD}<worksheet xmlns="{_NAMESPACE}"><sheetViews><sheetView workbookViewId="0">{pane}</sheetView></sheetViews>{f"<cols>{columns}</cols>" if columns else ""}<sheetData>')
        cells = "".join(f'<c r="{c}1" s="1" t="inlineStr"><is><t xml:space="preserve">{cell_text(n)}</t></is></c>' for c, n in zip(self.names, names))
        self._put(f'<row r="1"{self._height(style.header_height)}>{cells}</row>')
        self.open_row, self.held, self.size = self._height(style.row_height), [], 0

    @staticmethod
    def _height(height: int | None) -> str:
        return f' ht="{height}" customHeight="1"' if height else ""

    def _put(self, text: str) -> None:
        self.sheet.write(text.encode("utf-8"))

    def add(self, row: tuple) -> None:
        self.rows += 1
        cells = "".join(_cell(f"{c}{self.rows}", v, self.long) for c, v in zip(self.names, row) if v is not None)
        self.held.append(f'<row r="{self.rows}"{self.open_row}>{cells}</row>')
        self.size += len(self.held[-1])
        if self.size >= HELD:
            self._put("".join(self.held))
            self.held, self.size = [], 0

    def close(self) -> None:
        within = f'<autoFilter ref="A1:{self.names[-1]}{self.rows}"/>' if self.style.filter and self.names else ""
        self._put(f"{''.join(self.held)}</sheetData>{within}</worksheet>")
        self.sheet.close()
        self.zip.close()

    def drop(self) -> None:
        """Leaves what is written so far as it is."""
        self.sheet.close()
        self.zip.close()


class Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, names: list[str], style: Style, widths: list[float], most: int, long: str, overwrite: bool):
        self.folder, self.names, self.style, self.widths, self.most, self.long, self.overwrite = folder, names, style, widths, most, long, overwrite
        self.job = uuid.uuid4().hex
        self.own = f"{folder.rstrip('/')}/_writing-{self.job}"

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        os.makedirs(self.own, exist_ok=True)
        stem = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:12]}"
        files: list[str] = []
        book: Workbook | None = None
        try:
            for row in iterator:
                if book is None or book.rows >= self.most:
                    if book:
                        book.close()
                    files.append(f"{self.own}/{stem}-{len(files):03d}.xlsx")
                    book = Workbook(files[-1], self.names, self.style, self.widths, self.long)
                book.add(row)
            if book:
                book.close()
        except BaseException:
            if book:
                book.drop()
            for path in files:
                os.remove(path)
            raise
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        files = [f for m in messages if m for f in m.files]
        if not files:  # an empty table: a workbook with its header
            os.makedirs(self.own, exist_ok=True)
            files = [f"{self.own}/part-00000-{self.job[:12]}-000.xlsx"]
            Workbook(files[0], self.names, self.style, self.widths, self.long).close()
        if self.overwrite:
            for name in os.listdir(self.folder):
                if name.endswith(".xlsx"):
                    os.remove(f"{self.folder}/{name}")
        for path in files:
            os.replace(path, f"{self.folder}/{os.path.basename(path)}")
        shutil.rmtree(self.own)  # with what tasks that were run twice left

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.own, ignore_errors=True)


class XlsxSink(DataSource):
    """Options: style (a name of STYLES), longest (JSON: characters of each column's longest value), most (rows of a workbook with its header), long (error or keep)."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        path = self.options["path"]
        if re.match(r"[a-z0-9]{2,}:", path) and not path.startswith("file:"):
            raise ValueError(f"workbooks are written to a folder that all machines see as a path, not to {path}")
        if len(schema) > MOST_COLUMNS:
            raise ValueError(f"{len(schema)} columns: a sheet takes {MOST_COLUMNS}")
        nested = [f.name for f in schema if f.dataType.typeName() in ("array", "map", "struct", "binary", "variant")]
        if nested:
            raise ValueError(f"a cell can't hold {nested}")
        style, longest = STYLES[self.options.get("style", "plain")], json.loads(self.options.get("longest", "{}"))
        most = int(self.options.get("most", MOST_ROWS))
        if not 2 <= most <= MOST_ROWS:
            raise ValueError(f"a workbook takes 2 to {MOST_ROWS} rows with its header")
        return _Writer(re.sub(r"^file:(//(?=/))?", "", path), schema.names, style, column_widths(schema.names, style, longest), most, self.options.get("long", "error"), overwrite)


def column_widths(names: list[str], style: Style, longest: dict[str, int]) -> list[float]:
    fit = lambda n: max(style.narrowest, min(max(longest.get(n, 0), len(n)) + style.extra, style.widest))
    return [style.widths.get(n, fit(n) if style.widest else 13) for n in names]


def write_xlsx(df: DataFrame, path: str, style: str = "plain", mode: str = "overwrite", most: int = MOST_ROWS, long: str = "error") -> None:
    """A folder of workbooks. Lists become lines of a cell and other nested values JSON. Reads df twice where the style fits widths to the values."""
    from loomspark.sinks.writers import visible
    from loomspark.sources.excel import registered

    kinds = {"variant": F.to_json, "binary": F.base64, "timestamp": lambda c: c.cast("timestamp_ntz")}  # the session's wall clock
    flat = visible(df).withColumns({c: kinds[kind](F.col(f"`{c}`")) for c, kind in df.dtypes if kind in kinds})
    longest = {}
    if STYLES[style].widest and df.columns:
        found = flat.agg(*(F.max(F.length(F.col(f"`{c}`").cast("string"))).alias(f"n{i}") for i, c in enumerate(flat.columns))).first()
        longest = {c: found[i] or 0 for i, c in enumerate(flat.columns)}
    registered(df.sparkSession)
    flat.write.format("xlsx").mode(mode).options(style=style, longest=json.dumps(longest), most=str(most), long=long).save(path)

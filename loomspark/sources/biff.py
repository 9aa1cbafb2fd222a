"""Old binary workbooks (`.xls`, BIFF8 in a compound file) as tables, through Spark's `binaryFile`, a task a file.

A compound file is a file system of sectors: chains of them, told by an allocation table, are streams, small streams lie in a stream of their own. The workbook's
stream is a row of records; strings are in one shared table, which runs over several records and may break within a string. Values are read as
sources.excel does: texts as they are, numbers (dates too, as days) as text or by a schema's types, rows without any value left out. A workbook behind a
password, one before BIFF8, or a file that breaks off is refused.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from loomspark.sources.excel import binary_tables, table_rows

# The format's signature, numbers that end chains, kinds of records.
SIGNATURE = bytes.fromhex("d0cf11e0a1b11ae1")
END, FREE = 0xFFFFFFFE, 0xFFFFFFFF
BOF, EOF, SHEET, STRINGS, CONTINUE, PASSWORD, DATES = 0x809, 0x0A, 0x85, 0xFC, 0x3C, 0x2F, 0x22
SHARED, NUMBER, SHORT, SHORTS, TEXT, FORMULA, RESULT, TRUTH = 0xFD, 0x203, 0x27E, 0xBD, 0x204, 0x06, 0x207, 0x205


def workbook_stream(data: bytes) -> bytes:
    """The stream named Workbook."""
    if data[:8] != SIGNATURE:
        raise ValueError("no compound file")
    try:
        return _stream(data, "Workbook")
    except (IndexError, struct.error) as e:
        raise ValueError("the file breaks off") from e


def _stream(data: bytes, name: str) -> bytes:
    size, small = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
    first_entry, cutoff, first_small = struct.unpack_from("<I", data, 48)[0], *struct.unpack_from("<II", data, 56)
    more = struct.unpack_from("<I", data, 68)[0]
    sector = lambda n: data[(n + 1) * size : (n + 2) * size]
    numbers = lambda raw: struct.unpack(f"<{len(raw) // 4}I", raw)
    tables = [n for n in struct.unpack_from("<109I", data, 76) if n < END]
    seen: set[int] = set()
    while more < END and more not in seen:  # the list of tables goes on in sectors of its own
        seen.add(more)
        *own, more = numbers(sector(more))
        tables += [n for n in own if n < END]
    follow = [n for t in tables for n in numbers(sector(t))]

    def chain(at: int, after: list[int]) -> list[int]:
        out, met = [], set()
        while at < END:
            if at in met:
                raise ValueError("a chain of sectors runs in a circle")
            met.add(at)
            out.append(at)
            at = after[at]
        return out

    joined = lambda at: b"".join(map(sector, chain(at, follow)))
    entries = joined(first_entry)
    found: dict[str, tuple[int, int]] = {}
    for at in range(0, len(entries), 128):
        length = struct.unpack_from("<H", entries, at + 64)[0]
        kind = entries[at + 66]
        if kind in (2, 5):
            label = entries[at : at + max(0, length - 2)].decode("utf-16-le") if kind == 2 else ""
            found[label] = struct.unpack_from("<II", entries, at + 116)
    if name not in found:
        raise ValueError(f"no stream {name}: not a BIFF8 workbook")
    at, n = found[name]
    if n >= cutoff:
        out = joined(at)[:n]
    else:
        minor = joined(found[""][0])
        after = [x for t in chain(first_small, follow) for x in numbers(sector(t))]
        out = b"".join(minor[k * small : (k + 1) * small] for k in chain(at, after))[:n]
    if len(out) < n:
        raise ValueError("the file breaks off")
    return out


def records(stream: bytes, at: int = 0) -> Iterator[tuple[int, bytes]]:
    while at + 4 <= len(stream):
        kind, size = struct.unpack_from("<HH", stream, at)
        yield kind, stream[at + 4 : at + 4 + size]
        at += 4 + size


class _Parts:
    """A record and those that continue it, read as one; a string's characters may change their width at a break."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.part, self.at = parts, 0, 0

    def _next(self) -> None:
        self.part, self.at = self.part + 1, 0

    def take(self, n: int) -> bytes:
        out = b""
        while n:
            if self.at >= len(self.parts[self.part]):
                self._next()
            own = self.parts[self.part][self.at : self.at + n]
            self.at += len(own)
            n -= len(own)
            out += own
        return out

    def text(self) -> str:
        count, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out, wide = [], flags & 1
        while count:
            if self.at >= len(self.parts[self.part]):
                self._next()
                wide = self.take(1)[0] & 1
            own = self.parts[self.part][self.at : self.at + count * (2 if wide else 1)]
            self.at += len(own)
            count -= len(own) // 2 if wide else len(own)
            out.append(own.decode("utf-16-le", "surrogatepass") if wide else own.decode("latin-1"))
        self.take(4 * runs + extra)
        text = "".join(out)
        return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")  # halves that met at a break


def _number(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def _short(raw: int) -> str:
    """A number packed in 30 bits, of which two flags tell the kind and a hundredth."""
    value = float((raw - (1 << 32) if raw & 0x80000000 else raw) >> 2) if raw & 2 else struct.unpack("<d", struct.pack("<II", 0, raw & 0xFFFFFFFC))[0]
    return _number(value / 100 if raw & 1 else value)


def read_rows(file: BinaryIO, sheet: int = 1) -> tuple[Iterator[dict[int, str]], int]:
    """Cells of each row that has any, by column number, and what is added to the workbook's days."""
    stream = workbook_stream(file.read())
    places, shared, late, held = [], [], False, None
    for kind, body in records(stream):
        if kind == BOF and not places and struct.unpack_from("<H", body)[0] != 0x600:
            raise ValueError("not a BIFF8 workbook")
        if kind == PASSWORD:
            raise ValueError("the workbook has a password")
        if kind == CONTINUE and held is not None:
            held.append(body)
            continue
        if held is not None:
            shared, held = _shared(held), None
        if kind == STRINGS:
            held = [body]
        elif kind == SHEET and body[5] == 0:
            places.append(struct.unpack_from("<I", body)[0])
        elif kind == DATES:
            late = struct.unpack_from("<H", body)[0] == 1
        elif kind == EOF:
            break
    if not 1 <= sheet <= len(places):
        raise ValueError(f"no sheet {sheet}: the workbook has {len(places)}")
    return _cells(stream, places[sheet - 1], shared), 1462 if late else 0


def _shared(parts: list[bytes]) -> list[str]:
    own = _Parts(parts)
    own.take(4)
    return [own.text() for _ in range(struct.unpack("<I", own.take(4))[0])]


def _cells(stream: bytes, at: int, shared: list[str]) -> Iterator[dict[int, str]]:
    """Rows in their order; a workbook may hold their cells in any, so a sheet (of 65,536 rows at most) is gathered first."""
    rows: dict[int, dict[int, str]] = {}
    waits: tuple[int, int] | None = None
    for kind, body in records(stream, at):
        if kind == EOF:
            break
        if kind == RESULT and waits:
            rows.setdefault(waits[0], {})[waits[1]] = _Parts([body]).text()
        if kind not in (SHARED, NUMBER, SHORT, SHORTS, TEXT, FORMULA, TRUTH):
            continue
        row, column = struct.unpack_from("<HH", body)
        waits, value = None, None
        if kind == SHARED:
            value = shared[struct.unpack_from("<I", body, 6)[0]]
        elif kind == NUMBER:
            value = _number(struct.unpack_from("<d", body, 6)[0])
        elif kind == SHORT:
            value = _short(struct.unpack_from("<I", body, 6)[0])
        elif kind == TEXT:
            value = _Parts([body[6:]]).text()
        elif kind == TRUTH and not body[7]:
            value = "true" if body[6] else "false"
        elif kind == FORMULA and body[12:14] == b"\xff\xff":
            waits = (row, column) if body[6] == 0 else None
            value = ("true" if body[8] else "false") if body[6] == 1 else None
        elif kind == FORMULA:
            value = _number(struct.unpack_from("<d", body, 6)[0])
        elif kind == SHORTS:
            for k in range((len(body) - 6) // 6):
                rows.setdefault(row, {})[column + k] = _short(struct.unpack_from("<I", body, 6 + 6 * k)[0])
        if value is not None:
            rows.setdefault(row, {})[column] = value
    for row in sorted(rows):
        yield rows[row]


def read_xls(spark: SparkSession, path: str, sheet: int = 1, schema: StructType | None = None) -> DataFrame:
    def head(file: BinaryIO) -> StructType:
        first = next(read_rows(file, sheet)[0], {})
        return StructType([StructField(name, StringType()) for name in dict.fromkeys(first[at] for at in sorted(first))])

    def rows(file: BinaryIO, wanted: StructType) -> Iterator[list]:
        cells, shift = read_rows(file, sheet)
        return table_rows(cells, shift, wanted)

    return binary_tables(spark, path, "*.[xX][lL][sS]", schema, head, rows)

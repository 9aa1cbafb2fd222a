"""Workbooks: what is written is read back as it was, as texts and by types; formats; failed tasks; old binary workbooks."""

import datetime
import decimal
import os
import random
import struct
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomspark.sinks import excel as sink
from loomspark.sources import biff, excel, readers

KINDS = "n long, x double, f float, small byte, yes boolean, d date, t timestamp, amount decimal(20,4), said string"


def test_many_rows_come_back(spark, tmp_path):
    rows = spark.range(100_000).select(
        F.col("id").alias("n"), (F.col("id") / 7).alias("x"), (F.col("id") % 3 == 0).alias("yes"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 900).cast("int")).alias("d"),
        (F.lit("2024-05-06 07:08:09.123456").cast("timestamp") + F.make_dt_interval(mins=F.col("id"))).alias("t"), F.when(F.col("id") % 5 > 0, F.concat(F.lit(" <&\"'> \r\n\té漢_x000D_ "), "id")).alias("said"),
    ).repartition(5)
    sink.write_xlsx(rows, str(tmp_path / "out"), "cleaned", most=15_001)
    files = os.listdir(tmp_path / "out")
    assert len(files) == 10 and all(f.endswith(".xlsx") for f in files)
    back = excel.read_xlsx(spark, str(tmp_path / "out"), schema=rows.schema)
    assert back.dtypes == rows.dtypes and back.exceptAll(rows).isEmpty() and rows.exceptAll(back).isEmpty()
    through = spark.read.format("xlsx").load(f"file://{tmp_path}/out").select("said").where("said is not null")
    assert through.exceptAll(rows.select("said")).isEmpty() and through.count() == 80_000


def odd_rows():
    big = decimal.Decimal("1234567890123456.7891")
    moment = datetime.datetime(2020, 2, 29, 23, 59, 59, 999_999)
    return [
        (2**62 + 1, 1e300, 0.1, -128, True, datetime.date(1900, 3, 1), moment, big, "\x00\x01\x0b\x1f￾\r _x0041_ _x00zz_"),
        (-1, float("nan"), float("inf"), 127, False, datetime.date(1700, 1, 1), datetime.datetime(1800, 1, 1, 5), decimal.Decimal("1E-4"), ""),
        (0, float("-inf"), -0.0, None, None, datetime.date(1900, 2, 28), datetime.datetime(9999, 12, 31, 23, 59, 59), decimal.Decimal("-0.5000"), "  "),
        (None, 5e-324, None, None, None, None, None, None, None),
    ]


def test_odd_values(spark, tmp_path):
    rows = spark.createDataFrame([*odd_rows(), (None,) * 9], KINDS)
    sink.write_xlsx(rows, str(tmp_path / "o"))
    back = excel.read_xlsx(spark, str(tmp_path / "o"), schema=rows.schema)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, rows.collect()[:4]))  # a row of nulls only has no cells
    texts = excel.read_xlsx(spark, str(tmp_path / "o"))
    assert {f.dataType.simpleString() for f in texts.schema} == {"string"} and texts.columns == rows.columns
    wrong = excel.read_xlsx(spark, str(tmp_path / "o"), schema=StructType().add("said", "integer").add("x", "integer").add("gone", "string"))
    assert {tuple(r) for r in wrong.collect()} == {(None, None, None)}
    with pytest.raises(ValueError, match="struct"):
        excel.converter(StructType())


def test_nested_and_empty(spark, tmp_path):
    rows = spark.createDataFrame([(["a", "b"], {"k": 1}, bytearray(b"\x00\xff"))], "l array<string>, m map<string,int>, b binary")
    sink.write_xlsx(rows, str(tmp_path / "n"), "noise")
    assert tuple(excel.read_xlsx(spark, str(tmp_path / "n")).first()) == ("a\nb", '{"k":1}', "AP8=")
    sink.write_xlsx(rows.where("false"), str(tmp_path / "e"), "noise")
    assert excel.read_xlsx(spark, str(tmp_path / "e")).columns == ["l", "m", "b"] and readers.read_comments(spark, str(tmp_path / "e"), "xlsx").count() == 0
    excel.registered(spark)
    with pytest.raises(PySparkException, match="can't hold"):
        rows.write.format("xlsx").mode("append").save(str(tmp_path / "x"))


def test_overwrite_append_and_failure(spark, tmp_path):
    at = str(tmp_path / "w")
    sink.write_xlsx(spark.range(10), at)
    sink.write_xlsx(spark.range(5), at, mode="append")
    assert excel.read_xlsx(spark, at).count() == 15
    before = sorted(os.listdir(at))
    long = spark.range(4).select(F.when(F.col("id") == 3, F.repeat(F.lit("x"), 40_000)).otherwise("y").alias("t")).repartition(4)
    with pytest.raises(PySparkException, match="a cell takes"):
        sink.write_xlsx(long, at)
    assert sorted(os.listdir(at)) == before  # neither parts of the failed job nor its folder; what was there stays
    sink.write_xlsx(long, at, long="keep")
    assert {len(r.t) for r in excel.read_xlsx(spark, at).collect()} == {1, 40_000}
    with pytest.raises(PySparkException, match="all machines"):
        spark.range(1).write.format("xlsx").mode("append").save("s3a://somewhere/out")


def parts(folder):
    with zipfile.ZipFile(next(folder.glob("*.xlsx"))) as book:
        return {n: ElementTree.fromstring(book.read(n)) for n in book.namelist()}


@pytest.mark.parametrize("name", list(sink.STYLES))
def test_formats(spark, tmp_path, name):
    rows = spark.createDataFrame([("x" * 300, 1, "short")], "comment_body_raw string, issue_number long, other string")
    sink.write_xlsx(rows.coalesce(1), str(tmp_path / "f"), name)
    found, style = parts(tmp_path / "f"), sink.STYLES[name]
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    sheet, book = found["xl/worksheets/sheet1.xml"], found["xl/workbook.xml"]
    widths = [float(c.get("width")) for c in sheet.iter(f"{ns}col")]
    want = {"plain": [13, 13, 13], "cleaned": [60, 14, 7], "noise": [50, 15, 8], "classified": [80, 20, 20], "mapped": [70, 15, 12], "enriched": [50, 15, 15], "leading": [55, 15, 13]}
    assert widths == want[name] and next(book.iter(f"{ns}sheet")).get("name") == style.sheet
    assert bool(list(sheet.iter(f"{ns}pane"))) == style.freeze and [a.get("ref") for a in sheet.iter(f"{ns}autoFilter")] == ["A1:C2"] * style.filter
    heights = [r.get("ht") for r in sheet.iter(f"{ns}row")]
    assert heights == [str(h) if h else None for h in (style.header_height, style.row_height)]
    formats = list(found["xl/styles.xml"].find(f"{ns}cellXfs"))
    assert len(formats) == 5 and [x.get("wrapText") for x in formats[2]] == ["1"] * bool(style.cell_align)
    fills = [c.get("rgb") for c in found["xl/styles.xml"].iter(f"{ns}fgColor")]
    assert fills == ([f"FF{style.header_fill}"] if style.header_fill else [])


def test_column_letters():
    assert [sink.letters(i) for i in (0, 25, 26, 701, 702, 16_383)] == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]
    assert all(excel._place(sink.letters(i) + "7") == i for i in range(3000))


def test_days_from_1904(spark, tmp_path):
    sink.write_xlsx(spark.sql("select date'2024-02-29' as d"), str(tmp_path / "a"))
    path = next((tmp_path / "a").glob("*.xlsx"))
    with zipfile.ZipFile(path) as book, zipfile.ZipFile(tmp_path / "late.xlsx", "w") as late:
        for n in book.namelist():
            late.writestr(n, book.read(n).replace(b"<sheets>", b'<workbookPr date1904="1"/><sheets>'))
    got = [excel.read_xlsx(spark, str(p), schema=StructType().add("d", "date")).first().d for p in (path, tmp_path / "late.xlsx")]
    assert got == [datetime.date(2024, 2, 29), datetime.date(2028, 3, 1)]


def old_text(text, wide=True):
    return struct.pack("<HB", len(text.encode("utf-16-le")) // 2 if wide else len(text), int(wide)) + text.encode("utf-16-le" if wide else "latin-1")


def string_table(texts, size):
    """Records of the shared strings, broken every `size` bytes, within strings too."""
    out, own = [], bytearray(struct.pack("<II", len(texts), len(texts)))
    for k, text in enumerate(texts):
        wide = any(ord(c) > 255 for c in text) or k % 2 == 0
        unit, raw = (2, text.encode("utf-16-le")) if wide else (1, text.encode("latin-1"))
        if len(own) + 3 > size:
            out.append(bytes(own))
            own = bytearray()
        own += struct.pack("<HB", len(raw) // unit, int(wide))
        while raw:
            room = (size - len(own)) // unit * unit
            if not room:
                out.append(bytes(own))
                own = bytearray([int(wide)])
                continue
            own += raw[:room]
            raw = raw[room:]
    out.append(bytes(own))
    return b"".join(struct.pack("<HH", biff.STRINGS if i == 0 else biff.CONTINUE, len(x)) + x for i, x in enumerate(out))


def old_workbook(cells, texts, size=400, late=False, shuffled=None):
    """A compound file with one sheet; cells: records. With shuffled, its sectors lie in any order."""
    rec = lambda kind, body=b"": struct.pack("<HH", kind, len(body)) + body
    bof = rec(biff.BOF, struct.pack("<HHHHII", 0x600, 5, 0, 0, 0, 0))
    front = bof + rec(biff.DATES, struct.pack("<H", int(late)))
    strings = string_table(texts, size) + rec(biff.EOF)
    sheet = lambda at: rec(biff.SHEET, struct.pack("<IBB", at, 0, 0) + b"\x01\x00S")
    stream = front + sheet(len(front) + len(sheet(0)) + len(strings)) + strings + bof + b"".join(rec(*c) for c in cells) + rec(biff.EOF)
    small = len(stream) < 4096
    blocks = lambda raw, n=512: [raw[i : i + n].ljust(n, b"\0") for i in range(0, len(raw), n)]
    entry = lambda name, kind, start, n: name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBB", 2 * len(name) + 2, kind, 1) + b"\xff" * 12 + b"\0" * 36 + struct.pack("<II", start, n) + b"\0" * 4
    body = blocks(stream)
    order = list(range(len(body)))
    if shuffled:
        random.Random(shuffled).shuffle(order)
    first = 2 + len(blocks(b"x" * 4 * (len(body) + 20)))  # entries, small table, allocation tables, then the stream
    tables = first - 2
    place = {k: first + order[k] for k in range(len(body))}
    follow = [biff.END, biff.END] + [0xFFFFFFFD] * tables + [biff.FREE] * len(body)
    for k in range(len(body)):
        follow[place[k]] = place[k + 1] if k + 1 < len(body) else biff.END
    minor = -(-len(stream) // 64)
    chain = list(range(1, minor)) + [biff.END] if small else []
    entries = entry("Root Entry", 5, place[0] if small else biff.END, len(stream) if small else 0) + entry("Workbook", 2, 0 if small else place[0], len(stream))
    sectors = [entries.ljust(512, b"\0"), struct.pack(f"<{len(chain)}I", *chain).ljust(512, b"\xff"), *blocks(struct.pack(f"<{len(follow)}I", *follow).ljust(512 * tables, b"\xff")), *[b""] * len(body)]
    for k, block in enumerate(body):
        sectors[place[k]] = block
    header = biff.SIGNATURE + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10
    header += struct.pack("<I", tables) + struct.pack("<I", 0) + struct.pack("<I", 0) + struct.pack("<I", 4096) + struct.pack("<II", 1 if small else biff.END, int(small)) + struct.pack("<II", biff.END, 0)
    header += struct.pack("<109I", *range(2, 2 + tables), *[biff.FREE] * (109 - tables))
    assert len(header) == 512 and tables < 109
    return header + b"".join(sectors)


@pytest.mark.parametrize(("n", "shuffled", "late"), [(3, None, False), (3, 5, True), (900, None, False), (900, 7, False)])
def test_old_workbooks(spark, tmp_path, n, shuffled, late):
    texts = ["name", "when", "x", "ok", *(("é漢😀" if k % 3 else "plain ÿ ") * (k % 40) + f"t{k}" for k in range(n))]
    at = lambda r, c: struct.pack("<HHH", r, c, 0)
    cells = [(biff.SHARED, at(0, c) + struct.pack("<I", c)) for c in range(4)]
    for k in range(n):
        r = k + 1 + (k > n // 2)  # an empty row in between
        cells.append((biff.SHARED, at(r, 0) + struct.pack("<I", 4 + k)))
        cells.append((biff.SHORTS, struct.pack("<HHH", r, 1, 0) + struct.pack("<I", (44_000 + k) << 2 | 2) + struct.pack("<HI", 0, (-150 * k & 0x3FFFFFFF) << 2 | 3) + struct.pack("<H", 2)) if k % 2 else (biff.SHORT, at(r, 1) + struct.pack("<I", (44_000 + k) << 2 | 2)))
        if not k % 2:
            cells.append((biff.NUMBER, at(r, 2) + struct.pack("<d", k / 7)))
        cells.append((biff.TRUTH, at(r, 3) + bytes([k % 2, 0])))
    (tmp_path / "a.xls").write_bytes(old_workbook(cells, texts, late=late, shuffled=shuffled))
    got = readers.read_comments(spark, str(tmp_path / "a.xls"))
    assert got.columns == ["name", "when", "x", "ok"] and [r.name for r in got.collect()] == texts[4:]
    schema = StructType().add("name", "string").add("when", "date").add("x", "double").add("ok", "boolean")
    day = datetime.date(1899, 12, 30) + datetime.timedelta(44_000 + 1462 * late)
    want = [(texts[4 + k], day + datetime.timedelta(k), -1.5 * k if k % 2 else k / 7, bool(k % 2)) for k in range(n)]
    assert [tuple(r) for r in biff.read_xls(spark, str(tmp_path / "a.xls"), schema=schema).collect()] == want


def test_formulas_and_refusals(tmp_path):
    at = struct.pack("<HHH", 3, 1, 0)
    cells = [(biff.FORMULA, at + struct.pack("<d", 2.5)), (biff.FORMULA, struct.pack("<HHH", 3, 2, 0) + b"\0\0\0\0\0\0\xff\xff"), (biff.RESULT, old_text("said")), (biff.FORMULA, struct.pack("<HHH", 3, 3, 0) + b"\1\0\1\0\0\0\xff\xff"),
             (biff.TRUTH, struct.pack("<HHH", 3, 4, 0) + bytes([42, 1])), (biff.TEXT, struct.pack("<HHH", 2, 0, 0) + old_text("ÿ", False))]
    import io

    data = old_workbook(cells, [])
    assert list(biff.read_rows(io.BytesIO(data))[0]) == [{0: "ÿ"}, {1: "2.5", 2: "said", 3: "true"}]
    with pytest.raises(ValueError, match="no sheet 2"):
        biff.read_rows(io.BytesIO(data), 2)
    with pytest.raises(ValueError, match="no compound"):
        biff.read_rows(io.BytesIO(b"PK" + data))
    with pytest.raises(ValueError, match="breaks off"):
        biff.read_rows(io.BytesIO(data[:1200]))


def test_plain_rows_need_no_parser(tmp_path, monkeypatch):
    """Cells are the same without the parser as with it, in whatever sheet; a sheet as it is written here never meets the parser."""
    rows = [("a & b < c > \"d\" 'e'", 1, 2.5, True, None), (None,) * 5, ("_x0041_ \x01\r\n\t ñ", -7, 1e300, False, "x"), ("", 0, 0.1, True, "]]>")]
    book = sink.Workbook(str(tmp_path / "own.xlsx"), list("abcde"), sink.Style(), [10.0] * 5, "error")
    for r in rows:
        book.add(r)
    book.close()

    def sheet(name, body, head='<?xml version="1.0" encoding="UTF-8"?>'):
        with zipfile.ZipFile(tmp_path / "own.xlsx") as old, zipfile.ZipFile(tmp_path / name, "w") as new:
            for part in old.namelist():
                new.writestr(part, old.read(part) if "sheet1" not in part else f'{head}<worksheet xmlns="m"><sheetData>{body}</sheetData></worksheet>'.encode("utf-8"))
        return str(tmp_path / name)

    def both(path):
        with zipfile.ZipFile(path) as old:
            with old.open("xl/worksheets/sheet1.xml") as f:
                parsed = list(excel._parsed_rows(f, []))
        return list(excel.read_rows(path)), parsed

    got, parsed = both(str(tmp_path / "own.xlsx"))
    assert got == parsed and len(got) == 4 and got[2][0] == "_x0041_ \x01\r\n\t ñ"
    plain = '<row r="1"><c r="A1"><v>1</v></c><c r="C1" t="str"><v>s</v></c></row><row r="2"/><row r="3" ht="5"><c r="B3" s="1"/></row>'
    odd = ['<c r="A9"><v><![CDATA[5]]></v></c>', '<c><v>7</v></c>', '<c r="A9"><v>&#65;</v></c>', '<c r="A9"><f>1+1</f><v>2</v></c>', '<c r="A9" t="inlineStr"><is><r><t>x</t></r><r><t>y</t></r></is></c>', ' <c r="A9" t="inlineStr"/>', '<c t="b" r="A9"><v>1</v></c>', "<!-- <row> --><c r='A9'><v>3</v></c>"]
    for i, cells in enumerate(odd):
        got, parsed = both(sheet(f"{i}.xlsx", f'{plain}<row r="9">{cells}</row>{plain}'))
        assert got == parsed and len(got) == 3
    monkeypatch.setattr(excel, "iterparse", lambda f: iter(()) if "sheet1" in f.name else ElementTree.iterparse(f))
    assert len(list(excel.read_rows(str(tmp_path / "own.xlsx")))) == 4

"""Readers and checks of comment tables."""

from __future__ import annotations

import csv
from collections.abc import Iterable
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.sources.biff import read_xls
from loomspark.sources.excel import read_xlsx

# What column names are searched for.
TEXT_NAMES = ("body", "text", "content", "description", "comment")
NOT_TEXT = ("id", "author", "date", "created", "url", "time")
ISSUE_NAMES = ("issue_number", "issue", "ticket", "issue_id")


def read_comments(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """CSV by comma, or by semicolon if that raises or gives one column; Parquet and JSON by suffix, Excel workbooks, old ones too; others are refused."""
    kind = kind or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        options = {"header": True, "multiLine": True, "escape": '"'}
        try:
            out = spark.read.options(**options).csv(path)
        except PySparkException:  # raised by the header
            out = None
        return out if out is not None and len(out.columns) > 1 else spark.read.options(sep=";", **options).csv(path)
    if kind in ("parquet", "json", "orc"):
        return spark.read.format(kind).load(path)
    if kind == "xlsx":
        return read_xlsx(spark, path)
    if kind == "xls":
        return read_xls(spark, path)
    raise ValueError(f"cannot read {kind!r} files")


def read_sniffed_csv(spark: SparkSession, path: str, lines: int = 50) -> DataFrame:
    """CSV whose separator is found in the first lines; malformed rows are left out."""
    first = [r.value[:2000] for r in spark.read.text(path).limit(lines).collect()]
    if not first:
        raise ValueError(f"nothing to read at {path}")
    try:
        sep = csv.Sniffer().sniff("\n".join(first), ",;\t|").delimiter
    except csv.Error:
        sep = ","
    return spark.read.csv(path, header=True, sep=sep, mode="DROPMALFORMED", multiLine=True, escape='"')


def first_existing(directories: Iterable[str], names: Iterable[str], preferred: str | None = None) -> str:
    """The preferred path, else the first directory with one of the names."""
    names = list(names)
    tried = list(dict.fromkeys(([preferred] if preferred else []) + [str(Path(d) / n) for d in directories for n in names]))
    found = next((p for p in tried if Path(p).exists()), None)
    if found is None:
        raise FileNotFoundError("none of these exists:\n" + "\n".join(tried))
    return found


def with_clean_text(df: DataFrame, clean: str = "comment_body_clean_final", raw: str = "comment_body_raw") -> DataFrame:
    """The raw text stands in where a table has no clean one."""
    return df if clean in df.columns else require_columns(df, [raw]).withColumn(clean, F.col(raw))


def first_of_each_column(df: DataFrame) -> DataFrame:
    """Columns that repeat a name (in any case) are dropped; the first stays."""
    names = [f"c{i}" for i in range(len(df.columns))]
    first = {c.lower(): i for i, c in reversed(list(enumerate(df.columns)))}
    return df.toDF(*names).select(*(F.col(names[i]).alias(df.columns[i]) for i in sorted(first.values())))


def text_column(columns: list[str]) -> str | None:
    return next((c for c in columns if any(n in c.lower() for n in TEXT_NAMES) and not any(n in c.lower() for n in NOT_TEXT)), None)


def issue_column(columns: list[str]) -> str | None:
    return next((c for c in columns if any(n in c.lower() for n in ISSUE_NAMES)), None)


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def without_predictions(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """A table without the columns that an earlier run added, so that a new run starts from the same input."""
    return df.drop(*columns)


def move_column_after(df: DataFrame, column: str, after: str) -> DataFrame:
    rest = [c for c in df.columns if c != column]
    at = rest.index(after) + 1
    return df.select(*rest[:at], column, *rest[at:])


def columns_until(df: DataFrame, last: str) -> DataFrame:
    return df.select(*df.columns[: df.columns.index(last) + 1])


def present(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those of the columns that the table has, in the order given."""
    return df.select(*(c for c in columns if c in df.columns))

"""Messy CSV files as typed frames: encoding, delimiter, header, ragged rows, missing values and numbers."""

from __future__ import annotations

import csv
import io
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.stats import q

HEAD_BYTES = 1 << 20
DELIMITERS = (",", ";", "\t", "|")
#: Cell texts that mean "no value".
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
#: Numbers after lower-casing and removal of commas.
NUMBER = r"^\s*[+-]?(inf|infinity|nan|((\d+(_\d+)*)(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([e][+-]?\d+(_\d+)*)?)\s*$"
BOOLS = {"True": 1.0, "False": 0.0}


@dataclass(frozen=True)
class Layout:
    """How a file is read: see layout()."""

    encoding: str
    delimiter: str
    names: tuple[str, ...]
    leading_index: bool
    multiline: bool


def head_bytes(spark: SparkSession, path: str, n: int = HEAD_BYTES) -> bytes:
    """The first bytes of a file in any store that Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def whole_file(spark: SparkSession, path: str) -> tuple[bool, bool, bool]:
    """Of all lines of a file, in one pass: whether some are no UTF-8, hold bytes that only Windows-1252 prints, or have an odd number of quotes."""
    lines = spark.read.text(path).select("value", F.is_valid_utf8("value").alias("ok"), F.col("value").cast("binary").alias("raw"))
    printed = F.hex("raw").rlike("^(..)*?[89][0-9A-F]")
    odd = F.pmod(F.length("raw") - F.length(F.replace(F.decode("raw", "ISO-8859-1"), F.lit('"'), F.lit(""))), F.lit(2)) == 1
    row = lines.agg(F.count_if(~F.col("ok")), F.count_if(~F.col("ok") & printed), F.count_if(odd)).first()
    return row[0] > 0, row[1] > 0, row[2] > 0


def sniff_delimiter(rows_by: dict[str, list[list[str]]]) -> str:
    """The delimiter that splits the header into most fields and most rows into as many; comma where none splits."""

    def score(d: str) -> tuple[float, int]:
        rows = rows_by[d]
        width = len(rows[0]) if rows else 0
        return (0.0, 0) if width < 2 else (sum(len(r) == width for r in rows) / len(rows), width)

    best = max(DELIMITERS, key=lambda d: (score(d)[1] > 0, *score(d), -DELIMITERS.index(d)))
    return best if score(best)[1] else ","


def column_names(header: list[str]) -> list[str]:
    """Names as read: empty ones numbered, repeats suffixed, white space stripped, and unique after that."""
    out: list[str] = []
    for i, raw in enumerate(header):
        base = raw.strip() or f"Unnamed: {i}"
        name, n = base, 0
        while name in out:
            n += 1
            name = f"{base}.{n}"
        out.append(name)
    return out


def layout(spark: SparkSession, path: str, compat: bool = False, delimiter: str | None = None) -> Layout | None:
    """Layout of a file; None if it has no header or no row. compat: comma is taken whatever the file holds.

    The whole file decides the encoding (UTF-8 if all of it is, Windows-1252 if its control bytes 80 to 9F are in use, else latin1) and whether
    quoted fields span lines; such a file is read by one task, as a line break no longer ends a row. Its first bytes decide the rest.
    """
    head = head_bytes(spark, path)
    foreign, windows, multiline = whole_file(spark, path)
    encoding = "UTF-8" if not foreign else "windows-1252" if windows else "ISO-8859-1"
    text = head.decode(encoding, errors="ignore").removeprefix("﻿")
    if len(head) == HEAD_BYTES:
        text = text[: text.rfind("\n") + 1] or text
    rows_by = {d: [r for r in csv.reader(io.StringIO(text), delimiter=d) if r] for d in DELIMITERS}
    d = delimiter or ("," if compat else sniff_delimiter(rows_by))
    rows = rows_by[d]
    if len(rows) < 2:
        return None
    width = len(rows[0])
    leading = all(len(r) == width + 1 for r in rows[1:])
    return Layout(encoding, d, tuple(column_names(rows[0])), leading, multiline)


def read_raw(spark: SparkSession, path: str, how: Layout) -> DataFrame:
    """All cells as strings, with __raw: the text of rows whose width is not the header's, else null."""
    fields = ["__index", *how.names] if how.leading_index else [*how.names]
    schema = T.StructType([*(T.StructField(f"c{i}", T.StringType()) for i in range(len(fields))), T.StructField("__raw", T.StringType())])
    windows = how.encoding == "windows-1252"  # which the reader does not know: read as latin1, then the characters that differ
    reader = spark.read.schema(schema).options(header=True, sep=how.delimiter, encoding="ISO-8859-1" if windows else how.encoding, multiLine=how.multiline, mode="PERMISSIVE", columnNameOfCorruptRecord="__raw", quote='"', escape='"', enforceSchema=True, columnPruning=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    raw = reader.csv(path)
    if not windows:
        return raw
    same = {c: bytes([c]).decode("windows-1252", errors="ignore") for c in range(0x80, 0xA0)}
    return raw.select(*[F.translate(c, "".join(chr(k) for k, v in same.items() if v), "".join(same.values())).alias(c) for c in raw.columns])


def _too_long(raw: Column, width: int, delimiter: str) -> Column:
    """Whether a flagged row has more fields than the header, quoted delimiters aside."""
    unquoted = F.regexp_replace(raw, r'"([^"]|"")*"', "")
    return F.size(F.split(unquoted, re.escape(delimiter), -1)) > width


def missing_to_null(x: Column) -> Column:
    return F.when(~x.isin(*NA_TOKENS), x)


def to_number(x: Column) -> Column:
    """A cell as double: commas go, then Python's number grammar; True and False are 1 and 0; else null."""
    plain = F.lower(F.replace(x, F.lit(","), F.lit("")))
    cast = F.when(plain.rlike(NUMBER), F.regexp_replace(F.trim(plain), "_", "").try_cast("double"))
    return F.when(x == "True", F.lit(1.0)).when(x == "False", F.lit(0.0)).otherwise(cast)


def coerce_numbers(df: DataFrame) -> DataFrame:
    """Each string column becomes double if all its values are numbers, or all are True or False; others stay. One pass decides.

    NaN results are null, as a missing number is.
    """
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    is_bool = lambda c: q(c).isin(*BOOLS)
    bad = [F.count_if(q(c).isNotNull() & (to_number(q(c)).isNull() | is_bool(c))) for c in texts]
    not_bool = [F.count_if(q(c).isNotNull() & ~is_bool(c)) for c in texts]
    row = df.agg(*[F.least(a, b).alias(f"b{i}") for i, (a, b) in enumerate(zip(bad, not_bool, strict=True))]).first()
    numeric = {c for i, c in enumerate(texts) if row[i] == 0}

    def cell(f: T.StructField) -> Column:
        if f.name in numeric:
            return F.nanvl(to_number(q(f.name)), F.lit(None).cast("double")).alias(f.name)
        if isinstance(f.dataType, (T.NumericType, T.BooleanType)):
            return q(f.name).cast("double").alias(f.name)
        return q(f.name)

    return df.select(*map(cell, df.schema))


def read_csv(spark: SparkSession, path: str, compat: bool = False, numbers: bool = True) -> DataFrame | None:
    """A CSV file as a frame of double and string columns; None where it has no data row.

    Default: the delimiter is sniffed, short rows are padded with null, long rows are left out, and a file whose
    rows all have one field more than the header loses that leading index. compat: the delimiter is a comma,
    and a file with a long row is read as one text column named by the whole header line, as its data are.
    """
    how = layout(spark, path, compat)
    if how is None:
        return None
    raw = read_raw(spark, path, how)
    width = len(how.names) + how.leading_index
    long = _too_long(F.col("__raw"), width, how.delimiter)
    whole = raw.withColumn("__h", F.xxhash64(*[f"c{i}" for i in range(width)]))  # all columns, so that rows are parsed whole
    if compat and not whole.where(long & (F.col("__h") != 0)).isEmpty():
        how = layout(spark, path, compat, ";")
        raw, width = read_raw(spark, path, how), len(how.names) + how.leading_index
    kept = raw.where(F.col("__raw").isNull() | ~_too_long(F.col("__raw"), width, how.delimiter))
    skip = int(how.leading_index)
    cells = [missing_to_null(F.col(f"c{i + skip}")).alias(n) for i, n in enumerate(how.names)]
    # a blank line is no row
    blank = F.forall(F.array(*[F.col(f"c{i}") for i in range(width)]), lambda x: x.isNull()) & F.coalesce(F.trim(F.col("__raw")) == "", F.lit(width > 1))
    df = kept.where(~blank).select(*cells)
    if df.isEmpty():
        return None
    return coerce_numbers(df) if numbers else df

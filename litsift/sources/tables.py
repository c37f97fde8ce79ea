"""Reading and writing record tables: CSV, Excel, Parquet."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from datetime import date, datetime, timedelta
from io import BytesIO
from itertools import islice
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that a CSV reader takes as missing.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def with_nulls(df: DataFrame) -> DataFrame:
    """Missing-value texts and NaN as null."""
    kinds = {f.name: f.dataType for f in df.schema}
    out = {c: F.when(~F.col(c).isin(*MISSING), F.col(c)) for c, k in kinds.items() if isinstance(k, T.StringType)}
    out |= {c: F.nanvl(F.col(c), F.lit(None).cast(k)) for c, k in kinds.items() if isinstance(k, (T.DoubleType, T.FloatType))}
    return df.withColumns(out) if out else df


def load_data(spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = True) -> DataFrame:
    """Parquet by its suffix, CSV by '.csv' (types inferred without a schema), anything else as the first sheet of a workbook.

    A CSV file whose quoted fields may hold line ends can't be split, so one task reads it; with multi_line=False large files are split.
    """
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".csv"):
        reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
        return with_nulls(reader.schema(schema).csv(path)) if schema else typed(with_nulls(reader.option("inferSchema", True).csv(path)))
    return read_xlsx(spark, path)


def typed(df: DataFrame) -> DataFrame:
    """Text columns that hold only numbers beside missing values, as longs or doubles; one pass over the text columns."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not names:
        return df
    as_kind = lambda c, kind: F.col(f"`{c}`").try_cast(kind)
    plain = "^[+-]?[0-9]+$"
    counts = [x for i, c in enumerate(names) for x in (F.count(f"`{c}`").alias(f"n{i}"), F.count(F.when(F.col(f"`{c}`").rlike(plain), as_kind(c, "long"))).alias(f"l{i}"), F.count(as_kind(c, "double")).alias(f"d{i}"))]
    row = df.agg(*counts).first()
    kinds = {c: "long" if row[f"l{i}"] == row[f"n{i}"] else "double" for i, c in enumerate(names) if row[f"n{i}"] and row[f"n{i}"] in (row[f"l{i}"], row[f"d{i}"])}
    return df.withColumns({c: as_kind(c, k) for c, k in kinds.items()}) if kinds else df


# Numbers of the built-in formats that show dates and times.
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])


def date_styles(styles: bytes) -> set[int]:
    """The cell styles that show a number as a date or time."""
    root = ElementTree.fromstring(styles)
    plain = lambda code: re.sub(r'"[^"]*"|\\.|\[[^\]]*\]|General', "", code)
    own = {int(f.get("numFmtId")) for f in root.iter(f"{NS}numFmt") if re.search("[dmyhs]", plain(f.get("formatCode") or ""), re.IGNORECASE)}
    cell_formats = root.find(f"{NS}cellXfs")
    return {i for i, x in enumerate(cell_formats if cell_formats is not None else ()) if int(x.get("numFmtId") or 0) in own | DATE_FORMATS}


def date_of(serial: float, from_1904: bool) -> datetime:
    """The date of a workbook's day count, to the millisecond; the count from 1900 has a 29 February 1900 that never was."""
    base = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 31 if serial < 60 else 30)
    return base + timedelta(milliseconds=round(serial * 86_400_000))


def cells(data: bytes) -> Iterator[list]:
    """Rows of the first sheet of a workbook: texts, floats, booleans and datetimes."""
    with zipfile.ZipFile(BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{NS}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{NS}si")]
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        about = book.find(f"{NS}workbookPr")
        from_1904 = about is not None and about.get("date1904") in ("1", "true")
        dates = date_styles(z.read("xl/styles.xml")) if "xl/styles.xml" in names else set()
        first = next(book.iter(f"{NS}sheet"))  # in the order of the workbook's tabs
        link = next(v for k, v in first.attrib.items() if k.endswith("}id"))
        target = next(r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")) if r.get("Id") == link)
        sheet = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        for row in ElementTree.fromstring(z.read(sheet)).iter(f"{NS}row"):
            out: list = []
            for c in row.iter(f"{NS}c"):
                letters = re.match(r"[A-Z]+", c.get("r") or "")
                at = 0
                for ch in letters[0] if letters else "":
                    at = at * 26 + ord(ch) - 64
                out += [None] * ((at or len(out) + 1) - 1 - len(out))
                v, kind = c.find(f"{NS}v"), c.get("t")
                if kind == "inlineStr":
                    out.append("".join(t.text or "" for t in c.iter(f"{NS}t")))
                elif v is None or v.text is None:
                    out.append(None)
                else:
                    number = float(v.text) if kind in (None, "n", "b") else None
                    if kind == "b":
                        out.append(bool(number))
                    elif kind == "d":
                        out.append(datetime.fromisoformat(v.text))
                    elif number is None:
                        out.append(shared[int(v.text)] if kind == "s" else v.text)
                    else:
                        out.append(date_of(number, from_1904) if int(c.get("s") or 0) in dates else number)
            yield out


def marked(v: object) -> str | None:
    """A cell as a text whose first character tells its kind."""
    if v is None:
        return None
    return "?" + str(v) if isinstance(v, bool) else "#" + repr(v) if isinstance(v, float) else "@" + v.isoformat(" ") if isinstance(v, datetime) else "'" + str(v)


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet. A workbook is one file of at most 1,048,576 rows, so one task parses it; only the header and the kinds of its columns come to the driver.

    Columns of numbers are longs or doubles, those of dates timestamps, those of booleans booleans, all others texts; a
    column without a name is column_i.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content").to_pylist():
                rows = cells(data)
                while part := list(islice(rows, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array([[marked(v) for v in r] for r in part], pa.list_(pa.string()))], ["cells"])

    parsed = spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, "cells array<string>").withColumn("at", F.monotonically_increasing_id())
    top = parsed.orderBy("at").limit(1).collect()
    if not top:
        return spark.createDataFrame([], T.StructType([]))
    head = [f"column_{i}" if h is None else h[1:] for i, h in enumerate(top[0]["cells"])]
    body = parsed.where(F.col("at") > top[0]["at"])
    cell = [F.get("cells", F.lit(i)) for i in range(len(head))]
    value = [F.substr(c, F.lit(2)) for c in cell]
    number = [v.try_cast("double") for v in value]
    of = lambda i, mark: F.count_if(F.startswith(cell[i], F.lit(mark)))
    counts = [x for i, c in enumerate(cell) for x in (F.count(c).alias(f"n{i}"), of(i, "#").alias(f"f{i}"), of(i, "@").alias(f"d{i}"), of(i, "?").alias(f"b{i}"), F.count_if(F.startswith(c, F.lit("#")) & (number[i] == F.floor(number[i]))).alias(f"w{i}"))]
    row = body.agg(*counts).first() if head else None
    out = []
    for i, h in enumerate(head):
        all_of = {k for k in "fdbw" if row[f"n{i}"] and row[f"{k}{i}"] == row[f"n{i}"]}
        kind = "long" if "w" in all_of else "double" if "f" in all_of else "timestamp_ntz" if "d" in all_of else "boolean" if "b" in all_of else None
        out.append((number[i].cast(kind) if kind in ("long", "double") else value[i].cast(kind) if kind else value[i]).alias(h))
    return body.orderBy("at").select(*out)


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as text, for CSV and sheets; an empty list as ''."""
    return df.withColumns({f.name: F.when(F.size(f.name) > 0, F.col(f.name).cast("string")).otherwise("") if isinstance(f.dataType, T.ArrayType) else F.to_json(f.name) for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))})


def write_csv(df: DataFrame, path: str) -> None:
    flat(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_xlsx(df: DataFrame, path: str, sheet: str = "Screening Results", widths: dict[str, int] | None = None, head_green: set[str] | None = None, yellow: dict[str, str] | None = None, freeze: str | None = None, most: int = 1_048_575) -> None:
    """One sheet, for people to read: at most `most` rows, or ValueError. yellow: column to the count column that makes its cells stand out."""
    rows = flat(df).limit(most + 1).collect()  # a sheet's size
    if len(rows) > most:
        raise ValueError(f"a sheet holds {most} rows")
    names, widths, head_green, yellow = df.columns, widths or {}, head_green or set(), yellow or {}

    def name_of(i: int) -> str:
        out = ""
        while i >= 0:
            out, i = chr(65 + i % 26) + out, i // 26 - 1
        return out

    def cell(r: int, i: int, v: object, style: int) -> str:
        at = f'r="{name_of(i)}{r}" s="{style}"'
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c {at} t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f"<c {at}><v>{v}</v></c>"
        if isinstance(v, date):
            day = v if isinstance(v, datetime) else datetime(v.year, v.month, v.day)
            return f'<c r="{name_of(i)}{r}" s="3"><v>{(day.replace(tzinfo=None) - datetime(1899, 12, 30)) / timedelta(days=1)!r}</v></c>'
        safe = escape(re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v)))
        return f'<c {at} t="inlineStr"><is><t xml:space="preserve">{safe}</t></is></c>'

    longest = [min(max([len(n), *(len(str(r[n])) for r in rows if r[n] is not None)]) + 2, 100) for n in names]
    columns = "".join(f'<col min="{i + 1}" max="{i + 1}" width="{widths.get(n, longest[i])}" customWidth="1"/>' for i, n in enumerate(names))
    lines = ['<row r="1">' + "".join(cell(1, i, n, 1 if n in head_green else 0) for i, n in enumerate(names)) + "</row>"]
    for k, r in enumerate(rows, 2):
        lines.append(f'<row r="{k}">' + "".join(cell(k, i, r[n], 2 if n in yellow and (r[yellow[n]] or 0) > 0 else 0) for i, n in enumerate(names)) + "</row>")
    view = ""
    if freeze:
        letters, row = re.fullmatch(r"([A-Z])(\d+)", freeze).groups()
        view = f'<sheetViews><sheetView workbookViewId="0"><pane xSplit="{ord(letters) - 65}" ySplit="{int(row) - 1}" topLeftCell="{freeze}" activePane="bottomRight" state="frozen"/></sheetView></sheetViews>'
    main = NS[1:-1]
    kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    fills = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="{c}"/></patternFill></fill>' for c in ("FF90EE90", "FFFFFF00"))
    office = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    files = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{office}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{office}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{office}.styles+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{kind}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{kind}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{kind}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{kind}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{main}"><fonts count="2"><font/><font><b/></font></fonts><fills count="4"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{fills}</fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="4"><xf/><xf fontId="1" fillId="2" applyFill="1" applyFont="1"/><xf fontId="1" fillId="3" applyFill="1" applyFont="1"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}">{view}<cols>{columns}</cols><sheetData>{"".join(lines)}</sheetData></worksheet>',
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in files.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + body)


def save_sample_xlsx(sample: DataFrame, path: str, patterns: dict[str, str]) -> None:
    """A coding sample as a sheet: green heads for label columns, yellow count cells where a pattern was found."""
    widths = {"title": 50, "abstract": 80, "keywords": 40, "notes": 40} | {f"{k}_pattern_snippets": 60 for k in patterns}
    write_xlsx(sample, path, "Sample", widths, set(patterns), {c: c for c in (f"{k}_pattern_count" for k in patterns) if c in sample.columns}, "D2")


def screen_file(spark: SparkSession, path: str, criteria: dict[str, dict], output: str | None = None, **options) -> DataFrame:
    """Screens a file and writes the result: as one sheet "Screening Results" (by default screened.xlsx beside the input), or as CSV or Parquet by the suffix."""
    from litsift.operators.screening import regex_screen

    out = regex_screen(load_data(spark, path), criteria, **options)
    output = output or f"{path.rsplit('/', 1)[0]}/screened.xlsx" if "/" in path or output else "screened.xlsx"
    if output.endswith(".parquet"):
        out.write.mode("overwrite").parquet(output)
    elif output.endswith(".csv"):
        write_csv(out, output)
    else:
        write_xlsx(out, output)
    return out

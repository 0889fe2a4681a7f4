"""XLSX workbooks with the standard library: a zip of XML parts. The file's bytes come through Spark's ``binaryFile``."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from datetime import date, datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Rows whose values decide the types.
SAMPLE = 1000
#: Number formats of dates and times that workbooks need not define (fixed values).
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
_TYPES = {"int64": T.LongType(), "double": T.DoubleType(), "bool": T.BooleanType(), "string": T.StringType(), "timestamp[us]": T.TimestampNTZType(), "null": T.StringType()}
_EPOCH = datetime(1899, 12, 30)


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


class Workbook:
    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        root = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        self.sheets: list[tuple[str, str]] = []
        self.active = 0
        for x in root.iter():
            if _name(x.tag) == "sheet":
                target = links[next(v for k, v in x.attrib.items() if k.endswith("}id"))]
                self.sheets.append((x.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
            elif _name(x.tag) == "workbookView":
                self.active = int(x.get("activeTab", 0))
        self.texts = []
        if "xl/sharedStrings.xml" in self.zip.namelist():
            for x in ElementTree.fromstring(self.zip.read("xl/sharedStrings.xml")):
                self.texts.append(_text(x))
        self.dates = self._date_styles()

    def _date_styles(self) -> set[int]:
        if "xl/styles.xml" not in self.zip.namelist():
            return set()
        root = ElementTree.fromstring(self.zip.read("xl/styles.xml"))
        own = {int(x.get("numFmtId")): x.get("formatCode", "") for x in root.iter() if _name(x.tag) == "numFmt"}
        formats = _DATE_FORMATS | {k for k, code in own.items() if re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code), re.I)}
        cells = next((x for x in root if _name(x.tag) == "cellXfs"), [])
        return {i for i, x in enumerate(cells) if int(x.get("numFmtId", 0)) in formats}

    def part(self, sheet: str | None) -> str:
        """The part of the active sheet, of a sheet by its place from 0, or by its name."""
        if sheet is None:
            return self.sheets[self.active][1]
        if sheet.isdigit():
            if int(sheet) >= len(self.sheets):
                raise ValueError(f"Sheet index {sheet} out of range: the workbook has {len(self.sheets)} sheet(s)")
            return self.sheets[int(sheet)][1]
        found = dict(self.sheets)
        if sheet not in found:
            raise ValueError(f"Sheet '{sheet}' not found; available sheets: {list(found)}")
        return found[sheet]

    def rows(self, sheet: str | None) -> Iterator[list]:
        """Cached values of each row, from row 1 and column A on."""
        at = 0
        for _, x in ElementTree.iterparse(self.zip.open(self.part(sheet))):
            if _name(x.tag) != "row":
                continue
            number = int(x.get("r", at + 1))
            for _ in range(at + 1, number):
                yield []
            at, values = number, []
            for cell in x:
                column = _column(cell.get("r")) if cell.get("r") else len(values)
                values += [None] * (column - len(values))
                values.append(self._value(cell))
            yield values
            x.clear()

    def _value(self, cell) -> object:
        kind = cell.get("t", "n")
        if kind == "inlineStr":
            return _text(cell)
        value = next((x.text for x in cell if _name(x.tag) == "v"), None)
        if value is None:
            return None
        if kind == "s":
            return self.texts[int(value)]
        if kind == "b":
            return value == "1"
        if kind in ("str", "e"):
            return value
        if kind == "d":
            return datetime.fromisoformat(value)
        if int(cell.get("s", 0)) in self.dates:
            return _EPOCH + timedelta(microseconds=round(float(value) * 86_400_000_000))
        return float(value) if re.search("[.eE]", value) else int(value)


def _text(x) -> str:
    return "".join(t.text or "" for t in x.iter() if _name(t.tag) == "t")


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if c.isalpha():
            n = 26 * n + ord(c.upper()) - 64
    return n - 1


def headers(row: list) -> list[str]:
    """Trimmed names; blank ones become ``column_i``, repeated ones get ``_2``, ``_3`` and so on."""
    out: list[str] = []
    for i, value in enumerate(row, 1):
        base = "" if value is None else str(value).strip()
        base = base or f"column_{i}"
        name, k = base, 1
        while name in out:
            k += 1
            name = f"{base}_{k}"
        out.append(name)
    return out


def kind_of(value: object) -> str | None:
    if value is None:
        return None
    for known, kind in ((bool, "bool"), (int, "int64"), (float, "double"), ((datetime, date), "timestamp[us]")):
        if isinstance(value, known):
            return kind
    return "string"


def merged(a: str | None, b: str | None) -> str | None:
    """The type of a column that has values of two: whole and fractional numbers are fractional, other mixtures text."""
    if a == b or b is None:
        return a
    if a is None:
        return b
    return "double" if {a, b} == {"int64", "double"} else "string"


def _scan(data: bytes, sheet: str | None) -> dict:
    rows = Workbook(data).rows(sheet)
    first = next(rows, None)
    names = headers(first or [])
    kinds: list[str | None] = [None] * len(names)
    for n, row in enumerate(rows):
        if n == SAMPLE:
            break
        for i, value in enumerate(row[: len(names)]):
            kinds[i] = merged(kinds[i], kind_of(value))
    return {"names": names, "kinds": [k or "null" for k in kinds]}


def read(spark: SparkSession, path: str, sheet: str | None = None) -> tuple[DataFrame, dict[str, str]]:
    """(frame, Arrow name of each column's type) of one sheet, whose first row has the names.

    Types follow from the first 1000 rows; a later value that does not fit raises and names its cell. A workbook is one
    file of a bounded size, so one task reads it.
    """
    data = spark.read.format("binaryFile").load(path).select("content")

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"found": [json.dumps(_scan(bytes(x), sheet)) for x in part["content"]]})

    found = json.loads(data.mapInPandas(scan, "found string").first()["found"])
    names, kinds = found["names"], found["kinds"]
    schema = T.StructType([T.StructField(n, _TYPES[k]) for n, k in zip(names, kinds, strict=True)])

    def values(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for x in part["content"]:
                held: list[list] = []
                rows = Workbook(bytes(x)).rows(sheet)
                next(rows, None)
                for n, row in enumerate(rows, 2):
                    row = [*row[: len(names)], *[None] * (len(names) - len(row))]
                    held.append([_fitted(v, k, n, c) for v, k, c in zip(row, kinds, names, strict=True)])
                    if len(held) == SAMPLE:
                        yield pd.DataFrame(held, columns=names, dtype=object)
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=names, dtype=object)

    frame = data.mapInPandas(values, schema) if names else spark.createDataFrame([], schema)
    return frame, dict(zip(names, kinds, strict=True))


def _fitted(value: object, kind: str, row: int, column: str) -> object:
    if value is None:
        return None
    own = kind_of(value)
    if kind in ("string", "null"):
        return str(value)
    if own == kind:
        return value
    if kind == "double" and own == "int64":
        return float(value)
    if kind == "int64" and own == "double" and float(value).is_integer():
        return int(value)
    raise ValueError(f"row {row}, column {column}: {value!r} is not {kind}")

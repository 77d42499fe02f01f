"""Spreadsheets (.xlsx) as a Spark data source and a small writer, by the standard library alone."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import StructType

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _column(reference: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]+", reference)[0]:
        number = number * 26 + ord(letter) - 64
    return number - 1


def sheet_rows(content: bytes, sheet: str | None = None) -> list[list[str | None]]:
    """The cells of a sheet, the first without a name, as texts; missing cells are None."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
        sheets = {s.get("name"): s.get(f"{_REL}id") for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")}
        if sheet is not None and sheet not in sheets:
            raise ValueError(f"no sheet {sheet!r}; there are {sorted(sheets)}")
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        target = targets[sheets[sheet] if sheet else next(iter(sheets.values()))].lstrip("/")
        tree = ElementTree.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}"))
    rows = []
    for row in tree.iter(f"{_MAIN}row"):
        cells: list[str | None] = []
        for i, cell in enumerate(row.iter(f"{_MAIN}c")):
            at = _column(cell.get("r")) if cell.get("r") else i
            cells += [None] * (at + 1 - len(cells))
            value, kind = cell.find(f"{_MAIN}v"), cell.get("t")
            if kind == "inlineStr":
                cells[at] = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
            elif value is not None and value.text is not None:
                cells[at] = shared[int(value.text)] if kind == "s" else value.text
        rows.append(cells)
    return rows


def typed(rows: list[list[str | None]]) -> tuple[list[str], list[bool], list[tuple]]:
    """Header, whether each column is numeric throughout, and the rows below."""
    if not rows:
        return [], [], []
    header = [name if name is not None else f"_{i}" for i, name in enumerate(rows[0])]
    body = [(r + [None] * len(header))[: len(header)] for r in rows[1:]]
    body = [r for r in body if any(v is not None for v in r)]

    def numeric(i: int) -> bool:
        found = [r[i] for r in body if r[i] is not None]
        return bool(found) and all(re.fullmatch(r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?", v) for v in found)

    kinds = [numeric(i) for i in range(len(header))]
    return header, kinds, [tuple(float(v) if k and v is not None else v for v, k in zip(r, kinds, strict=True)) for r in body]


class _Reader(DataSourceReader):
    def __init__(self, content: bytes, sheet: str | None) -> None:
        self.content, self.sheet = content, sheet

    def read(self, partition) -> Iterator[tuple]:
        yield from typed(sheet_rows(self.content, self.sheet))[2]


class XlsxSource(DataSource):
    """``spark.read.format("xlsx").option("path", ...).option("sheet", ...)``: a sheet with a header.

    For dimension tables: a sheet is read whole, in one task.
    """

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def _content(self) -> bytes:
        spark = SparkSession.getActiveSession()
        if spark is not None:
            return bytes(spark.read.format("binaryFile").load(self.options["path"]).select("content").first()[0])
        with open(self.options["path"].removeprefix("file://"), "rb") as file:
            return file.read()

    def schema(self) -> str:
        header, kinds, _ = typed(sheet_rows(self._content(), self.options.get("sheet")))
        return ", ".join(f"`{n}` {'double' if k else 'string'}" for n, k in zip(header, kinds, strict=True))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self._content(), self.options.get("sheet"))


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A sheet as a table; its file comes through Spark's file systems to the driver once."""
    content = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    header, kinds, rows = typed(sheet_rows(content, sheet))
    schema = ", ".join(f"`{n}` {'double' if k else 'string'}" for n, k in zip(header, kinds, strict=True))
    return spark.createDataFrame(rows, schema)


def write_xlsx(frame: DataFrame, path: str, sheet: str = "Sheet1", most: int = 100_000) -> None:
    """A small result as a local workbook of one sheet; more than ``most`` rows are an error."""
    rows = frame.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows; write Parquet or CSV")

    def cell(value: object) -> str:
        if value is None:
            return "<c/>"
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return f"<c><v>{value!r}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'

    lines = "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in [frame.columns, *rows])
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    types = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{types}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{types}.worksheet+xml"/></Types>')
        book.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{office}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/worksheets/sheet1.xml", f'{head}<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>{lines}</sheetData></worksheet>')

"""The rule sheet from an .xlsx file, as a Python data source on the standard library alone.

Cells come as text with row_id, the row's place below the header. Shared, inline and formula strings, numbers and rows with gaps are read. The sheet
is given by number or name.
"""

from __future__ import annotations

import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import LongType, StringType, StructField, StructType

from wardcraft.operators.sections import normalise_header

#: Namespaces of the file format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{MAIN}t"))


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(ch) - 64
    return n - 1


def rows(path: str, sheet: str = "0") -> Iterator[list[str | None]]:
    """The rows of a sheet, each as long as its last cell; rows without cells are left out of the file and of these."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    with zipfile.ZipFile(path) as z:
        names = ET.fromstring(z.read("xl/workbook.xml")).findall(f"{MAIN}sheets/{MAIN}sheet")
        found = [s for k, s in enumerate(names) if s.get("name") == sheet or str(k) == sheet]
        if not found:
            raise ValueError(f"no sheet {sheet} in {path}")
        target = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}[found[0].get(f"{REL}id")]
        shared = [_text(x) for x in ET.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{MAIN}si")] if "xl/sharedStrings.xml" in z.namelist() else []
        with z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as f:
            for _, row in ET.iterparse(f):
                if row.tag != f"{MAIN}row":
                    continue
                out: list[str | None] = []
                for cell in row.findall(f"{MAIN}c"):
                    at = _column(cell.get("r")) if cell.get("r") else len(out)
                    out += [None] * (at + 1 - len(out))
                    kind, value = cell.get("t"), cell.findtext(f"{MAIN}v")
                    out[at] = _text(cell) if kind == "inlineStr" else shared[int(value)] if kind == "s" and value is not None else value
                row.clear()
                yield out


class XlsxReader(DataSourceReader):
    def __init__(self, path: str, sheet: str, names: list[str]):
        self.path, self.sheet, self.names = path, sheet, names

    def read(self, partition):
        found = rows(self.path, self.sheet)
        n = len(next(found)) if self.names else 0
        for k, row in enumerate(found):
            yield (k, *[*row, *[None] * n][:n])


class XlsxSource(DataSource):
    """spark.read.format("rsv_xlsx").option("sheet_name", "0").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "rsv_xlsx"

    def _sheet(self) -> str:
        return self.options.get("sheet_name", "0")

    def schema(self) -> StructType:
        header = next(rows(self.options["path"], self._sheet()), [])
        return StructType([StructField("row_id", LongType()), *[StructField(c or f"_{k}", StringType()) for k, c in enumerate(header)]])

    def reader(self, schema: StructType) -> XlsxReader:
        return XlsxReader(self.options["path"], self._sheet(), schema.names)


def load_rsv_xlsx(spark: SparkSession, path: str, sheet_name: int | str = 0) -> DataFrame:
    """The rule sheet with trimmed headers, its required columns checked and renamed, and row_id."""
    spark.dataSource.register(XlsxSource)
    return normalise_header(spark.read.format("rsv_xlsx").option("sheet_name", str(sheet_name)).load(path)).withColumn("row_id", F.col("row_id"))

"""Sheets in .xlsx files (ECMA-376: a zip archive of XML parts), read on the workers, one file per task.

The first sheet of each file is read. Cells are text: shared and inline texts as they are, numbers as written in the file (so dates are serial numbers), booleans as TRUE or FALSE,
errors and formulas by their last value. Absent cells are empty; rows are as wide as the first row of the first file.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import SparkSession

from ..errors import OperationError
from ..frame import Frame

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(reference: str) -> int:
    """Place of the column of a cell such as BC12, from 0."""
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def sheet_rows(data: bytes) -> Iterator[list[str]]:
    """Rows of the first sheet."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = [_text(x) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")] if "xl/sharedStrings.xml" in names else []
        first = next(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = targets[first.get(_REL)]
        with z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as part:
            for _, row in ElementTree.iterparse(part):
                if row.tag != f"{_MAIN}row":
                    continue
                cells: list[str] = []
                for c in row.iter(f"{_MAIN}c"):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    value = c.find(f"{_MAIN}v")
                    text = "" if value is None else value.text or ""
                    kind = c.get("t")
                    if kind == "s" and text:
                        text = shared[int(text)]
                    elif kind == "inlineStr":
                        text = _text(c)
                    elif kind == "b":
                        text = "TRUE" if text == "1" else "FALSE"
                    cells += [""] * (at - len(cells)) + [text]
                yield cells
                row.clear()


def read_sheets(path: str, if_header: bool, spark: SparkSession) -> Frame:
    from .files import repair_names

    files = spark.read.format("binaryFile").load(path)
    head = files.orderBy("path").limit(1).select("content").collect()
    first = next(sheet_rows(bytes(head[0].content)), None) if head else None
    if not first:
        raise OperationError(f"{path} is empty")
    names = repair_names(first) if if_header else [f"Col_{i + 1}" for i in range(len(first))]
    width, skip = len(names), int(if_header)

    def rows(batches):
        for batch in batches:
            for data in batch["content"]:
                found = [([*r, *[""] * width])[:width] for i, r in enumerate(sheet_rows(data)) if i >= skip]
                yield pd.DataFrame(found, columns=[f"_{i}" for i in range(width)], dtype=object)

    return Frame.over(files.select("content").mapInPandas(rows, ", ".join(f"_{i} string" for i in range(width))), names, path)

"""Sources of frames: delimited text, Parquet, ORC and JSON files, sheets, Spark and pandas frames, rows and generators.

Cells of delimited text are strings, an empty cell the empty string; a short row's missing cells are empty, extra cells are
left out. Duplicate names get the suffixes 1, 2, ... on every occurrence, with a warning.
"""

from __future__ import annotations

import warnings
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import OperationError
from ..frame import PLACE, Frame


def ending_of(path: str | None) -> str:
    name = (path or "").rstrip("/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def repair_names(names: list[str]) -> list[str]:
    counts, seen = Counter(names), Counter()
    out = []
    for n in names:
        if counts[n] > 1:
            seen[n] += 1
            n = f"{n}{seen[n]}"
        out.append(n)
    if out != names:
        warnings.warn(f"duplicate column names were given numbers: {out}", stacklevel=2)
    return repair_names(out) if len(set(out)) < len(out) else out


def _session(spark: SparkSession | None) -> SparkSession:
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        raise OperationError("no Spark session is active")
    return spark


def read_text(path: str, if_header: bool = True, sep: str = ",", multi_line: bool = False, spark: SparkSession | None = None) -> Frame:
    """A delimited file or folder of files, scanned lazily; quoted cells after RFC 4180 (multi_line: with line breaks, then a file isn't split)."""
    spark = _session(spark)
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": multi_line, "mode": "PERMISSIVE", "maxColumns": 100_000}
    first = spark.read.options(**options, header=False).csv(path).head(1)
    if not first:
        raise OperationError(f"{path} is empty")
    names = repair_names([v or "" for v in first[0]]) if if_header else [f"Col_{i + 1}" for i in range(len(first[0]))]
    schema = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(names))])
    df = spark.read.options(**options, header=if_header, enforceSchema=True).schema(schema).csv(path)
    return _over_files(df, [F.coalesce(c, F.lit("")).alias(c) for c in df.columns], names, path, sep=sep)


def _over_files(df: DataFrame, cells: list, names: list[str], path: str, **more) -> Frame:
    """A frame over files. A row's place is that of its file, of its split in the file and of the row in the split."""
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).alias(PLACE)
    return Frame.over(df.select(*cells), names, path, placed=df.select(*cells, place).toDF(*(f"_{i}" for i in range(len(names))), PLACE), **more)


def from_rows(rows: Iterable | Callable[[], Iterable], names: list[str] | None = None, if_header: bool = True, types: str | list[str] = "string", spark: SparkSession | None = None) -> Frame:
    """Rows (sequences of cells). A function that gives them is called on a worker and read lazily, so it may be endless as far as a preview goes."""
    spark = _session(spark)
    lazy = callable(rows)
    source = iter(rows() if lazy else (rows := [list(r) for r in rows]))
    first = next(source, None)
    if first is None and names is None:
        raise OperationError("no rows and no names")
    header = names is None and if_header
    names = list(names) if names is not None else repair_names([str(x) for x in first]) if header else [f"Col_{i + 1}" for i in range(len(first))]
    kinds = [types] * len(names) if isinstance(types, str) else list(types)
    schema = ", ".join(f"_{i} {k}" for i, k in enumerate(kinds))
    skip, width = int(header), len(names)
    as_text = [k == "string" for k in kinds]

    def cells(row):
        row = [*row[:width], *[None] * (width - len(row))]
        return [str(v) if t and v is not None else v for v, t in zip(row, as_text, strict=True)]

    if not lazy:
        return Frame.over(spark.createDataFrame([tuple(cells(r)) for r in rows[skip:]], schema), names)

    def produce(batches):
        import itertools

        import pandas as pd

        for _ in batches:
            it = itertools.islice(iter(rows()), skip, None)
            while part := list(itertools.islice(it, 300)):
                yield pd.DataFrame([cells(list(r)) for r in part], columns=[f"_{i}" for i in range(width)])

    return Frame.over(spark.range(0, 1, 1, 1).mapInPandas(produce, schema), names)


@dataclass(frozen=True)
class Source:
    """A user's own source: what reads it and what writes rows like it. rows: rows, a function that gives them, or a Spark frame; output: a row of text cells to a line;
    size: bytes, if known; path: where it lies, if anywhere (its ending is that of outputs that are written by `output`)."""

    rows: object
    output: Callable | None = None
    size: int | None = None
    path: str | None = None
    sep: str | None = None


def dataframe(source, if_header: bool = True, sep: str | None = None, spark: SparkSession | None = None, **options) -> Frame:
    """A frame over a path (by its ending: .parquet, .orc, .json, .xlsx, else delimited text), a Spark or pandas frame, rows, a function that gives rows, or a Source."""
    if isinstance(source, Frame):
        return source
    if isinstance(source, Source):
        made = dataframe(source.rows, if_header, sep, spark, **options)
        return replace(made, path=source.path or made.path, output=source.output, size=source.size if source.size is not None else made.size, sep=source.sep or made.sep)
    if isinstance(source, DataFrame):
        return Frame.over(source)
    if isinstance(source, str):
        ending = ending_of(source)
        if ending in ("parquet", "json", "orc"):
            df = _session(spark).read.format(ending).load(source)
            plain = df.toDF(*(f"_{i}" for i in range(len(df.columns))))
            return _over_files(plain, list(plain.columns), df.columns, source)
        if ending == "xlsx":
            from .sheets import read_sheets

            return read_sheets(source, if_header, _session(spark))
        return read_text(source, if_header, sep or ("\t" if ending == "tsv" else ","), spark=spark, **options)
    if hasattr(source, "to_dict") and hasattr(source, "columns"):  # pandas
        return Frame.over(_session(spark).createDataFrame(source))
    return from_rows(source, if_header=if_header, spark=spark, **options)


def size_in_bytes(frame: Frame) -> int | None:
    """Bytes of the frame's files, as its source or the file system states them; null for other sources."""
    if frame.size is not None:
        return frame.size
    if frame.path is None:
        return None
    spark = frame.source.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(frame.path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()

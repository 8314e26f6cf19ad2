"""Results of frames: one text file, a folder of files, or rows in memory.

The format is that of the path's ending: .parquet, .orc and .json are folders of typed columns, all else is text, delimited as the source is if its path ends alike, by tabs for .tsv, else by commas.
A single text file is computed in parallel: every task writes its part, and the parts are put one after the other, in the order of the plan's
partitions, behind the header; the file system joins them itself where it can. Where it can't, the driver copies up to COPIED bytes; a greater result stays a folder of parts
at the path, as with partitioned=True. Either is read as the same frame.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import OperationError


#: Bytes that the driver copies into a single file at most, if the file system can't join files.
COPIED = 1 << 30
_TYPED = ("parquet", "orc", "json")


def _chosen(names: list[str], select, exclude) -> list[int]:
    if select is not None and exclude is not None:
        raise OperationError("either select or exclude can be given")
    wanted = names if select is None else [select] if isinstance(select, str) else list(select)
    dropped = [] if exclude is None else [exclude] if isinstance(exclude, str) else list(exclude)
    if missing := [c for c in (*wanted, *dropped) if c not in names]:
        raise OperationError(f"no columns {missing}; there are {names}")
    places = [names.index(c) for c in wanted if c not in dropped]
    if not places:
        raise OperationError("at least one column must remain")
    return places


def _melted(df: DataFrame, melt: Callable) -> DataFrame:
    """Each row of text becomes the rows that melt(list of cells) gives; all of the same length."""
    sample = df.limit(1).collect()
    width = len(next(iter(melt(list(sample[0]))), list(sample[0]))) if sample else len(df.columns)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [["" if v is None else str(v) for v in out] for row in pdf.itertuples(index=False) for out in melt([None if v is None else v for v in row])]
            yield pd.DataFrame(rows, columns=[f"m{i}" for i in range(width)], dtype=object)

    return df.mapInPandas(run, ", ".join(f"m{i} string" for i in range(width)))


def compute(
    frame,
    path: str | None = None,
    *,
    exception: bool = False,
    order: bool = False,
    select=None,
    exclude=None,
    header: bool | list[str] = True,
    melt: Callable[[list], list] | None = None,
    output: Callable[[list[Column]], Column] | None = None,
    sep: str | None = None,
    workers: int | None = None,
    in_memory: bool = False,
    partitioned: bool = False,
):
    """exception: a failing cell ends the job instead of being null. order: rows in the source's order, by their places in its files (sources that aren't files keep the order of their partitions; grouped and joined results have none, as they have no source rows). header: names, or whether they are
    written. melt: a row of text to rows. output: the row as one text column, instead of a delimited line; a source's own writer is taken for paths that end as its own does. sep: instead of the delimiter
    that the path's ending gives. workers: at most so many tasks write; without effect on an ordered result. in_memory is accepted and without effect (Spark decides). Without path: a list of rows of text, header first."""
    from ..frame import Frame
    from .files import dataframe, ending_of

    names = frame.get_col_names()
    places = _chosen(names, select, exclude)
    if path is not None and frame_paths(frame) & {_full(frame, path)}:
        raise OperationError(f"{path} is an input of this computation")
    ending, kept = ending_of(path), isinstance(frame, Frame) and ending_of(frame.path)
    typed = path is not None and ending in _TYPED and output is None
    ordered = isinstance(frame, Frame) and (order or bool(frame.order))
    if isinstance(frame, Frame) and ending == kept and output is None and frame.output is not None:
        output = frame.output
    if sep is None:
        sep = frame.sep if isinstance(frame, Frame) and ending == kept and frame.sep else "\t" if ending == "tsv" else ","
    df = frame.in_source_order(exception, not typed) if ordered else frame.to_df(strict=exception, formatted=not typed)
    plain = df.toDF(*(f"c{i}" for i in range(len(names))))
    plain = plain.select(*(f"c{i}" for i in places))
    titles = [names[i] for i in places]
    if melt:
        if not isinstance(frame, Frame) or frame.keys or frame.aggs:
            raise OperationError("melt applies to plain frames")
        plain = _melted(plain, melt)
        titles = titles if len(titles) == len(plain.columns) else [f"Col_{i + 1}" for i in range(len(plain.columns))]
    if isinstance(header, (list, tuple)):
        if len(header) != len(plain.columns):
            raise OperationError("header must have a name for every column")
        titles = list(header)
    if path is None:
        rows = [list(r) for r in plain.collect()]
        return [titles, *rows] if header is not False else rows
    if workers and not ordered:
        plain = plain.coalesce(workers)
    if typed:
        plain.toDF(*titles).write.format(ending).mode("overwrite").save(path)
        return dataframe(path, spark=df.sparkSession)
    first = None if header is False else titles
    line = output([F.col(c) for c in plain.columns]) if output else F.to_csv(F.struct(*plain.columns), {"sep": sep, "escape": '"', "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
    write_lines(plain.select(F.coalesce(line, F.lit("")).alias("value")), path, None if first is None else _line(first, sep), partitioned)
    return frame_over(path, header is not False, sep, frame, titles)


def frame_over(path: str, with_header: bool, sep: str, frame, titles: list[str]):
    """A frame over what was written, under its names."""
    from .files import read_text

    try:
        new = read_text(path, with_header, sep, spark=_frame_df(frame).sparkSession)
    except OperationError:  # nothing was written: no rows and no header
        return None
    if not with_header and len(new.names) == len(titles):
        for old, name in zip(list(new.names), titles, strict=True):
            new = new.rename_col(old, name) if name not in new.outputs else new
    return new


def _line(cells: list[str], sep: str) -> str:
    return sep.join('"' + c.replace('"', '""') + '"' if any(x in c for x in (sep, '"', "\n", "\r")) else c for c in cells)


def _frame_df(frame) -> DataFrame:
    return frame.source if hasattr(frame, "source") else frame.df


def frame_paths(frame) -> set[str]:
    own = [frame] if hasattr(frame, "path") else [frame.left, frame.right]
    return {_full(f, f.path) for f in own if f.path}


def _full(frame, path: str) -> str:
    spark = _frame_df(frame).sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/")


def _headed(lines: DataFrame, header: str | None) -> DataFrame:
    """The lines with the header before the first one of each partition."""
    if header is None:
        return lines
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    return lines.select("value", first.alias("first")).select(F.explode(F.when(F.col("first"), F.array(F.lit(header), "value")).otherwise(F.array("value"))).alias("value"))


def _joins(fs, path) -> bool:
    """Whether the file system puts files together itself, so that none of their bytes is read."""
    return fs.hasPathCapability(path, "fs.capability.paths.concat")


def write_lines(lines: DataFrame, path: str, header: str | None, partitioned: bool = False, copied: int = COPIED) -> None:
    """Lines to one file (parts written in parallel, then joined in order) or to a folder of parts, each with the header."""
    spark = lines.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new = jvm.org.apache.hadoop.fs.Path
    target = new(path)
    fs = target.getFileSystem(conf)
    head = b"" if header is None else (header + "\n").encode()
    parent = target.getParent()
    scratch = new(parent, f".quern-{uuid.uuid4().hex}") if parent else new(f".quern-{uuid.uuid4().hex}")
    folder, joined = new(scratch, "parts"), new(scratch, "joined")

    def create(at, content: bytes):
        out = fs.create(at, True)
        if content:
            out.write(bytearray(content))
        return out

    try:
        itself = not partitioned and _joins(fs, folder)
        (lines if itself else _headed(lines, header)).write.text(folder.toString())
        parts = sorted((f.getPath().toString(), f.getLen()) for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-"))
        parts = [(new(p), n) for p, n in parts if n]
        if itself:
            create(joined, head).close()
            several = spark.sparkContext._gateway.new_array(new, len(parts))
            for i, (p, _) in enumerate(parts):
                several[i] = p
            if parts:
                fs.concat(joined, several)
        elif partitioned or sum(n for _, n in parts) > copied:
            if head and not parts:
                create(new(folder, "part-header"), head).close()
            joined = folder
        else:
            out = create(joined, head)
            try:
                for p, _ in parts:
                    data = fs.open(p)
                    data.seek(len(head))
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(data, out, 1 << 20, False)
                    data.close()
            finally:
                out.close()
        fs.delete(target, True)
        if not fs.rename(joined, target):
            raise OSError(f"can't write {path}")
    finally:
        fs.delete(scratch, True)

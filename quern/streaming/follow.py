"""A frame is a specification, so it compiles over a streaming source as it does over files.

Row pipelines stream in append mode; grouped frames with scalar aggregates in complete or update mode. Listing, opaque and folding
aggregates, and sorting without grouping, have no streaming form in Spark; starting such a query raises Spark's error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import Frame


def over_stream(frame: Frame, stream: DataFrame, strict: bool = False, formatted: bool = False) -> DataFrame:
    """The frame's plan over a streaming DataFrame whose columns are, by position, those of the frame's source."""
    if len(stream.columns) != len(frame.source.columns):
        raise ValueError(f"the stream has {len(stream.columns)} columns, the frame's source {len(frame.source.columns)}")
    return frame.to_df(strict=strict, formatted=formatted, df=stream.toDF(*frame.source.columns))


def follow_folder(frame: Frame, folder: str, sep: str = ",", header: bool = True, files_per_trigger: int | None = None) -> DataFrame:
    """The frame's plan over the delimited files that arrive in a folder, with the cells' rules of sources.files."""
    reader = frame.source.sparkSession.readStream.schema(frame.source.schema).options(sep=sep, quote='"', escape='"', header=header)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    stream = reader.csv(folder)
    return over_stream(frame, stream.select(*(F.coalesce(c, F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in stream.dtypes)))

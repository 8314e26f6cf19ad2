"""Reading the tables of a folder, and small tables into the driver with a proven bound."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns. A name is taken as written, even if another column's differs in case only; of columns of one name the first."""
    at: dict[str, int] = {}
    for i, n in enumerate(df.columns):
        at.setdefault(n, i)
    low: dict[str, int] = {}
    for i, n in enumerate(df.columns):
        low.setdefault(n.lower(), i)
    plain = df.toDF(*(f"_{i}" for i in range(len(df.columns))))
    return plain.select(*(plain[f"_{at.get(n, low.get(n.lower(), n))}"].alias(n) for n in names))


def small_rows(df: DataFrame, most: int, what: str) -> list[Row]:
    """All rows of a configuration table; an error, never a cut, if it has more than `most`."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what} has more than {most} rows and can't be held as configuration")
    return rows

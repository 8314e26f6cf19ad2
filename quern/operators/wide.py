"""Attribute-value rows to one typed row per entity.

Cells are settled first (one value per entity and attribute, aggregated before the shuffle), then gathered per entity with the
exact set of its attributes as signature (characteristic sets). Every signature becomes a dense table of its own, with just its
columns and no gaps, and these tables are united by name, missing columns allowed. Nothing bounds the number of signatures, and a Spark plan
would need a branch for each; so tables are made and united on the workers, out of entities that each task has sorted by signature. Of a signature
that holds most entities each task has a part of the table.

Defined results: names of attributes are compared trimmed, in lower case, with blanks and hyphens as underscores; unknown or null ones,
null or blank entities and unusable values give nothing. Of several usable values of a cell the one of the greatest row number holds (of
equal numbers the greatest text). An entity without any usable value has no row. An empty input gives an empty table with all columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import DECIMAL, WHOLE, strip
from ..sources.tables import columns, small_rows

#: The columns of a wide table are its schema, so their number is bounded.
MOST_COLUMNS = 10_000
#: Types of the wide columns. Whole numbers are kept whole up to 38 digits.
TYPES = {"date": "date", "int": "decimal(38,0)", "double": "double", "boolean": "boolean", "text": "string"}


def attribute_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(c)), r"[\s\-]", "_")


def usable(value: Column, kind: Column) -> Column:
    """Canonical text of a usable value (castable to its type), else null."""
    v = strip(value)
    date = F.when(v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$|^[0-9]{4}/[0-9]{2}/[0-9]{2}$"), F.replace(v, F.lit("/"), F.lit("-")).try_cast("date").cast("string"))
    whole = F.when(v.rlike(WHOLE), F.regexp_extract(v, r"^([+-]?[0-9]+)", 1).try_cast("decimal(38,0)").cast("string"))
    number = F.when(v.rlike(DECIMAL), v.try_cast("double").cast("string"))
    low = F.lower(v)
    flag = F.when(low.isin("true", "yes", "y", "1"), "true").when(low.isin("false", "no", "n", "0"), "false")
    return F.when(kind == "date", date).when(kind == "int", whole).when(kind == "double", number).when(kind == "boolean", flag).when(kind == "text", F.when(v != "", v))


def value_types(measures: DataFrame) -> dict[str, str]:
    """Type of each attribute, in the order of their names; of several types of one name the least holds."""
    known: dict[str, str] = {}
    for r in sorted(small_rows(columns(measures, "measure", "value_type").where("measure is not null"), MOST_COLUMNS, "measures"), key=lambda r: (r.measure, str(r.value_type))):
        known.setdefault(r.measure, r.value_type)
    return {m: kind for m, kind in known.items() if kind in TYPES}


def cells(rows: DataFrame, types: dict[str, str]) -> DataFrame:
    """(family_id, place, value): the settled cells, values as canonical text; place: of the attribute among `types`."""
    kinds = rows.sparkSession.createDataFrame([(m, kind, i) for i, (m, kind) in enumerate(types.items())], "measure string, kind string, place int")
    rows = columns(rows, "row_no", "family_id", "measure", "value")
    entity = strip(F.col("family_id"))
    named = rows.select("row_no", F.when(entity != "", entity).alias("family_id"), attribute_name(F.col("measure")).alias("measure"), "value")
    typed = named.where("family_id is not null and measure is not null").join(F.broadcast(kinds), "measure")  # MOST_COLUMNS rows at most
    typed = typed.withColumn("value", usable(F.col("value"), F.col("kind"))).where("value is not null")
    return typed.groupBy("family_id", "place").agg(F.max(F.struct("row_no", "value")).alias("last")).select("family_id", "place", "last.value")


def characteristic_sets(settled: DataFrame) -> DataFrame:
    """(family_id, signature, values): each entity with the places of its attributes (as text) and their values, sorted by signature within each task."""
    pairs = F.sort_array(F.collect_list(F.struct("place", "value"))).alias("pairs")  # one pair per attribute at most
    sets = settled.groupBy("family_id").agg(pairs).select("family_id", F.array_join(F.col("pairs.place").cast("array<string>"), ",").alias("signature"), F.col("pairs.value").alias("values"))
    return sets.sortWithinPartitions("signature")


def dense_tables(batch: pa.RecordBatch) -> Iterator[pa.Table]:
    """A table for each signature of a batch of characteristic_sets: family_id and the columns of the signature, by their places."""
    entity, signature, values = batch.columns
    if not batch.num_rows:
        return
    codes = pc.dictionary_encode(signature)
    which, flat = codes.indices.to_numpy(), values.flatten()
    begins = np.concatenate(([0], np.flatnonzero(np.diff(which)) + 1, [len(which)]))
    at = 0
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        places = codes.dictionary[int(which[a])].as_py().split(",")
        size = (b - a) * len(places)
        own = flat.slice(at, size)
        dense = [own.take(pa.array(range(j, size, len(places)))) if b - a > 1 else own.slice(j, 1) for j in range(len(places))]
        yield pa.Table.from_arrays([entity.slice(a, b - a), *dense], ["family_id", *places])
        at += size


def united(tables: list[pa.Table], schema: pa.Schema) -> pa.Table:
    """The union of the tables by name; columns that a table lacks are null in its rows."""
    return pa.concat_tables([schema.empty_table(), *tables], promote_options="default").select(schema.names)


def widen(rows: DataFrame, measures: DataFrame) -> DataFrame:
    """One row per family_id, one column of the right type per measure."""
    types = value_types(measures)
    schema = pa.schema([("family_id", pa.string()), *((str(i), pa.string()) for i in range(len(types)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from united(list(dense_tables(batch)), schema).combine_chunks().to_batches()

    wide = characteristic_sets(cells(rows, types)).mapInArrow(run, ", ".join(f"`{n}` string" for n in schema.names))
    return wide.select("family_id", *(F.col(f"`{i}`").cast(TYPES[kind]).alias(m) for i, (m, kind) in enumerate(types.items())))


def filled_cells(wide: DataFrame) -> DataFrame:
    """(family_id, measure, typed_value) of the filled cells of a wide table, values as text."""

    def text(c: str) -> Column:
        kind = wide.schema[c].dataType.typeName()
        return F.format_string("%.2f", F.col(f"`{c}`") + F.lit(0.0)) if kind == "double" else F.col(f"`{c}`").cast("string")

    names = [c for c in wide.columns if c != "family_id"]
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.when(F.col(f"`{c}`").isNotNull(), text(c)).alias("typed_value")) for c in names)))
    return wide.select("family_id", pairs.alias("cell")).select("family_id", "cell.*").where("typed_value is not null")

"""Tables that cut lineage, and size-checked broadcasts, shared by the operators here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import discard, materialise

__all__ = ["BROADCAST_ROWS", "TextsOf", "add_columns", "ascii_lower", "discard", "materialise", "maybe_broadcast"]

#: A table is broadcast by hand only below this many rows, counted beforehand.
BROADCAST_ROWS = 200_000


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a counted table if it is small; else Spark picks the join itself."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def ascii_lower(column):
    """Lower-case A-Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class TextsOf:
    """An Arrow column of strings, made Python strings one at a time."""

    def __init__(self, column):
        self.column = column

    def __len__(self):
        return len(self.column)

    def __iter__(self):
        return (x.as_py() for x in self.column)


def add_columns(df: DataFrame, function, fields: str, reads: list[str]) -> DataFrame:
    """df with the columns of ``fields`` appended, made batch by batch by
    ``function(*columns read, as Arrow arrays) -> [Arrow arrays or lists]``.
    All columns of df pass through unchanged; one of a new column's name gives way."""
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    new = T._parse_datatype_string(fields)
    df = df.drop(*new.names)
    schema = T.StructType(df.schema.fields + new.fields)
    names, kinds = list(df.columns), [f.type for f in to_arrow_schema(new)]
    at = [names.index(x) for x in reads]

    def run(batches):
        for batch in batches:
            made = function(*[batch.column(i) for i in at])
            made = [x.cast(k) if isinstance(x, pa.Array) else pa.array(x, type=k) for x, k in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*names, *new.names])

    return df.mapInArrow(run, schema)

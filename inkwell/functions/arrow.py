"""Python functions of rows over Arrow batches, a few rows at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Most rows, and about the bytes, of a batch that are Python objects at once: a batch has a fixed number of rows, however long these are.
ROWS, BYTES = 256, 1 << 21


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of the batches in parts of at most ROWS rows, fewer where these are long, without a copy."""
    for batch in batches:
        n = max(1, min(ROWS, BYTES * batch.num_rows // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)


def map_rows(df: DataFrame, read: list[str], rows: Callable[[list[dict]], list[dict]], added: str, kept: list[str] = ()) -> DataFrame:
    """Columns `added` of the dicts that rows() makes of the columns read of each slice; what is kept, row by row, goes on as it is."""
    schema = StructType([df.schema[c] for c in kept] + StructType.fromDDL(added).fields)
    kinds = to_arrow_schema(StructType(schema.fields[len(kept) :]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            made = rows(part.select(read).to_pylist())
            columns = [pa.array([r.get(f.name) for r in made], f.type) for f in kinds]
            yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + columns, names=[*kept, *kinds.names])

    return df.select(*dict.fromkeys([*kept, *read])).mapInArrow(run, schema)

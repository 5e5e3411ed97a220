"""Document parsers that the built-in expressions can't state: one pass over the texts in Arrow batches, no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

#: Rows that a task holds before it passes them on.
ROWS = 5_000


def per_document(docs: DataFrame, id_column: str, value_columns: list[str], parse: Callable[..., Iterable[dict]], schema: str) -> DataFrame:
    """The rows that ``parse`` makes of each document's values, with the document's id.

    A task holds one batch and ``ROWS`` rows.  Null values are passed on as None.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = StructType([StructField(id_column, docs.schema[id_column].dataType), *StructType.fromDDL(schema).fields])
    arrow = to_arrow_schema(kind)

    def run(batches):
        rows: list[dict] = []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (id_column, *value_columns)]
            for key, *values in zip(*columns):
                for row in parse(*values):
                    rows.append({id_column: key, **row})
                    if len(rows) >= ROWS:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return docs.select(id_column, *value_columns).mapInArrow(run, kind)

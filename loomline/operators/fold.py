"""Sequential rules as sorted streams: the rows of a key pass one by one through a function of their own.

Rows are dealt by key and sorted inside the partitions, on disk where they must be, and stream through Python in Arrow
batches. A task holds one batch and one key's state, never a key's rows, so cost and memory stay linear and bounded
however many rows a key has. A key's order is the rule itself: its rows cannot be split over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

Step = Callable[[tuple], Iterable[tuple]]


def streamed(rows: DataFrame, keys: list[str], order: list[str], start: Callable[[], Step], schema: T.StructType) -> DataFrame:
    """What each key's function, made by ``start``, gives for its rows in order. A row comes as a tuple of all columns."""
    sorted_rows = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    n, types = len(keys), [to_arrow_type(f.dataType) for f in schema.fields]
    at = [rows.columns.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        step: Step = start()
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = tuple(row[k] for k in at)
                if own != key:
                    key, step = own, start()
                out.extend(step(row))
            columns = list(zip(*out, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema.names)

    assert n
    return sorted_rows.mapInArrow(run, schema)


def fields(rows: DataFrame, names: list[str], **more: T.DataType) -> T.StructType:
    """Schema of some columns of ``rows`` and of new ones."""
    return T.StructType([T.StructField(c, rows.schema[c].dataType) for c in names] + [T.StructField(c, t) for c, t in more.items()])

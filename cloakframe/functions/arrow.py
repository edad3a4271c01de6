"""Row functions over Arrow batches, for what Column expressions cannot say."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def map_tuples(df: DataFrame, rows: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str, batch: int = 1024) -> DataFrame:
    """``rows(iterator of row tuples)`` over each partition; results leave in batches of ``batch`` rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = [(f.name, f.type) for f in to_arrow_schema(StructType.fromDDL(schema))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(part: list[tuple]) -> pa.RecordBatch:
            arrays = [pa.array(c, kind) for c, (_, kind) in zip(zip(*part, strict=True), fields, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, schema=pa.schema([pa.field(n, kind) for n, kind in fields]))

        def incoming() -> Iterator[tuple]:
            for whole in batches:
                for start in range(0, whole.num_rows, 256):
                    yield from zip(*(c.to_pylist() for c in whole.slice(start, 256).columns), strict=True)

        pending: list[tuple] = []
        for row in rows(incoming()):
            pending.append(row)
            if len(pending) >= batch:
                yield packed(pending)
                pending = []
        if pending:
            yield packed(pending)

    return df.mapInArrow(run, schema)

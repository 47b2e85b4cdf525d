"""Arrow plumbing for operators that keep a frame's other columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS = 256  # rows taken from a batch at once: payloads are large, batches are cut


def map_value(df: DataFrame, column: str, make: Callable[[dict], list[dict]], schema: T.StructType | str, keep: list[str]) -> DataFrame:
    """For each row, the rows that ``make`` returns, with the columns ``keep`` repeated.

    ``make`` gets the row as a dict. Results are emitted every ROWS rows or OUT bytes, so
    that memory stays bounded by a few values."""
    extra = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    fields = [df.schema[c] for c in keep] + list(extra.fields)
    out = T.StructType(fields)
    names = [f.name for f in fields]
    inputs = [column, *[c for c in df.columns if c != column]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)

        def emit(rows: list[list]) -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                rows, size = [], 0
                for row in whole.slice(k, ROWS).to_pylist():
                    same = [row[c] for c in keep]
                    for made in make(row):
                        rows.append(same + [made.get(n) for n in names[len(keep) :]])
                        size += sum(len(v) for v in made.values() if isinstance(v, bytes))
                        if size > OUT:
                            yield emit(rows)
                            rows, size = [], 0
                if rows:
                    yield emit(rows)

    return df.select(*inputs).mapInArrow(run, out)


OUT = 32 << 20


@F.pandas_udf(T.BinaryType())
def join_bytes(parts: pd.Series) -> pd.Series:
    """The elements of each array of binaries, one after the other."""
    return parts.map(lambda p: b"".join(p) if p is not None else None)


def binary(df: DataFrame, column: str) -> DataFrame:
    """The payload as binary (strings become UTF-8)."""
    return df.withColumn(column, df[column].cast("binary"))

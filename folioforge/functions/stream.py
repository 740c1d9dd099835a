"""Order-dependent steps over the rows of a key, as one sorted stream a task."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

#: Characters of text and number of rows after which what a task has made is handed on.
CHARS, ROWS = 1 << 22, 4096


def values(column: pa.Array) -> list:
    """Python objects of a column; lists of strings by their flat values."""
    if pa.types.is_list(column.type) and not column.null_count:
        flat, at = column.flatten().to_numpy(zero_copy_only=False).tolist(), column.offsets.to_pylist()
        return [flat[a - at[0] : b - at[0]] for a, b in zip(at, at[1:])]
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces, so that Python objects are made of a few rows at once."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def by_key(rows: DataFrame, key: str, order: str, each: Callable[[list], list[tuple]], schema: str, select: list[str | Column] | None = None) -> DataFrame:
    """each(rows of a key in order, as named tuples) -> tuples of schema, for every key.

    The rows are exchanged and sorted once; a task reads its keys one after another from Arrow batches and holds
    one key's rows and some output.  select, with key among its columns, is computed behind the exchange.
    """
    placed = rows.repartition(key).sortWithinPartitions(key, order)
    placed = placed.select(*select) if select else placed
    names, at = placed.columns, placed.columns.index(key)
    made = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Row = namedtuple("Row", names)
        held, out, chars = [], [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), made)], schema=made)

        for b in slices(batches, 1024):
            for r in map(Row._make, zip(*map(values, b.columns))):
                if held and r[at] != held[0][at]:
                    got = each(held)
                    out += got
                    chars += sum(len(v) for x in got for v in x if isinstance(v, str))
                    held = []
                    if len(out) >= ROWS or chars >= CHARS:
                        yield batch()
                        out, chars = [], 0
                held.append(r)
        if held:
            out += each(held)
        if out:
            yield batch()

    return placed.mapInArrow(run, schema)

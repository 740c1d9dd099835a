"""Suffix-array dedup over bytes, by bucket-pointer refinement (operator 10).

The bucket of a position starts as its q-gram (50 bytes) and is refined with the bucket identifiers of
later offsets: identifiers for h bytes at p and p + h give those for 2 h bytes at p, and each
round reuses the last one's (100, then 200 bytes).  Distributed tables of buckets are sorted on both
identifiers, and buckets of one go; :mod:`repeats` says which positions take part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import core, repeats


def _cut(window: int, schema: pa.Schema, with_bytes: bool):
    def run(batches):
        for batch in batches:
            buf, off = core.text_buffer(batch.column("text"))
            marks = batch.column("marks")
            n_bytes, n_removed, n_spans, digest, kept_bytes = [], [], [], [], []
            for k in range(batch.num_rows):
                own = buf[off[k] : off[k + 1]]
                n_bytes.append(len(own))
                if marks[k].is_valid:
                    gone = repeats.removed(marks[k].values, len(own), window)
                    n_removed.append(int(gone.sum()))
                    n_spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                    own = own[~gone]
                else:
                    n_removed.append(0)
                    n_spans.append(0)
                kept = own.tobytes()
                digest.append(hashlib.sha256(kept).hexdigest())
                if with_bytes:
                    kept_bytes.append(kept)
            columns = [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest, pa.string())]
            if with_bytes:
                columns.append(pa.array(kept_bytes, pa.binary()))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def dedup_byte_strings(docs: DataFrame, window: int = 200, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = True) -> DataFrame:
    """Removes every byte covered by a ``window``-byte string that also starts anywhere else.

    Matches never cross documents; overlapping occurrences count; strings are judged on the
    input.  Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256
    and, with ``with_bytes``, the kept bytes (which a cut inside a character may leave
    without valid UTF-8).

    Null and empty texts have no bytes.  A null id is kept as it is.  Repeated rows count as
    copies of each other.  Other columns of docs are ignored.
    """
    finder = repeats.Finder(window, "byte")
    found = repeats.repeated(core.keyed(docs, id_col, text_col), finder)
    fields = [T.StructField("doc_id", docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())]
    if with_bytes:
        fields.append(T.StructField("kept_bytes", T.BinaryType()))
    schema = T.StructType(fields)
    from pyspark.sql.pandas.types import to_arrow_schema

    return found.select("doc_id", "text", "marks").mapInArrow(_cut(window, to_arrow_schema(schema), with_bytes), schema)

"""Substring dedup over words, by level-wise doubling (operator 7).

Windows repeated at one length alone are extended to twice that length (9, 18, 35 words), until no candidates
survive; see :mod:`repeats` for the levels and the sampling of positions.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import core, repeats


def _cut(window: int, schema: pa.Schema, with_text: bool):
    def run(batches):
        for batch in batches:
            buf, off = core.text_buffer(batch.column("text"))
            marks = batch.column("marks")
            n_words, n_removed, digest, kept_text = [], [], [], []
            for i, j in core.runs(off):
                s, e, n = core.words(buf, off[i : j + 1])
                at = np.r_[0, np.cumsum(n)]
                gone = np.concatenate([repeats.removed(marks[k].values if marks[k].is_valid else None, int(n[k - i]), window) for k in range(i, j)])
                keep = ~gone
                ks, kn = s[keep], (e - s)[keep] + 1
                where = core.ranges(ks, kn)
                np.minimum(where, max(0, len(buf) - 1), out=where)
                out = buf[where]
                out[np.cumsum(kn) - 1] = 0x20
                edge = np.r_[0, np.cumsum(kn)]
                words_before = np.r_[0, np.cumsum(keep)]
                for k in range(j - i):
                    a, b = words_before[at[k]], words_before[at[k + 1]]
                    kept = out[edge[a] : max(edge[a], edge[b] - 1)].tobytes()
                    n_words.append(int(n[k]))
                    n_removed.append(int(n[k] - (b - a)))
                    digest.append(hashlib.sha256(kept).hexdigest())
                    if with_text:
                        kept_text.append(kept.decode("utf-8", "replace"))
            columns = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())]
            if with_text:
                columns.append(pa.array(kept_text, pa.string()))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def dedup_word_windows(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Removes every word covered by a ``window``-word sequence that also starts anywhere else.

    Words are maximal runs without ASCII white space.  Windows are judged on the input, so
    both occurrences of a repeated passage go.  Returns doc_id, n_words, n_removed, kept_sha256
    and, with ``with_text``, the kept words joined by one space.

    Null and empty texts have no words (digest of the empty string).  A null id is kept as it
    is.  Repeated rows count as copies of each other, so texts of at least ``window`` words
    that occur in two rows vanish in both.  Other columns of docs are ignored.
    """
    finder = repeats.Finder(window, "word")
    found = repeats.repeated(core.keyed(docs, id_col, text_col), finder)
    fields = [T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    if with_text:
        fields.append(T.StructField("kept_text", T.StringType()))
    schema = T.StructType(fields)
    from pyspark.sql.pandas.types import to_arrow_schema

    return found.select("doc_id", "text", "marks").mapInArrow(_cut(window, to_arrow_schema(schema), with_text), schema)

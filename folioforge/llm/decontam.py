"""Benchmark decontamination by Wu-Manber multi-pattern search over words (operator 1).

A shift table over blocks of two words says how far a window can move on without missing
an occurrence, so most positions are never looked at.  Where the shift is zero, the bucket of
the window's last block selects test strings, and their words are compared directly.
All documents of a block are scanned in step by numpy, one lane per stretch.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import core
from .core import U64

BLANK = np.ones(256, bool)
BLANK[0x30:0x3A] = BLANK[0x61:0x7B] = BLANK[0x80:] = False
#: Shift table: 2 ** SHIFT_BITS entries.
SHIFT_BITS = 20
#: Windows of test strings start at so many words of a lane.
LANE = 64
#: Windows (of some 200 bytes in a worker) and bytes of their text that one pass broadcasts; a larger set takes more passes.
PASS_WINDOWS, PASS_BYTES = 1 << 18, 32 << 20


class Patterns:
    """Tables of all distinct windows with one number of words, in array buffers.

    The text of window k is buf[start[k] : start[k + 1]], its words parted by blanks.
    """

    def __init__(self, size: int, windows: list[bytes]):
        self.size, self.block = size, min(2, size)
        start = np.r_[0, np.cumsum([len(t) for t in windows])]
        buf = np.frombuffer(b"".join(windows), np.uint8)
        s, e, _ = core.words(buf, start, BLANK)
        ids = core.span_ids(buf, s, e).reshape(-1, size)
        last = self.key(ids[:, size - self.block :])
        self.order = np.argsort(last, kind="stable")
        self.last, self.ids, self.buf, self.start = last[self.order], ids[self.order], buf, start
        self.shift = np.full(1 << SHIFT_BITS, size - self.block + 1, np.uint8)
        for j in range(size - self.block + 1):
            at = self.key(self.ids[:, j : j + self.block]) >> U64(64 - SHIFT_BITS)
            np.minimum.at(self.shift, at.astype(np.int64), size - self.block - j)

    def text(self, pattern: int) -> bytes:
        k = self.order[pattern]
        return self.buf[self.start[k] : self.start[k + 1]].tobytes()

    def key(self, ids: np.ndarray) -> np.ndarray:
        return core.pair(ids[:, 0], ids[:, 1]) if self.block == 2 else core.mix(ids[:, 0])

    def search(self, w: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window starts in w (words of a block's documents) and the pattern that occurs there."""
        n = np.maximum(np.diff(bounds) - self.size + 1, 0)
        lanes = -(-n // LANE)
        first = np.repeat(bounds[:-1], lanes) + LANE * core.ranges(np.zeros(len(lanes)), lanes)
        stop = np.minimum(first + LANE, np.repeat(bounds[:-1] + n, lanes))
        pos, tail, found = first, self.size - self.block, []
        while len(pos):
            k = self.key(np.stack([w[pos + tail + i] for i in range(self.block)], axis=1))
            step = self.shift[(k >> U64(64 - SHIFT_BITS)).astype(np.int64)]
            zero = step == 0
            if zero.any():
                at, kz = pos[zero], k[zero]
                lo, hi = np.searchsorted(self.last, kz, "left"), np.searchsorted(self.last, kz, "right")
                pat = core.ranges(lo, hi - lo)
                at = np.repeat(at, hi - lo)
                for i in range(self.size):
                    same = w[at + i] == self.ids[pat, i]
                    at, pat = at[same], pat[same]
                if len(at):
                    found.append((at, pat))
            pos = pos + np.maximum(step, 1)
            live = pos < stop
            pos, stop = pos[live], stop[live]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(c) for c in zip(*found))


def tables(rows: list[tuple[int, str, object]]) -> list[tuple[Patterns, list[list]]]:
    """Pattern tables by window length of (words, window, item) rows, each with the item ids of every pattern."""
    owners: dict[int, dict[bytes, set]] = {}
    for n, window, item in rows:
        owners.setdefault(n, {}).setdefault(window.encode(), set()).add(item)
    out = []
    for n in sorted(owners):
        windows = sorted(owners[n])
        p = Patterns(n, windows)
        out.append((p, [sorted((x for x in owners[n][windows[k]] if x is not None), key=str) for k in p.order]))
    return out


def windows_of(size: int, item_type: pa.DataType):
    """(words, window, item) of every window of a batch of test items."""

    def run(batches):
        for batch in batches:
            buf, off = core.text_buffer(batch.column("text"))
            items = batch.column("item")
            for k in range(batch.num_rows):
                own = core.LOWER[buf[off[k] : off[k + 1]]]
                s, e, _ = core.words(own, np.array([0, len(own)]), BLANK)
                raw = own.tobytes()
                w = [raw[i:j] for i, j in zip(s, e)]
                for at in range(0, max(1, len(w) - size + 1) if w else 0, 10_000):
                    some = [b" ".join(w[i : i + size]).decode() for i in range(at, min(at + 10_000, max(1, len(w) - size + 1)))]
                    m = len(some)
                    yield pa.RecordBatch.from_arrays([pa.array([min(size, len(w))] * m, pa.int32()), pa.array(some), pa.array([items[k].as_py()] * m, item_type)], names=["n", "window", "item"])

    return run


def _scan(shared, schema: pa.Schema):
    """Adds n_words, n_hit, items, spans and contaminated; items and spans of earlier passes are carried on."""

    def run(batches):
        got = shared.value
        for batch in batches:
            buf, off = core.text_buffer(batch.column("text"))
            earlier = {c: batch.column(c).to_pylist() for c in ("items", "spans") if c in batch.schema.names}
            n_words, hits, items, spans = [], [], [], []
            for i, j in core.runs(off):
                low = core.LOWER[buf[off[i] : off[j]]]
                s, e, n = core.words(low, off[i : j + 1] - off[i], BLANK)
                w = core.span_ids(low, s, e)
                bounds = np.r_[0, np.cumsum(n)]
                of_doc = {d: set(x) for d, x in enumerate(earlier.get("items", [])[i:j]) if x}
                where = {d: list(x) for d, x in enumerate(earlier.get("spans", [])[i:j]) if x}
                for p, owners in got:
                    at, pat = p.search(w, bounds)
                    for a, k in zip(at.tolist(), pat.tolist()):
                        if b" ".join(low[s[a + x] : e[a + x]].tobytes() for x in range(p.size)) == p.text(k):
                            d = int(np.searchsorted(bounds, a, "right")) - 1
                            of_doc.setdefault(d, set()).update(owners[k])
                            where.setdefault(d, []).append([a - int(bounds[d]), a - int(bounds[d]) + p.size])
                edge = np.zeros(len(w) + 1, np.int64)
                for d, x in where.items():
                    lo, hi = (np.array(x) + bounds[d]).T
                    np.add.at(edge, lo, 1)
                    np.add.at(edge, hi, -1)
                hit = np.r_[0, np.cumsum(np.cumsum(edge[:-1]) > 0)]
                n_words += n.tolist()
                hits += (hit[bounds[1:]] - hit[bounds[:-1]]).tolist()
                items += [sorted(of_doc.get(d, ()), key=str) for d in range(j - i)]
                spans += [where.get(d, []) for d in range(j - i)]
            columns = {"n_words": n_words, "n_hit": hits, "items": items, "spans": spans, "contaminated": [h > 0 for h in hits]}
            yield pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) if f.name not in columns else pa.array(columns[f.name], f.type) for f in schema], schema=schema)

    return run


def _searched(source: DataFrame, benchmark: DataFrame, size: int, item_col: str, item_text_col: str, pass_windows: int) -> DataFrame:
    """source (with a column text) and what _scan adds; the texts are never shuffled."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = source.sparkSession
    tests = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text"))
    item_type = T.StringType() if isinstance(tests.schema["item"].dataType, T.NullType) else tests.schema["item"].dataType
    window = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("window", T.StringType()), T.StructField("item", item_type)])
    found = tests.select(F.col("item").cast(item_type).alias("item"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(core.lean(windows_of(size, to_arrow_schema(window)[2].type)), window)
    found = core.materialise(found.distinct())
    total = found.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("window")), F.lit(0)).alias("bytes")).first()
    # pairs of window and item are spread evenly, so one window of many items may be searched in several passes
    passes = max(math.ceil(share) if (share := 1.25 * total[k] / limit) > 1.25 else 1 for k, limit in (("n", pass_windows), ("bytes", PASS_BYTES)))
    added = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(item_type)), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("contaminated", T.BooleanType())]
    own = {f.name for f in added}
    schema = T.StructType([*(f for f in source.schema.fields if f.name not in own), *added])
    source = source.drop(*own)
    for k in range(passes):
        some = found if passes == 1 else found.where(F.pmod(F.xxhash64("window", "item"), F.lit(passes)) == k)
        shared = spark.sparkContext.broadcast(tables([tuple(r) for r in some.collect()]))
        source = source.mapInArrow(core.lean(_scan(shared, to_arrow_schema(schema))), schema)
    return source


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", pass_windows: int = PASS_WINDOWS) -> DataFrame:
    """Words of each document that lie in an occurrence of ``size`` consecutive words of a test item.

    Letters A-Z are lowered; words are runs of digits, letters a-z and non-ASCII characters.
    An item of fewer words is one window.  Returns doc_id, n_words, n_hit, items (ids of the
    items with occurring windows, sorted as strings), spans (their first word and the one
    after their last) and contaminated.

    Null and empty texts have no words, and an item without words occurs nowhere.  Repeated
    rows and items give the same result each; items without an id mark words but aren't listed.
    An empty test set leaves all clean.  Other columns are ignored.

    Windows are made and made distinct by tasks.  Up to ``pass_windows`` pairs of a window and an item (and
    PASS_BYTES of their text) are broadcast at once; more are searched in as many passes as they
    need, so that the broadcast is bounded, whatever repeats in the test set.  The texts are never shuffled.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = _searched(source, benchmark, size, item_col, item_text_col, pass_windows)
    return found.select("doc_id", "n_words", "n_hit", "items", "spans", "contaminated")


def flagged(docs: DataFrame, benchmark: DataFrame, size: int = 10, pass_windows: int = PASS_WINDOWS) -> DataFrame:
    """docs, with all its columns, and ``contaminated``; a column of that name is replaced."""
    columns = [c for c in docs.columns if c != "contaminated"]
    return _searched(docs.select(*columns), benchmark, size, "item_id", "text", pass_windows).select(*columns, "contaminated")


def digest(found: DataFrame) -> DataFrame:
    """The query's columns: items as their number and a digest."""
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), "contaminated")

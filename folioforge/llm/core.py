"""Shared machinery of the training-data operators.

Three ideas carry most operators of this subpackage:

* Arrow blocks.  ``mapInArrow`` hands over whole batches of documents; numpy works on the
  contiguous UTF-8 buffer of a batch, never on one Python string at a time.
* Packed exchange.  Millions of (key, reference) entries travel as a few binary rows, one per
  (task, part), with at most one entry per key and task.  A key that a third of all rows share
  therefore costs one entry per *task*, whatever its number of rows, and never lands
  as a whole in one task.
* Deterministic identities.  Rows are named by hashes of their content, so a recomputed task
  (a lost executor) yields the same rows.
"""

from __future__ import annotations

import atexit
import ctypes
import functools
import shutil
import struct
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Functions of this package are pickled by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__.rsplit(".", 1)[0]])

U64 = np.uint64
K1, K2, K3 = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0xD6E8FEB86659FD93)
#: Bytes of text that one numpy step works on: its arrays stay in cache.
BLOCK = 1 << 18


# --- session


def partitions(spark: SparkSession) -> int:
    """Number of shuffle partitions, which the deployment sizes with its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of text whose entries one part of an exchange gathers in memory.
PART_BYTES = 128 << 20


def parts_for(docs: DataFrame) -> int:
    """Parts of an exchange of docs' entries: the shuffle partitions, and more where a part would get the entries of over PART_BYTES of text."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(partitions(docs.sparkSession), -(-total // PART_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; where none is configured, a local one is made, in local mode only."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        got = tempfile.mkdtemp(prefix="folioforge-")
        atexit.register(shutil.rmtree, got, True)
        spark.conf.set("spark.checkpoint.dir", got)
    return got


def materialise(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared folder and rereads it: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/ff-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made().append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def made() -> list:
    """(session, path) of the tables that materialise wrote and nothing has deleted yet."""
    return worker_cache().setdefault("made", [])


def release(first: int, last: int) -> None:
    """Deletes the tables made() [first:last], which nothing will read again."""
    some = made()[first:last]
    del made()[first:last]
    for spark, path in some:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _clean() -> None:
    while made():
        try:
            release(0, 1)
        except Exception:  # noqa: BLE001 - the session may be gone; files of a shared folder are its owner's then
            pass


atexit.register(_clean)


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker."""
    name = "_folioforge_worker_cache"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__


def lean(run):
    """run (of mapInArrow), after which the worker gives the memory it has freed back to the system.

    Workers outlive their tasks, and malloc and Arrow keep what a task has freed: an executor's idle workers
    would hold the memory of the largest task each has run.
    """

    def lean_run(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return lean_run


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, k0, k1, text: the 80 bits (k0, k1) name a row by its id and text, nulls included."""
    return with_keys(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))).select("doc_id", "k0", "k1", "text")


def with_keys(docs: DataFrame) -> DataFrame:
    """docs and (k0, k1); a null text has the key of an empty one."""
    t = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"k0": F.xxhash64("doc_id", t), "k1": F.pmod(F.xxhash64(t, F.lit(7)), F.lit(65536)).cast("int")})


# --- blocks of text


def text_buffer(col) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, offsets


def runs(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of documents with about ``limit`` bytes each; a longer document is alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), starts[1], ..."""
    counts = np.asarray(counts, np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    return np.repeat(np.asarray(starts, np.int64) - first, counts) + np.arange(total, dtype=np.int64)


# --- 64-bit identifiers


def mix(x: np.ndarray) -> np.ndarray:
    x = x * K1
    x ^= x >> U64(32)
    x *= K2
    x ^= x >> U64(29)
    return x


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Identifier of the concatenation of what a and b identify."""
    x = a * K1
    x ^= x >> U64(32)
    x += b
    x *= K2
    x ^= x >> U64(29)
    x *= K3
    x ^= x >> U64(32)
    return x


def _tables() -> dict:
    c = worker_cache()
    if "table" not in c:
        rng = np.random.default_rng(20240607)
        table = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
        base, n = 0x5851F42D4C957F2D, BLOCK * 2
        power = np.empty(n, U64)
        power[0] = 1
        k = 1
        with np.errstate(over="ignore"):
            while k < n:
                step = U64(pow(base, k, 1 << 64))
                power[k : 2 * k] = power[: min(k, n - k)] * step
                k *= 2
            inverse = np.empty(n, U64)
            inverse[0], k, back = 1, 1, pow(base, -1, 1 << 64)
            while k < n:
                inverse[k : 2 * k] = inverse[: min(k, n - k)] * U64(pow(back, k, 1 << 64))
                k *= 2
        c["table"], c["power"], c["inverse"] = table, power, inverse
    return c


def span_ids(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit identifiers of the byte strings buf[starts:ends], by polynomial prefix sums in blocks.

    starts must ascend.  Strings of over BLOCK bytes are hashed one by one, all others by the sums:
    an identifier depends on nothing but its string.
    """
    c = _tables()
    out = np.empty(len(starts), U64)
    long = ends - starts > BLOCK
    if long.any():
        import xxhash

        for k in np.flatnonzero(long):
            out[k] = xxhash.xxh64_intdigest(buf[starts[k] : ends[k]].tobytes(), 77)
        out[~long] = span_ids(buf, starts[~long], ends[~long])
        return out
    i, n = 0, len(starts)
    while i < n:
        lo = int(starts[i])
        j = int(np.searchsorted(starts, lo + BLOCK, "left"))
        hi = int(ends[i:j].max())
        part = c["table"][buf[lo:hi]]
        part *= c["power"][: hi - lo]
        total = np.zeros(hi - lo + 1, U64)
        np.cumsum(part, out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        x = total[e] - total[s]
        x *= c["inverse"][s]
        x += (e - s).astype(U64) * K3
        out[i:j] = mix(x)
        i = j
    return out


def span_ids_of(buf: np.ndarray):
    """span_ids for many calls on one buffer: up to 2 BLOCK bytes the prefix sums are made once, not by every call."""
    c = _tables()
    if len(buf) > len(c["power"]):
        return functools.partial(span_ids, buf)
    total = np.zeros(len(buf) + 1, U64)
    np.cumsum(c["table"][buf] * c["power"][: len(buf)], out=total[1:])

    def ids(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        if len(size) and size.max() > BLOCK:
            return span_ids(buf, starts, ends)
        x = total[ends] - total[starts]
        x *= c["inverse"][np.minimum(starts, len(buf) - 1)]  # an empty string may start at the end
        x += size.astype(U64) * K3
        return mix(x)

    return ids


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(buf: np.ndarray, offsets: np.ndarray, blank: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (in buf) of the maximal runs of bytes not in ``blank``, and how many each document has."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    if hi == lo:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    ink = ~blank[buf[lo:hi]]
    inner = offsets[(offsets > lo) & (offsets < hi)] - lo
    start = ink.copy()
    start[1:] &= ~ink[:-1]
    start[inner] = ink[inner]
    end = ink.copy()
    end[:-1] &= ~ink[1:]
    end[inner - 1] = ink[inner - 1]
    s = np.flatnonzero(start) + lo
    e = np.flatnonzero(end) + lo + 1
    at = np.searchsorted(s, offsets)
    return s, e, np.diff(at)


# --- packed exchange


def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length as bytes: their length, then each column."""
    return struct.pack("<q", len(columns[0])) + b"".join(np.ascontiguousarray(x).tobytes() for x in columns)


def unpack(data, kinds: list) -> list[np.ndarray]:
    n, at, out = struct.unpack_from("<q", data)[0], 8, []
    for k in map(np.dtype, kinds):
        out.append(np.frombuffer(data, k, n, at))
        at += n * k.itemsize
    return out


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    return ((key >> U64(33)) % U64(parts)).astype(np.int32)


def by_part(key: np.ndarray, columns: list[np.ndarray], parts: int, with_key: bool = True) -> Iterator[tuple[int, bytes]]:
    """One packed row for each part that gets any of these entries; the key travels first, or not at all."""
    if not len(key):
        return
    p = part_of(key, parts)
    order = np.argsort(p, kind="stable")
    p = p[order]
    cut = np.flatnonzero(np.diff(p)) + 1
    columns = [c[order] for c in ((key, *columns) if with_key else columns)]
    for i, j in zip(np.r_[0, cut], np.r_[cut, len(p)]):
        yield int(p[i]), pack(*(c[i:j] for c in columns))


def merged(payloads: list, kinds: list) -> list[np.ndarray]:
    """Columns of many packed rows, one after another."""
    got = [unpack(x, kinds) for x in payloads]
    return [np.concatenate(c) for c in zip(*got)] if got else [np.zeros(0, k) for k in kinds]


def groups(sorted_key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the groups of equal neighbours, and the group of each element."""
    new = np.ones(len(sorted_key), bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def groups2(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As groups, for elements sorted by two keys."""
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    return np.flatnonzero(new), np.cumsum(new) - 1


def rows_of(columns: dict[str, tuple[pa.DataType, list]], chunk: int = 2000) -> Iterator[pa.RecordBatch]:
    names = list(columns)
    n = len(columns[names[0]][1])
    for i in range(0, n, chunk):
        yield pa.RecordBatch.from_arrays([pa.array(v[i : i + chunk], t) for t, v in columns.values()], names=names)

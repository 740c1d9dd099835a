"""Best-fit packing of token sequences by large-item matching (operator 3).

Only lengths matter for a packing, and there are at most ``capacity`` of them.  So the
plan is made from the histogram of lengths, whatever the number of documents:

* pieces above a third of the capacity go at most two to a sequence: greedy matching gives each
  length, from the longest down, the longest partner that fits;
* smaller ones, from the longest down, go to the fullest sequence with room for them (best fit).

The plan assigns ranges of ranks within a length to ranges of sequences; pieces get their rank
from counts per task, without gathering a length in one place.
"""

from __future__ import annotations

import uuid
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import core

#: Token lists of text chunks that a worker remembers.
REMEMBERED = 300_000


class Encoder:
    """Byte-level BPE of whole texts, with a memory for chunks between single spaces.

    A single space between two other characters that aren't white space always begins a new
    pre-token, so the chunks of a text without neighbouring white space can be encoded apart.
    Strings of special tokens are those tokens, as the tokenizer takes them: they cut the text.
    """

    def __init__(self, tokenizer: str):
        import json
        import re

        import tiktoken

        with open(tokenizer, encoding="utf-8") as f:
            spec = json.load(f)
        # the same vocabulary as ranks: byte strings instead of their printable stand-ins
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        special = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in spec.get("added_tokens", [])}
        self.special = special
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")").split if special else None
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.double = re.compile(r"\s\s|\A\s|\s\Z").search
        self.known: dict[str, bytes] = {}

    def chunk(self, text: str) -> bytes:
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        if self.cut and any(x in text for x in self.special):
            return b"".join(self.special[x] if k % 2 else self.plain(x) for k, x in enumerate(self.cut(text)))
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        if not text:
            return b""
        if self.double(text):
            return self.chunk(text)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        first, *rest = text.split(" ")
        out = [self.chunk(first)]
        for x in rest:
            got = known.get(x)
            if got is None:
                got = self.chunk(" " + x)
                if len(x) < 40:
                    known[x] = got
            out.append(got)
        return b"".join(out)


def _pieces(tokenizer: str, capacity: int, end: int, schema: pa.Schema, with_ids: bool):
    last = np.array([end], "<u4").tobytes()

    def run(batches):
        cache = core.worker_cache()
        if ("encoder", tokenizer) not in cache:
            cache["encoder", tokenizer] = Encoder(tokenizer)
        encode = cache["encoder", tokenizer]
        task, seen = uuid.uuid4().hex[:16], np.zeros(capacity + 1, np.int64)
        for batch in batches:
            ids, out = batch.column("doc_id"), {k: [] for k in ("row", "piece", "start", "length", "ids_crc32", "nth", "ids")}
            for row, text in enumerate(batch.column("text").to_pylist()):
                got = encode(text or "") + last
                n = len(got) // 4
                at, k = 0, 0
                while at < n:
                    size = (n % capacity or capacity) if at == 0 else capacity
                    part = got[4 * at : 4 * (at + size)]
                    for name, x in (("row", row), ("piece", k), ("start", at), ("length", size), ("ids_crc32", zlib.crc32(part)), ("nth", int(seen[size]))):
                        out[name].append(x)
                    if with_ids:
                        out["ids"].append(part)
                    seen[size] += 1
                    at, k = at + size, k + 1
            take = ids.take(pa.array(out.pop("row"), pa.int64()))
            if not with_ids:
                out.pop("ids")
            m = len(take)
            yield pa.RecordBatch.from_arrays([take.cast(f.type) if f.name == "doc_id" else pa.array([task] * m if f.name == "task" else out[f.name], f.type) for f in schema], schema=schema)

    return run


def plan(counts: dict[int, int], capacity: int) -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """Packs counts of lengths: per length (first rank, first sequence, offset, sequences) runs, and the number of sequences.

    The pieces of ranks first .. first + sequences - 1 lie in the sequences from first sequence
    on, one each.  Groups of equally filled sequences are split, never listed one by one.
    """
    left = {n: c for n, c in counts.items() if c}
    used = dict.fromkeys(left, 0)
    out: dict[int, list] = {n: [] for n in left}
    made = 0
    room: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, sequences)

    def put(n: int, seq: int, offset: int, times: int) -> None:
        out[n].append((used[n], seq, offset, times))
        used[n] += times
        left[n] -= times

    def free(gap: int, seq: int, times: int) -> None:
        if gap and times:
            if gap not in room:
                room[gap] = []
                insort(gaps, gap)
            room[gap].append((seq, times))

    gaps: list[int] = []
    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        if not left[n]:
            large.pop()
            continue
        k = len(large) - 1
        while k >= 0 and (large[k] + n > capacity or not left[large[k]] or (large[k] == n and left[n] < 2)):
            k -= 1
        if k < 0:
            times = left[n]
            put(n, made, 0, times)
            free(capacity - n, made, times)
        else:
            m = large[k]
            times = left[n] // 2 if m == n else min(left[n], left[m])
            put(n, made, 0, times)
            put(m, made, n, times)
            free(capacity - n - m, made, times)
        made += times
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            i = bisect_left(gaps, n)
            if i == len(gaps):
                each = capacity // n
                times = max(1, left[n] // each)
                seq, gap = made, capacity
                made += times
            else:
                gap = gaps[i]
                seq, times = room[gap].pop()
                if not room[gap]:
                    del room[gap]
                    gaps.pop(i)
            each = min(gap // n, -(-left[n] // times))
            if times > left[n]:
                free(gap, seq + left[n], times - left[n])
                times, each = left[n], 1
            elif each * times > left[n]:
                each = left[n] // times
            for k in range(each):
                put(n, seq, capacity - gap + k * n, times)
            free(gap - each * n, seq, times)
    return out, made


def _place(shared, schema: pa.Schema):
    def run(batches):
        runs = {n: tuple(np.array(c, np.int64) for c in zip(*sorted(r))) for n, r in shared.value.items()}
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            seq, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            at, _ = core.groups(length[order])
            for i, j in zip(at, np.r_[at[1:], len(order)]):
                rows = order[i:j]
                first, start, off, _ = runs[int(length[rows[0]])]
                k = np.searchsorted(first, rank[rows], "right") - 1
                seq[rows], offset[rows] = start[k] + rank[rows] - first[k], off[k]
            new = {"sequence_id": pa.array(seq), "offset": pa.array(offset)}
            yield pa.RecordBatch.from_arrays([new[f.name] if f.name in new else batch.column(f.name).cast(f.type) for f in schema], schema=schema)

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Cuts documents into pieces of at most ``capacity`` tokens and packs these into sequences.

    tokenizer: file of a byte-level BPE vocabulary.  A document is its ids and ``end``.  Returns
    per piece: doc_id, piece (from 0), start (ids of its document before it), length,
    ids_crc32, sequence_id, offset, and with ``with_ids`` the ids (binary, 32 bits each).  Only
    a document of over ``capacity`` ids is cut; its first piece may be shorter.

    Null and empty texts are one id; strings of special tokens in a text are those tokens.  Rows without an id and repeated rows are packed like any
    other.  No rows, no sequences.  Other columns are ignored.

    The broadcast plan has at most a few runs for each of ``capacity`` lengths; its size doesn't
    depend on the number of documents.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    fields = [T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")), *([T.StructField("ids", T.BinaryType())] if with_ids else [])]
    first = T.StructType([*fields, T.StructField("task", T.StringType()), T.StructField("nth", T.LongType())])
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = core.materialise(source.mapInArrow(core.lean(_pieces(tokenizer, capacity, end, to_arrow_schema(first), with_ids)), first))
    by_task = core.materialise(pieces.groupBy("length", "task").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = plan(counts, capacity)
    before = F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1))
    base = by_task.select("length", "task", F.coalesce(before, F.lit(0)).alias("base"))
    # merged, not broadcast: this table grows with the number of tasks
    ranked = pieces.join(base.hint("merge"), ["length", "task"]).withColumn("rank", F.col("base") + F.col("nth"))
    last = T.StructType([*fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(core.lean(_place(spark.sparkContext.broadcast(runs), to_arrow_schema(last))), last)

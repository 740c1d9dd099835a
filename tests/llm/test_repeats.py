import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from folioforge.llm import registry, repeats, substring, suffix

from ..conftest import DATA
from .common import corpus, frame, key


def brute_words(rows, size):
    found = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    times = Counter(tuple(w[i : i + size]) for w in found for i in range(len(w) - size + 1))
    out = []
    for (d, _), w in zip(rows, found):
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if times[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        kept = b" ".join(x for x, y in zip(w, gone) if not y)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=key)


def brute_bytes(rows, size):
    texts = [(t or "").encode() for _, t in rows]
    times = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for (d, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if times[t[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        kept = bytes(x for x, y in zip(t, gone) if not y)
        out.append((d, len(t), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=key)


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_words(spark, size):
    rows = corpus()
    got = substring.dedup_word_windows(frame(spark, rows), size)
    assert sorted((tuple(r)[:4] for r in got.collect()), key=key) == brute_words(rows, size)
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in got.collect())


@pytest.mark.parametrize("size", [4, 9, 20, 33])
def test_bytes(spark, size):
    rows = corpus(2)
    got = suffix.dedup_byte_strings(frame(spark, rows), size)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=key) == brute_bytes(rows, size)
    assert all(hashlib.sha256(bytes(r["kept_bytes"])).hexdigest() == r["kept_sha256"] for r in got.collect())


def test_empty_table_and_string_ids(spark):
    assert substring.dedup_word_windows(frame(spark, []), 3).count() == 0
    assert suffix.dedup_byte_strings(frame(spark, []), 3).count() == 0
    rows = [("x", "a b c d"), ("y", "z a b c")]
    assert sorted((r["doc_id"], r["kept_text"]) for r in substring.dedup_word_windows(frame(spark, rows, "string"), 3).collect()) == [("x", "d"), ("y", "z")]


def test_very_long_text_is_split(spark):
    rnd = random.Random(4)
    long = " ".join(str(rnd.randrange(10**6)) for _ in range(250_000))  # 1.7 MB: more than one piece
    inside = " ".join(long.split(" ")[200_000:200_050])
    rows = [(1, long), (2, "before " + inside + " after")]
    got = {r["doc_id"]: r for r in substring.dedup_word_windows(frame(spark, rows), 35).collect()}
    assert (got[1]["n_removed"], got[2]["n_removed"], got[2]["kept_text"]) == (50, 50, "before after")
    got = {r["doc_id"]: r for r in suffix.dedup_byte_strings(frame(spark, rows), 200).collect()}
    assert got[1]["n_removed"] == got[2]["n_removed"] >= len(inside)
    assert (got[1]["n_spans"], got[2]["n_spans"]) == (1, 1)


def test_hot_passage(spark):
    """One passage in half of all rows, in several contexts."""
    passage = " ".join(f"p{i}" for i in range(12))
    rows = [(i, f"a{i} b{i} {passage} c{i % 3}" if i % 2 else f"only {i} here") for i in range(300)]
    got = substring.dedup_word_windows(frame(spark, rows).repartition(6), 5)
    assert sorted((tuple(r)[:4] for r in got.collect()), key=key) == brute_words(rows, 5)


def test_registered_queries(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, registry.QUERIES["op7_substring_dedup"](spark, f"{DATA}/sf0.001").collect())) == brute_words(rows, 35)
    assert sorted(map(tuple, registry.QUERIES["op10_suffix_array_dedup"](spark, f"{DATA}/sf0.001").collect())) == brute_bytes(rows, 200)


def test_levels_and_minima():
    assert repeats.level_lengths(200, 8) == [7, 13, 25, 50, 100, 200]
    assert repeats.level_lengths(35) == [1, 2, 3, 5, 9, 18, 35]
    x = np.array([5, 3, 8, 1, 9, 9, 2], np.uint64)
    assert repeats.least(x, 3).tolist() == [3, 1, 1, 1, 2]
    with pytest.raises(ValueError):
        repeats.Finder(1 << 15, "byte")

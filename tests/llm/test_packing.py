import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from folioforge.llm import packing

from ..conftest import DATA
from .common import corpus, frame

VOCABULARY = str(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("capacity", [1, 7, 20, 100, 2048])
def test_plan_is_a_packing_near_the_bound(capacity):
    for seed in range(25):
        rnd = random.Random(seed)
        counts = Counter(rnd.randint(1, capacity) if rnd.random() < 0.7 else rnd.choice([1, max(1, capacity // 3), capacity // 3 + 1 if capacity > 1 else 1, max(1, capacity // 2)]) for _ in range(rnd.choice([1, 5, 50, 3000])))
        runs, made = packing.plan(dict(counts), capacity)
        inside = defaultdict(list)
        for n, own in runs.items():
            ranks = []
            for first, seq, offset, times in own:
                for k in range(times):
                    inside[seq + k].append((offset, n))
                    ranks.append(first + k)
            assert sorted(ranks) == list(range(counts[n]))
        assert set(inside) == set(range(made))
        for x in inside.values():
            at = 0
            for offset, n in sorted(x):
                assert offset == at
                at += n
            assert at <= capacity
        large = sum(c for n, c in counts.items() if 2 * n > capacity)
        assert made <= max(large, 1.06 * sum(n * c for n, c in counts.items()) / capacity + 2)


def test_encoder_equals_the_tokenizer():
    encode, hf = packing.Encoder(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    texts = ["", " ", "a  b \n c", "\n\n x", " lead", "trail ", "it's o'clock 12 34", "é " * 30, "x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|><|endoftext|> b  c", " <|endoftext|> ", "<|endoftext|", "a  b", "tab\tb c", "日本 語 x", "\x1c \x1d a"]
    for t in texts * 2:
        assert np.frombuffer(encode(t), "<u4").tolist() == hf.encode(t, add_special_tokens=False).ids, repr(t)


def check(rows, got, capacity):
    hf = Tokenizer.from_file(VOCABULARY)
    want = Counter()
    for d, t in rows:
        ids = [*hf.encode(t or "", add_special_tokens=False).ids, 0]
        cuts = [0] + list(range(len(ids) % capacity or capacity, len(ids) + 1, capacity))
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert want == Counter(tuple(r)[:5] for r in got)
    inside = defaultdict(list)
    for r in got:
        inside[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in inside.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= capacity
    return len(inside)


def test_pack(spark):
    rows = corpus(5, longest=200) + [(700, "a <|endoftext|> b " * 40)]
    got = packing.pack(frame(spark, rows).repartition(4), VOCABULARY, 64).collect()
    check(rows, got, 64)
    assert packing.pack(frame(spark, []), VOCABULARY).count() == 0
    with_ids = packing.pack(frame(spark, rows), VOCABULARY, 64, with_ids=True).collect()
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in with_ids)


def test_query(spark):
    from folioforge.llm import registry

    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = registry.QUERIES["op3_best_fit_packing"](spark, f"{DATA}/sf0.001").collect()
    assert check(rows, got, 2048) <= 1.02 * sum(r["length"] for r in got) / 2048 + 2

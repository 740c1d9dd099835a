import random
import re

import numpy as np

from folioforge.llm import components, minhash, registry

from ..conftest import DATA
from .common import frame


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append(frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([tuple(w)]) if w else frozenset())
    up = {d: d for d, _ in rows if d is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (d, _) in enumerate(rows):
        for j in range(i):
            e, a, b = rows[j][0], sets[i], sets[j]
            if d is not None and e is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(d), root(e)
                up[max(x, y)] = min(x, y)
    return sorted(((d, len(s), None if d is None else root(d), d is None or d == root(d)) for (d, _), s in zip(rows, sets)), key=str)


def answer(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def test_groups_and_edge_cases(spark):
    rnd = random.Random(3)
    base = [f"w{rnd.randint(0, 400)}" for _ in range(150)]
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(rnd.choice([0, 0, 2, 6, 9, 12, 15, 18])):
            w[rnd.randrange(150)] = f"x{rnd.randint(0, 50)}"
        rows.append((1000 - i, " ".join(w)))
    rows += [(2000, None), (2001, ""), (2002, "Alone"), (2003, "alone"), (2004, "  "), (None, rows[0][1]), (None, None), (2005, "one two"), (2005, "three four"), (2006, "THREE four"), (2007, rows[3][1]), (2007, rows[3][1])]
    assert answer(minhash.near_duplicates(frame(spark, rows).repartition(5))) == brute(rows)


def noticed(n, seed=5):
    """Documents with one long notice in common and an own part each; some have a near copy."""
    rnd = random.Random(seed)
    notice = " ".join(f"n{rnd.randrange(10**6)}" for _ in range(130))
    rows = []
    for i in range(n):
        own = [f"w{rnd.randrange(10**6)}" for _ in range(70)]
        rows.append((10 * i, notice + " " + " ".join(own)))
        if i % 10 == 0:
            own[35] = "changed"
            rows.append((10 * i + 1, notice + " " + " ".join(own)))
    return rows


def test_a_common_notice_costs_in_proportion(spark, monkeypatch):
    tried = []
    real = minhash.confirmed
    monkeypatch.setattr(minhash, "confirmed", lambda pairs, *a: tried.append(pairs.count()) or real(pairs, *a))
    rows = noticed(150)
    assert answer(minhash.near_duplicates(frame(spark, rows))) == brute(rows)
    totals = []
    for n in (500, 2000):
        tried.clear()
        got = minhash.near_duplicates(frame(spark, noticed(n)))
        assert got.where("not kept").count() == n // 10
        totals.append(sum(tried))
    assert totals[1] < 6 * totals[0], totals


def variants(n, seed=9):
    """One text with some words replaced, other ones each time: neighbours are just over or under the threshold."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(150)]
    return [(3 * i, " ".join(w if rnd.random() > share else f"x{rnd.randrange(10**6)}" for w in base)) for i in range(n) for share in [rnd.uniform(0.01, 0.14)]]


def test_variants_of_one_text_cost_in_proportion(spark, monkeypatch):
    tried = []
    real = minhash.confirmed
    monkeypatch.setattr(minhash, "confirmed", lambda pairs, *a: tried.append(pairs.count()) or real(pairs, *a))
    totals = []
    for n in (150, 600):
        tried.clear()
        rows = variants(n)
        assert answer(minhash.near_duplicates(frame(spark, rows))) == brute(rows)
        totals.append(sum(tried))
    assert totals[1] < 6 * totals[0], totals


def test_blocks_in_parts_and_by_buckets(spark, monkeypatch):
    rows = variants(120) + [(i + 1, t) for i, t in noticed(60)] + [(0, "a text of the first id"), (3, None), (None, "x y"), (360, variants(1)[0][1])]
    want = brute(rows)
    whole = minhash.near_duplicates(frame(spark, rows))
    assert answer(whole) == want
    links = sorted((tuple(r) for r in whole.select("doc_id", "component_id", "links").collect()), key=str)
    assert any(x[2] > 1 for x in links)
    monkeypatch.setattr(minhash, "PART_SETS", 25)
    parted = minhash.near_duplicates(frame(spark, rows))
    assert sorted((tuple(r) for r in parted.select("doc_id", "component_id", "links").collect()), key=str) == links
    monkeypatch.setattr(minhash, "PARTS", 2)
    assert answer(minhash.near_duplicates(frame(spark, rows))) == want


def test_empty_table(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def test_registered_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert answer(registry.QUERIES["op5_minhash_near_dedup"](spark, f"{DATA}/sf0.001")) == brute(rows)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, x) for x in range(101, 140)] + [(7, 7), (1, 0)]
    got = {r["node"]: r["component"] for r in components.connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), **dict.fromkeys(range(100, 140), 100)}


def test_signature_estimates_similarity():
    rnd = np.random.default_rng(1)
    a = rnd.integers(0, 1 << 62, 1000).astype(np.uint64)
    b = np.r_[a[:800], rnd.integers(0, 1 << 62, 200).astype(np.uint64)]
    same = (minhash.signature(a, 2000) == minhash.signature(b, 2000)).mean()
    assert abs(same - 800 / 1200) < 0.06

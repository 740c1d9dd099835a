import hashlib
import re

from folioforge.llm import decontam

from .common import corpus, frame, key


def brute(rows, items, size):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    windows = [(i, w[k : k + size]) for i, t in items if (w := words(t)) for k in range(max(1, len(w) - size + 1))]
    out = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for i, x in windows:
            for k in range(len(w) - len(x) + 1):
                if w[k : k + len(x)] == x:
                    hit |= set(range(k, k + len(x)))
                    found.add(i)
        names = sorted(str(i) for i in found if i is not None)
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=key)


ITEMS = [(1, "W1, w2! w3"), (2, "w4"), (2, "w4"), (10, None), (3, ""), (None, "w5 w6"), (11, "w7 w8 w9 w10 w11 w12"), (4, "été Ñ"), (5, "w1 w2 w3 w20 w21")]


def test_against_brute_force_in_one_pass_and_several(spark):
    rows = corpus(3, 25) + [(900, "w1 W2\nw3-w20;w21 w4"), (901, "x été ñ w7 w8 w9 w10")]
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 AS doc_id", "'x' AS items")
    docs = frame(spark, rows)
    for limit in (decontam.PASS_WINDOWS, 3):
        got = decontam.digest(decontam.contamination(docs, items, 3, pass_windows=limit))
        assert sorted(map(tuple, got.collect()), key=key) == brute(rows, ITEMS, 3)
        kept = decontam.flagged(docs, items, 3, limit)
        assert kept.columns == [c for c in docs.columns if c != "contaminated"] + ["contaminated"]
        assert sorted((r["doc_id"], r["contaminated"]) for r in kept.where("doc_id is not null").collect()) == sorted((r[0], r[5]) for r in brute(rows, ITEMS, 3) if r[0] is not None)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = corpus(4)
    assert not any(r["contaminated"] for r in decontam.contamination(frame(spark, rows), none).collect())
    assert decontam.contamination(frame(spark, []), none).count() == 0


def test_long_lane(spark):
    text = "x " * 5000 + " ".join(f"w{i}" for i in range(10)) + " y" * 5000
    item = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(10)))], "item_id long, text string")
    got = decontam.contamination(frame(spark, [(1, text)]), item).first()
    assert (got["n_words"], got["n_hit"], got["spans"]) == (10010, 10, [[5000, 5010]])


def test_a_pass_is_bounded_whatever_repeats(spark):
    """One text of 400 items: its windows are broadcast once, its owners in passes of bounded size."""
    rows = [(i, "x1 x2 x3 x4 x5") for i in range(400)]
    items = spark.createDataFrame(rows, "item_id long, text string")
    got = decontam.contamination(frame(spark, [(1, "a x1 x2 x3 x4 x5 b")]), items, 3, pass_windows=100).first()
    assert got["items"] == sorted(range(400), key=str) and got["n_hit"] == 5
    made = decontam.tables([(3, "x1 x2 x3", i) for i in range(400)])
    assert len(made[0][0].ids) == 1 and len(made[0][1][0]) == 400

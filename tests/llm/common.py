"""Fixtures of the operators' tests."""

import random

CLASHES = ["k0", "k1", "marks", "n", "h", "u", "v", "band", "node", "part", "score", "spans", "items", "gone", "line", "contaminated", "h0", "h1", "payload"]


def frame(spark, rows, id_type="long"):
    """Documents with columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, f"doc_id {id_type}, text string")
    return df.selectExpr("*", *(f"'x' AS {c}" for c in CLASHES))


def corpus(seed=1, words=40, n=40, longest=60):
    """Random texts over few words, with copies, nulls, empty and repeated rows."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    rows = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, longest)))) for i in range(n)]
    rows += [(n + 1, None), (None, "a b c"), (None, None), (n + 2, ""), (n + 3, " \n\t "), (5, rows[5][1]), (5, rows[5][1]), (n + 4, rows[7][1]), (n + 5, "a" * 300), (n + 6, "a a " * 60), (n + 7, "é ñ ü " * 30)]
    return rows


def key(row):
    return tuple((x is None, x) for x in row)

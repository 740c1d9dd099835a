import random

import pytest

import corpus_pipeline
from folioforge.llm import toxicity

from . import common, test_decontam, test_linededup, test_minhash, test_packing


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with toxic ones, copied and near-copied lines and documents, benchmark passages, nulls."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7)))
    line = lambda n=9: " ".join(word() for _ in range(n))
    shared = [line() for _ in range(6)]
    items = [(1, line(14)), (2, line(12)), (3, "short item"), (4, None)]
    docs, labels = [], []
    for i in range(160):
        lines = [line() for _ in range(rnd.randint(1, 5))]
        if i % 5 == 0:
            lines.insert(rnd.randrange(len(lines) + 1), rnd.choice(shared))
        if i % 7 == 0:
            x = list(rnd.choice(shared))
            x[rnd.randrange(len(x))] = "q"
            lines.append("".join(x))
        if i % 11 == 0:
            lines.append("x " + rnd.choice(items[:3])[1] + " y" if rnd.random() < 0.7 else "tail")
        toxic = i % 4 == 1
        if toxic:
            lines[0] = "you stupid idiot " + lines[0] + " what an idiot you are"
        docs.append([i, "\n".join(lines)])
        if i % 3:
            labels.append((i, int(toxic)))
    docs[50][1] = docs[20][1]
    docs[51][1] = docs[22][1].replace(" ", "  ", 1)
    docs += [[200, None], [201, ""], [202, "two words"], [203, "two words"], [204, docs[24][1] + "\nand more words at the end of this one, a line of its own"]]
    # a text in one line: its near copy differs in one word only
    long = line(60)
    docs += [[205, long], [206, long.rsplit(" ", 1)[0] + " otherwise"]]
    at = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").selectExpr("doc_id", "1 AS quality", "toxic").write.parquet(str(at / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
    return str(at), docs, items


def brute(spark, at, docs, items):
    """What each stage keeps, by plain loops over the one before; the classifier's model is given."""
    model = toxicity.train(spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet"))
    rows = [(d, t) for d, t in docs if model.score(t or "") < 0.5]
    yield sorted(rows, key=str)
    left = {r[0]: (r[2], r[4]) for r in test_linededup.brute(rows, 2, 40)}
    rows = [(d, left[d][1] if left[d][0] else t) for d, t in rows if not (left[d][0] and not left[d][1].strip(" \t\n\x0b\x0c\r"))]
    yield sorted(rows, key=str)
    kept = {r[0] for r in test_minhash.brute(rows) if r[3]}
    rows = [r for r in rows if r[0] in kept]
    yield sorted(rows, key=str)
    dirty = {r[0] for r in test_decontam.brute(rows, items, 10) if r[5]}
    rows = [r for r in rows if r[0] not in dirty]
    yield sorted(rows, key=str)


def test_stages_against_brute_force(spark, folder):
    at, docs, items = folder
    frame = spark.read.parquet(f"{at}/documents.parquet")
    before = len(docs)
    for (name, stage), want in zip(corpus_pipeline.STAGES, brute(spark, at, docs, items)):
        frame = spark.createDataFrame(stage(spark, frame, at).collect(), frame.schema)
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        got = frame.collect()
        assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == want, name
        assert all(r["n_chars"] == len(r["text"] or "") for r in got)
        assert len(want) < before, f"{name} has no effect here"
        before = len(want)
    last = corpus_pipeline.STAGES[-1][1](spark, frame, at).collect()
    test_packing.check(want, last, 2048)
    whole = corpus_pipeline.run(spark, at).collect()
    test_packing.check(want, whole, 2048)


def test_stages_keep_all_columns_and_rows(spark, folder):
    """Extra columns with names that operators use themselves, null ids and repeated rows."""
    at, docs, _ = folder
    rows = [(d, t) for d, t in docs[:40]] + [(None, "a text without an id"), (None, None), (900, "said twice here"), (900, "said twice here"), (901, None)]
    frame = common.frame(spark, rows).selectExpr("*", "doc_id AS rest_", "'y' AS `a.b`")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, at)
        assert out.columns == frame.columns, name
        got = out.collect()
        assert all(r["score"] == r["k0"] == "x" and r["a.b"] == "y" and r["rest_"] == r["doc_id"] for r in got)
        if name != "line_dedup":
            assert sum(r["doc_id"] == 900 for r in got) == 2
        assert sum(r["doc_id"] is None for r in got) == 2 and sum(r["doc_id"] == 901 for r in got) == 1, name


def test_empty_documents(spark, folder):
    at = folder[0]
    none = spark.read.parquet(f"{at}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, at).count() == 0

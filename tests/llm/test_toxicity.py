import zlib

import numpy as np

from folioforge.llm import toxicity

from ..conftest import DATA
from .common import frame


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    y, p = np.array([r["toxic"] for r in held]), np.array([r["predicted"] for r in held])
    assert (p[y == 1] == 1).mean() > 0.9 and (p[y == 0] == 0).mean() > 0.98


def test_edge_cases(spark):
    rows = [(i, f"some clean words {i}" if i % 2 else f"you idiot number {i}") for i in range(300)] + [(400, None), (401, ""), (None, "an idiot"), (402, "x " * 300_000 + "idiot"), (403, "an idiot"), (403, "an idiot")]
    labels = [(i, 1 - i % 2) for i in range(300)] + [(None, 1), (7, None), (999, 1), (3, 0), (3, 0)]
    label = spark.createDataFrame(labels, "doc_id long, toxic int").selectExpr("*", "'x' AS text", "'x' AS y")
    got = toxicity.toxicity(frame(spark, rows), label).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert by[400]["score"] == by[401]["score"] and by[400]["predicted"] == 0
    assert by[403]["predicted"] == by[None]["predicted"] == 1
    assert not by[None]["held_out"]
    none = label.where("false")
    assert {r["score"] for r in toxicity.toxicity(frame(spark, rows[:5]), none).collect()} == {0.5}
    assert toxicity.toxicity(frame(spark, []), label).count() == 0


def test_grams_are_of_characters_and_fold_space(monkeypatch):
    g = lambda x: [c.tolist() for c in toxicity.grams(x)]
    assert g("A\nb") == g("a b") and g("ÉT") == g("ét")
    assert len(g("")[0]) == 0 and len(g("é")[0]) == 1 and len(g("日本")[0]) == 2 and sum(g("aaaaaa")[1]) == 6 + 4 + 2
    text = "Wörter und Zeichen, " * 40
    whole = g(text)
    for step in (7, 64, 799, 800, 801, 802):
        monkeypatch.setattr(toxicity, "STEP", step)
        assert g(text) == whole


def test_the_fit_is_bounded_in_rows(spark, monkeypatch):
    rows = [(1, f"you idiot {i}") for i in range(3000)] + [(i, f"clean {i}") for i in range(2, 300)]
    labels = spark.createDataFrame([(i, int(i == 1)) for i in range(300)], "doc_id long, toxic int")
    sizes = []
    real = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda f, y, *a, **k: sizes.append(len(y)) or real(f, y, *a, **k))
    toxicity.train(frame(spark, rows), labels, rows=100)
    toxicity.train(frame(spark, rows), labels)
    held = sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in range(1, 300))
    assert sizes == [100, 299 - held]

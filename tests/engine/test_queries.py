"""Every registered query of the engine against its SQL, and the order-dependent ones against row models."""

import re

import duckdb
import pandas as pd
import pytest

from folioforge.plans import catalogue

from ..conftest import DATA

FOLDER = f"{DATA}/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def norm(v):
    if v is None or v is pd.NaT:
        return "null"
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return v.isoformat()[:23] if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_its_sql(spark, sql, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted([norm(r[c]) for c in columns] for r in df.collect())
    r = sql.execute(catalogue.SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == columns
    assert got == sorted([norm(x[names.index(c)]) for c in columns] for x in r.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalogue.QUERIES[name](spark, FOLDER).count() > 0


def test_near_dup_pairs_lose_no_link_between_documents(spark, sql):
    """Pairs and memberships, expanded, are all pairs of documents; the SQL starts from documents, not from classes."""
    from folioforge.plans.fixtures import words_sql

    want = sql.execute(f"""WITH t AS (SELECT lang, doc_id, list_sort(list_distinct({words_sql("coalesce(text, '')")})) AS s, len(s) AS n FROM documents),
p AS (SELECT x.lang, x.doc_id AS a, y.doc_id AS b, x.n + y.n AS n, CASE WHEN x.s = y.s THEN x.n ELSE len(list_intersect(x.s, y.s)) END AS c FROM t x JOIN t y ON x.lang = y.lang AND x.doc_id < y.doc_id AND least(x.n, y.n) >= 0.95 * greatest(x.n, y.n))
SELECT lang, a, b, CASE WHEN n = 0 THEN 1 ELSE round(c / (n - c), 6) END FROM p WHERE c >= 0.95 * (n - c)""").fetchall()
    rows = catalogue.QUERIES["near_dup_pairs"](spark, FOLDER).collect()
    classes = {}
    for r in rows:
        if r["similarity"] == 1:
            classes.setdefault(r["a"], {r["a"]}).add(r["b"])
    got = {(r["lang"], min(a, b), max(a, b), r["similarity"]) for r in rows for a in classes.get(r["a"], {r["a"]}) for b in classes.get(r["b"], {r["b"]}) if r["similarity"] < 1}
    got |= {(r["lang"], a, b, 1.0) for r in rows if r["similarity"] == 1 for a in classes[r["a"]] for b in classes[r["a"]] if a < b}
    assert classes and {(x[0], x[1], x[2], f"{x[3]:.6f}") for x in want} == {(x[0], x[1], x[2], f"{x[3]:.6f}") for x in got}


def test_no_query_takes_a_sample():
    """The stated query set (ids divisible by 100) is the only filter on ids."""
    import inspect

    from folioforge.plans import block_queries, chunk_queries, file_queries, operation_queries, retrieval_queries

    for m in (block_queries, chunk_queries, file_queries, operation_queries, retrieval_queries):
        for line in re.findall(r"\.where\([^)]*%[^)]*\)|\.limit\(|\.sample\(", inspect.getsource(m)):
            assert "vec_id % 100 = 0" in line, line


def test_quality_equals_its_sql_at_borders_and_odd_characters(spark, tmp_path):
    """Shares at a rule's border as 1 - rest / n, wide blanks at the ends, vertical tabs, a capital I with a dot, carriage returns in a table's row."""
    lines = ["a" * k + "1" * (n - k) + x for n in (40, 50, 60, 80, 100) for k in range(n // 10, n // 2 + 1) for x in ("", "\r")]
    lines += ["a" * k + "1" * (n - k - r) + "." * r for n in (40, 60, 100) for k in (int(n * 0.45), int(n * 0.3)) for r in range(n // 4, n // 2)]
    lines += [" ", "　 a b c d e 　", "a b c d İx", "a b c d e" + "\x0b" * 6, "a|b|c d e f\rg|h i", "a|b|c d e f\r\ng|h|i j"] + ["word " * 9 + "end" + x for x in ("", " ", " ", " ", "\r") for _ in range(5)]
    docs = [(i, "\n".join(lines[i:] + lines[:i])) for i in range(11)]
    pd.DataFrame({"doc_id": [i for i, _ in docs], "text": [t for _, t in docs], "source": "s"}).to_parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    for name in ("quality_drops", "quality_decisions", "quality_summary"):
        df = catalogue.QUERIES[name](spark, str(tmp_path))
        r = con.execute(catalogue.SQL[name])
        names = [x[0] for x in r.description]
        want = sorted([norm(x[names.index(c)]) for c in df.columns] for x in r.fetchall())
        assert sorted([norm(r[c]) for c in df.columns] for r in df.collect()) == want

"""Retrieval metrics and question synthesis."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: Passages searched at once.
PASSAGES = 20_000


def containing(passages: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(query_id, key) of chunks whose text contains a passage.

    Passages are a stated query set.  A passage can only lie in a chunk that has its rarest
    full word, so both sides meet on that word, and only then is the text searched.
    """
    word = F.regexp_extract_all(F.lower("passage"), F.lit(r"(?<=[^\p{L}\p{N}_])[\p{L}\p{N}_]+(?=[^\p{L}\p{N}_])"), F.lit(0))
    terms = passages.select("query_id", "passage", F.array_distinct(word).alias("terms"))
    wanted = terms.select(F.explode("terms").alias("term")).distinct()
    tokens = chunks.select(key, F.explode(X.word_set(F.col("text"))).alias("term")).join(wanted, "term", "left_semi")
    df = tokens.groupBy("term").agg(F.count("*").alias("df"))
    rarest = terms.select("query_id", F.explode("terms").alias("term")).join(df, "term").groupBy("query_id").agg(F.min(F.struct("df", "term")).alias("best")).select("query_id", F.col("best.term").alias("term"))
    near = rarest.join(tokens, "term").select("query_id", key)
    short = terms.where(F.size("terms") == 0).select("query_id")
    found = near.join(passages, "query_id").join(chunks.select(key, "text"), key).where(F.contains("text", "passage")).select("query_id", key)
    # a passage without an inner word is compared with every chunk; there are few of them
    rest = short.join(passages, "query_id").join(chunks.select(key, "text"), F.contains("text", "passage")).select("query_id", key)
    return found.unionByName(rest)


def scores(questions: DataFrame, hits: DataFrame, gold: DataFrame, key: str = "chunk_id") -> DataFrame:
    """n_gold, MRR@5, NDCG@5 and recall@10 of each question; 0 without gold."""
    n = gold.groupBy("query_id").agg(F.count("*").alias("n"))
    hit = hits.join(gold, ["query_id", key]).groupBy("query_id").agg(F.min(F.when(F.col("rank") <= 5, F.col("rank"))).alias("first"), F.sum(F.when(F.col("rank") <= 5, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"), F.count(F.when(F.col("rank") <= 10, 1)).alias("found"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(5)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    j = questions.select("query_id").join(n, "query_id", "left").join(hit, "query_id", "left")
    return j.select("query_id", F.coalesce("n", F.lit(0)).alias("n_gold"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr_at_5"), F.round(F.coalesce(F.when(F.col("n") > 0, F.col("dcg") / ideal), F.lit(0.0)), 6).alias("ndcg_at_5"), F.round(F.coalesce(F.col("found") / F.col("n"), F.lit(0.0)), 6).alias("recall_at_10"))


def summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("questions"), F.count_if(F.col("n_gold") > 0).alias("with_gold"), *(F.round(F.avg(c), 5).alias(c) for c in ("mrr_at_5", "ndcg_at_5", "recall_at_10")))


def synthesize(papers: DataFrame) -> DataFrame:
    """Two questions for each record with title and abstract."""
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) and not p.startswith("$") else F.col(p[1:]).cast("string") for p in parts))
    two = F.array(
        F.struct(text("qa_", "$doc_id", "_abstract").alias("question_id"), text('What does "', "$title", '" describe?').alias("question"), F.col("abstract").alias("gold_answer")),
        F.struct(text("qa_", "$doc_id", "_authors").alias("question_id"), text('Which source published "', "$title", '"?').alias("question"), text("$author", ": ", "$title").alias("gold_answer")),
    )
    return papers.where((F.col("title") != "") & (F.col("abstract") != "")).select(F.col("doc_id").alias("gold_doc_id"), F.explode(two).alias("x")).select("x.*", "gold_doc_id")


def stub_metric(rows: pd.DataFrame) -> float:
    """Faithfulness, answer similarity and citation accuracy are constant 0 in the engine this one follows."""
    return 0.0

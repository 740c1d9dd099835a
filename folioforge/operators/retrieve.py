"""Retrieval: postings, BM25, dense top-k, fusion, reranking, query rewriting, filters.

All operators take a batch of queries (a column ``query_id``).  A batch is a stated query set:
it may be broadcast only below the session's own threshold, which Catalyst checks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

K1, B = 1.5, 0.75
#: Rows of queries scored at once against a block of vectors.
QUERY_BLOCK = 1024


def postings(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(term, key, tf): exploded words, counted with partial aggregation."""
    return chunks.select(key, F.explode(X.words(F.col(text))).alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))


def doc_stats(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, doc_len); an empty text has length 1."""
    return chunks.select(key, F.greatest(F.size(X.words(F.col(text))), F.lit(1)).cast("bigint").alias("doc_len"))


def term_stats(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("df"))


def bm25(queries: DataFrame, chunks: DataFrame, key: str = "chunk_id", text: str = "text", query: str = "question") -> DataFrame:
    """(query_id, key, score) of all matching pairs; repeated query terms count as often as they occur.

    Query terms meet postings on the term, so chunks without any of them are never scored.
    """
    asked = queries.select("query_id", F.explode(X.words(F.col(query))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    index = postings(chunks, key, text)
    wanted = index.join(asked.select("term").distinct(), "term", "left_semi")
    length = doc_stats(chunks, key, text)
    corpus = length.agg(F.count("*").alias("n"), F.greatest(F.avg("doc_len"), F.lit(1e-9)).alias("avgdl"))  # one row
    df = term_stats(wanted)
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.col("avgdl")))
    scored = wanted.join(df, "term").join(length, key).crossJoin(F.broadcast(corpus)).select("term", key, (idf * weight).alias("part"))
    return scored.join(asked, "term").groupBy("query_id", key).agg(F.sum(F.col("part") * F.col("qtf")).alias("score"))


def top(hits: DataFrame, k: int, *order: Column, by: str = "query_id") -> DataFrame:
    """The first k rows of each query, with ``rank``; Spark prunes groups before the shuffle."""
    w = Window.partitionBy(by).orderBy(*order)
    return hits.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def bm25_top(queries: DataFrame, chunks: DataFrame, k: int, key: str = "chunk_id", text: str = "text") -> DataFrame:
    hits = bm25(queries, chunks, key, text).withColumn("score", F.round("score", 6))
    return top(hits, k, F.desc("score"), F.col(key))


def dense_top(queries: DataFrame, vectors: DataFrame, k: int, key: str = "chunk_id") -> DataFrame:
    """(query_id, key, score, rank): exact cosine top-k of a stated query set against all vectors.

    The vectors stay where they are; each task keeps its best k for every query of a block, so
    k rows per task and query are all that is shuffled.  Query blocks go one after another.
    """
    import numpy as np
    import pandas as pd

    rows = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    total = rows.count()
    n_blocks = max(1, -(-total // QUERY_BLOCK))
    out = []
    for i in range(n_blocks):
        part = rows if n_blocks == 1 else rows.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == i)
        got = part.collect()  # at most about QUERY_BLOCK vectors
        if not got:
            continue
        ids = [r["query_id"] for r in got]
        q = np.array([r["embedding"] for r in got], np.float64)
        norm = np.linalg.norm(q, axis=1)
        shared = queries.sparkSession.sparkContext.broadcast((ids, q, norm))

        def scan(frames, shared=shared):
            ids, q, norm = shared.value
            best: dict[int, pd.DataFrame] = {}
            for pdf in frames:
                if not len(pdf):
                    continue
                v = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
                size = np.linalg.norm(v, axis=1)
                for a in range(0, len(ids), 64):
                    dot = q[a : a + 64] @ v.T
                    score = np.divide(dot, np.outer(norm[a : a + 64], size), out=np.zeros_like(dot), where=np.outer(norm[a : a + 64], size) > 0).round(6)
                    for j, s in enumerate(score):
                        near = np.argpartition(-s, min(k, len(s) - 1))[: k + 1]
                        cut = s[near].min()
                        near = np.flatnonzero(s >= cut)  # ties at the border stay
                        own = pd.DataFrame({"key": pdf["key"].to_numpy()[near], "score": s[near]})
                        if a + j in best:
                            own = pd.concat([best[a + j], own])
                        best[a + j] = own.sort_values(["score", "key"], ascending=[False, True]).head(k)
            for j, own in best.items():
                yield own.assign(query_id=ids[j])[["query_id", "key", "score"]]

        schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, key {vectors.schema[key].dataType.simpleString()}, score double"
        out.append(vectors.select(F.col(key).alias("key"), F.col("embedding").cast("array<double>").alias("embedding")).mapInPandas(scan, schema))
    if not out:
        return queries.select("query_id").where("false").withColumns({key: F.lit(0), "score": F.lit(0.0), "rank": F.lit(0).cast("bigint")})
    return top(reduce(DataFrame.unionByName, out), k, F.desc("score"), F.col("key")).withColumnRenamed("key", key)


ALIASES = {"page": "page_start", **{f"document_{x}": f"doc_{x}" for x in ("id", "type")}}
COMPARISONS = {"gt": Column.__gt__, "gte": Column.__ge__, "lt": Column.__lt__, "lte": Column.__le__}
OPERATORS = {"eq", "in", *COMPARISONS}


def split_filters(filters: dict) -> tuple[dict, dict]:
    """Equality filters, which go below a limit, and the rest, which is applied after it."""
    pushed, residual = {}, {}
    for name, rule in (filters or {}).items():
        name = ALIASES.get(name, name)
        if not isinstance(rule, dict):
            pushed[name] = rule
        elif set(rule) - OPERATORS or not rule:
            raise ValueError(f"unsupported filter on {name}: {sorted(rule)}")
        elif set(rule) == {"eq"}:
            pushed[name] = rule["eq"]
        else:
            residual[name] = rule
    return pushed, residual


def equality(pushed: dict) -> Column:
    """Null-safe conjunction."""
    return reduce(lambda a, b: a & b, (F.col(n).eqNullSafe(F.lit(v)) for n, v in pushed.items()), F.lit(True))


def residual(rules: dict) -> Column:
    """Comparisons, never true for null; ``in`` may hold None."""
    out = F.lit(True)
    for name, rule in rules.items():
        c = F.col(name)
        for op, v in rule.items():
            if op == "eq":
                test = c.eqNullSafe(F.lit(v))
            elif op == "in":
                test = F.coalesce(c.isin([x for x in v if x is not None]), F.lit(False)) | (c.isNull() if None in v else F.lit(False))
            else:
                test = F.coalesce(COMPARISONS[op](c, v), F.lit(False))
            out = out & test
    return out


def filtered_hits(candidates: DataFrame, rules: dict, k: int) -> DataFrame:
    """Ranks what passes the residual filters within the candidate pool; results can be short."""
    return top(candidates.where(residual(rules)), k, F.col("rank").asc() if "rank" not in rules else F.col("rank"))


def sparse_hits(hits: DataFrame) -> DataFrame:
    """The score of a sparse hit is 1 / its position."""
    return hits.withColumn("score", F.round(F.lit(1.0) / F.col("rank"), 6))


def fuse(dense: DataFrame, sparse: DataFrame, k: int, rrf: int = 60, w_dense: float = 1.0, w_sparse: float = 1.0, key: str = "chunk_id") -> DataFrame:
    """Weighted reciprocal rank fusion; ties keep dense before sparse order."""
    if w_dense == 0 and w_sparse == 0:
        raise ValueError("both weights are 0")
    one = dense.select("query_id", key, (F.lit(w_dense) / (rrf + F.col("rank"))).alias("s"), F.col("rank").alias("seen"))
    two = sparse.select("query_id", key, (F.lit(w_sparse) / (rrf + F.col("rank"))).alias("s"), (F.col("rank") + 1_000_000).alias("seen"))
    both = one.unionByName(two).groupBy("query_id", key).agg(F.round(F.sum("s"), 6).alias("score"), F.min("seen").alias("seen"))
    return top(both, k, F.desc("score"), F.col("seen"), F.col(key)).drop("seen")


def rerank(hits: DataFrame, k: int = 5, query: str = "question", text: str = "text", key: str = "chunk_id") -> DataFrame:
    """By the share of query words in the chunk, then by the former rank."""
    q = X.word_set(F.col(query))
    share = F.round(F.size(F.array_intersect(q, X.word_set(F.col(text)))) / F.size(q), 6)
    h = hits.where(F.size(q) > 0).withColumn("overlap", share).withColumnRenamed("rank", "old_rank")
    return top(h, k, F.desc("overlap"), F.coalesce("old_rank", F.lit(10_000)), F.col(key)).withColumn("correction", F.col("rank") < F.col("old_rank"))


#: In the order in which one gives the prefix.
MARKERS = tuple("compare difference versus vs between relationship".split())
SPLIT = rf"(?i)\b(?:{'|'.join(('compared with', 'between', 'versus', r'vs[.]?', 'and'))})\b"


def is_multihop(question: Column, min_terms: int = 6) -> Column:
    """Enough terms, and a marker anywhere (even inside a word) or " and "."""
    t = F.lower(F.trim(question))
    marker = reduce(lambda a, b: a | b, (F.contains(t, F.lit(m)) for m in MARKERS))
    return (F.size(X.words(t)) >= min_terms) & (marker | (F.contains(t, F.lit(" and ")) & ~F.contains(F.substring(t, 1, 4), F.lit("?"))))


def decompose(question: Column, most: int = 3) -> Column:
    """Sub-queries of a multi-hop question, each with the shared prefix, distinct in order."""
    t = F.trim(question)
    strip = lambda c: F.regexp_replace(c, r"^[ ,;:.]+|[ ,;:.]+$", "")
    parts = F.filter(F.transform(F.split(t, SPLIT), strip), lambda x: x != "")
    prefix = F.lit(None)
    for m in reversed(MARKERS):
        at = F.instr(F.lower(t), m)
        prefix = F.when(at > 0, strip(F.substring(t, F.lit(1), at + len(m) - 1))).otherwise(prefix)
    prefix = F.coalesce(prefix, F.lit(""))
    full = F.transform(parts, lambda x: F.when((prefix == "") | F.startswith(F.lower(x), F.lower(prefix)), x).otherwise(F.trim(F.concat(prefix, F.lit(" "), x))))
    keys = F.transform(full, F.lower)
    distinct = F.filter(full, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1)
    return F.when(t == "", F.array().cast("array<string>")).when(~is_multihop(question) | (F.size(parts) <= 1), F.array(t)).otherwise(F.slice(distinct, 1, most))

"""Queries over the index, retrieval, citations, contexts, answers and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import answer as A
from ..operators import cite as C
from ..operators import evaluate as E
from ..operators import retrieve as R
from .catalogue import query
from .fixtures import CHUNKS, chunks, table, words_sql

Q = f"q AS (SELECT item_id AS query_id, array_to_string(({words_sql('text')})[:8], ' ') AS question FROM benchmark)"
POST = f"post AS (SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest({words_sql('text')}) AS term FROM chunks) GROUP BY ALL), len AS (SELECT chunk_id, greatest(len({words_sql('text')}), 1)::BIGINT AS doc_len FROM chunks)"
BM25 = f"""{POST}, asked AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({words_sql('question')}) AS term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM post GROUP BY term), corp AS (SELECT count(*) AS n, avg(doc_len) AS avgdl FROM len),
bm AS (SELECT query_id, chunk_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_len / avgdl))), 6) AS score FROM asked JOIN post USING (term) JOIN df USING (term) JOIN len USING (chunk_id), corp GROUP BY ALL),
bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm)"""
DENSE = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), ds AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a, v b WHERE a.vec_id % 100 = 0),
dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ds)"""


def _questions(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(X.words(F.col("text")), 1, 8), " ").alias("question"))


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", F.col("label").cast("bigint").alias("label"))


def _vector_queries(spark, d):
    """The stated query set: every id divisible by 100."""
    return table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _hybrid(spark, d, k=10, pool=40):
    """Dense neighbours of chunk vectors and sparse hits of the questions, by query id."""
    dense = R.dense_top(_vector_queries(spark, d).withColumn("query_id", F.col("query_id") / 100).withColumn("query_id", F.col("query_id").cast("bigint")), _vectors(spark, d), pool)
    sparse = R.bm25_top(_questions(spark, d), chunks(spark, d), pool)
    return R.fuse(dense, sparse, k)


@query(f"WITH {CHUNKS}, {POST} SELECT term, chunk_id, tf FROM post")
def postings(spark, d):
    return R.postings(chunks(spark, d))


@query(f"WITH {CHUNKS}, {POST} SELECT term, count(*) AS df FROM post GROUP BY term")
def term_stats(spark, d):
    return R.term_stats(R.postings(chunks(spark, d)))


@query(f"WITH {CHUNKS}, {POST} SELECT count(*) AS n, round(avg(doc_len), 6) AS avgdl FROM len")
def corpus_stats(spark, d):
    return R.doc_stats(chunks(spark, d)).agg(F.count("*").alias("n"), F.round(F.avg("doc_len"), 6).alias("avgdl"))


@query(f"WITH {CHUNKS}, {Q}, {BM25} SELECT query_id, chunk_id, score FROM bm")
def bm25_scores(spark, d):
    return R.bm25(_questions(spark, d), chunks(spark, d)).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {CHUNKS}, {Q}, {BM25} SELECT query_id, chunk_id, score, rank FROM bmr WHERE rank <= 10")
def bm25_topk_matched(spark, d):
    return R.bm25_top(_questions(spark, d), chunks(spark, d), 10)


@query(f"WITH {CHUNKS}, {Q}, {BM25}, f AS (SELECT bmr.*, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r2 FROM bmr JOIN chunks USING (chunk_id) WHERE rank <= 40 AND quality >= 0.5 AND page_start IN (1, 2, 3, 4, 5)) SELECT query_id, chunk_id, round(1.0 / r2, 6)::DOUBLE AS score, r2 AS rank FROM f WHERE r2 <= 10")
def sparse_rank(spark, d):
    pool = R.bm25_top(_questions(spark, d), chunks(spark, d), 40)
    _, rules = R.split_filters({"quality": {"gte": 0.5}, "page": {"in": [1, 2, 3, 4, 5]}})
    hits = pool.join(chunks(spark, d).select("chunk_id", "quality", "page_start"), "chunk_id").where(R.residual(rules)).withColumnRenamed("rank", "old")
    return R.sparse_hits(R.top(hits, 10, F.col("old"))).select("query_id", "chunk_id", "score", "rank")


@query(f"WITH {DENSE} SELECT query_id, chunk_id, score, rank FROM dr WHERE rank <= 10")
def dense_topk(spark, d):
    return R.dense_top(_vector_queries(spark, d), _vectors(spark, d), 10)


@query("""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a, v b WHERE a.vec_id % 100 = 0 AND b.label = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) SELECT * FROM r WHERE rank <= 10""")
def dense_filtered(spark, d):
    pushed, _ = R.split_filters({"label": {"eq": 1}})
    return R.dense_top(_vector_queries(spark, d), _vectors(spark, d).where(R.equality(pushed)), 10)


FUSED = """u AS (SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + rank) AS s, rank AS seen FROM dn WHERE rank <= 40 UNION ALL SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + rank), rank + 1000000 FROM bmr WHERE rank <= 40),
g AS (SELECT query_id, chunk_id, round(sum(s), 6) AS score, min(seen) AS seen FROM u GROUP BY ALL), fu AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, chunk_id) AS rank FROM g)"""


@query(f"WITH {CHUNKS}, {Q}, {BM25}, {DENSE}, dn AS (SELECT query_id // 100 AS query_id, chunk_id, score, rank FROM dr), {FUSED} SELECT query_id, chunk_id, score, rank FROM fu WHERE rank <= 10")
def hybrid_search(spark, d):
    return _hybrid(spark, d)


@query(f"WITH {CHUNKS}, {Q}, {BM25}, {DENSE}, dn AS (SELECT query_id // 100 AS query_id, chunk_id, score, rank FROM dr), h AS (SELECT 0 AS branch, query_id, chunk_id, rank FROM dn WHERE rank <= 40 UNION ALL SELECT 1, query_id, chunk_id, rank FROM bmr WHERE rank <= 40), g AS (SELECT query_id, chunk_id, round(sum(CASE branch WHEN 0 THEN 0.7 ELSE 0.3 END::DOUBLE / (60 + rank)), 6) AS score, min(rank + branch * 1000000) AS seen FROM h GROUP BY ALL) SELECT * EXCLUDE seen FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, chunk_id) AS rank FROM g) WHERE rank <= 20")
def rrf_weighted(spark, d):
    dense = R.dense_top(_vector_queries(spark, d).withColumn("query_id", (F.col("query_id") / 100).cast("bigint")), _vectors(spark, d), 40)
    return R.fuse(dense, R.bm25_top(_questions(spark, d), chunks(spark, d), 40), 20, w_dense=0.7, w_sparse=0.3)


RERANK = f"""rq AS (SELECT query_id, chunk_id, bmr.rank AS old_rank, list_distinct({words_sql('question')}) AS qs, list_distinct({words_sql('text')}) AS cs FROM bmr JOIN q USING (query_id) JOIN chunks USING (chunk_id) WHERE bmr.rank <= 40),
ro AS (SELECT query_id, chunk_id, old_rank, round(len(list_intersect(qs, cs)) / len(qs), 6) AS overlap FROM rq WHERE len(qs) > 0), rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, old_rank, chunk_id) AS rank FROM ro)"""


@query(f"WITH {CHUNKS}, {Q}, {BM25}, {RERANK} SELECT query_id, chunk_id, overlap, old_rank, rank, rank < old_rank AS correction FROM rr WHERE rank <= 5")
def rerank_overlap(spark, d):
    pool = R.bm25_top(_questions(spark, d), chunks(spark, d), 40).join(_questions(spark, d), "query_id").join(chunks(spark, d).select("chunk_id", "text"), "chunk_id")
    return R.rerank(pool).select("query_id", "chunk_id", "overlap", "old_rank", "rank", "correction")


_MARK = " OR ".join(f"contains(t, '{m}')" for m in R.MARKERS)
ASKED = f"a AS (SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'Compare ' || h || ' and the rest' WHEN 1 THEN h || ' versus ' || h || ', x' ELSE h END AS question FROM (SELECT item_id, array_to_string(({words_sql('text')})[:8], ' ') AS h FROM benchmark)), hop AS (SELECT *, len({words_sql('t')}) >= 6 AND ({_MARK} OR (contains(t, ' and ') AND NOT contains(t[:4], '?'))) AS multihop FROM (SELECT *, lower(trim(question)) AS t FROM a))"


def _asked(spark, d):
    h = F.array_join(F.slice(X.words(F.col("text")), 1, 8), " ")
    q = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("Compare "), h, F.lit(" and the rest"))).when(F.col("item_id") % 3 == 1, F.concat(h, F.lit(" versus "), h, F.lit(", x"))).otherwise(h)
    return table(spark, d, "benchmark").select("item_id", q.alias("question"))


@query(f"WITH {ASKED} SELECT item_id, multihop FROM hop")
def query_multihop(spark, d):
    return _asked(spark, d).select("item_id", R.is_multihop(F.col("question")).alias("multihop"))


_PREFIX = "CASE " + " ".join(f"WHEN instr(t, '{m}') > 0 THEN trim(trim(question)[:instr(t, '{m}') + {len(m) - 1}], ' ,;:.')" for m in R.MARKERS) + " ELSE '' END"


@query(f"""WITH {ASKED}, p AS (SELECT *, list_filter(list_transform(string_split_regex(trim(question), '(?i)\\b(?:compared with|between|versus|vs[.]?|and)\\b'), lambda x: trim(x, ' ,;:.')), lambda x: x <> '') AS parts, {_PREFIX} AS prefix FROM hop),
f AS (SELECT *, list_transform(parts, lambda x: CASE WHEN prefix = '' OR starts_with(lower(x), lower(prefix)) THEN x ELSE trim(prefix || ' ' || x) END) AS fs FROM p)
SELECT item_id, array_to_string(CASE WHEN NOT multihop OR len(parts) <= 1 THEN [trim(question)] ELSE (list_filter(fs, lambda x, i: list_position(list_transform(fs, lambda y: lower(y)), lower(x)) = i))[:3] END, ' | ') AS parts FROM f""")
def query_decompose(spark, d):
    return _asked(spark, d).select("item_id", F.array_join(R.decompose(F.col("question")), " | ").alias("parts"))


# --- evaluation

GOLD = "gold AS (SELECT item_id AS query_id, doc_id AS chunk_id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text))"
EVAL = f"""{GOLD}, ng AS (SELECT query_id, count(*) AS n FROM gold GROUP BY 1), hit AS (SELECT query_id, rank FROM bmr JOIN gold USING (query_id, chunk_id) WHERE rank <= 10),
ev AS (SELECT q.query_id, coalesce(n, 0) AS n_gold, round(coalesce(1.0 / min(CASE WHEN rank <= 5 THEN rank END), 0), 6)::DOUBLE AS mrr_at_5,
 round(coalesce(sum(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END) / any_value(CASE WHEN n > 0 THEN list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1 / log2(i + 1))) END), 0), 6) AS ndcg_at_5,
 round(coalesce(count(rank) / any_value(n), 0), 6) AS recall_at_10 FROM q LEFT JOIN ng USING (query_id) LEFT JOIN hit USING (query_id) GROUP BY q.query_id, n)"""


def _gold(spark, d):
    """Documents that hold the passage: items are a stated query set, scanned against all documents."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    return E.containing(items, chunks(spark, d))


@query(f"WITH {GOLD} SELECT query_id, chunk_id FROM gold")
def gold_resolve(spark, d):
    return _gold(spark, d)


@query(f"WITH {CHUNKS}, {Q}, {BM25}, {EVAL} SELECT * FROM ev")
def eval_questions(spark, d):
    return E.scores(_questions(spark, d), R.bm25_top(_questions(spark, d), chunks(spark, d), 10), _gold(spark, d))


@query(f"WITH {CHUNKS}, {Q}, {BM25}, {EVAL} SELECT count(*) AS questions, count_if(n_gold > 0) AS with_gold, round(avg(mrr_at_5), 5) AS mrr_at_5, round(avg(ndcg_at_5), 5) AS ndcg_at_5, round(avg(recall_at_10), 5) AS recall_at_10 FROM ev")
def eval_summary(spark, d):
    return E.summary(eval_questions(spark, d))


@query(f"""WITH t AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, source AS author, array_to_string(({words_sql('text')})[:6], ' ') AS title, array_to_string((regexp_extract_all(text, '[^\\s]+'))[:28], ' ') AS abstract FROM documents),
k AS (SELECT * FROM t WHERE title <> '' AND abstract <> '')
SELECT 'qa_' || doc_id || '_abstract' AS question_id, 'What does "' || title || '" describe?' AS question, abstract AS gold_answer, doc_id AS gold_doc_id FROM k UNION ALL SELECT 'qa_' || doc_id || '_authors', 'Which source published "' || title || '"?', author || ': ' || title, doc_id FROM k""")
def qa_synthesis(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.col("source").alias("author"), F.array_join(F.slice(X.words(F.col("text")), 1, 6), " ").alias("title"), X.truncate_words(F.col("text"), 28).alias("abstract"))
    return E.synthesize(t)


# --- citations and contexts

HITS = f"hits AS (SELECT query_id, chunk_id, score, rank FROM bmr WHERE rank <= 10), cited AS (SELECT h.*, c.doc_id, c.text, c.quality, c.page_start, c.source FROM hits h JOIN chunks c USING (chunk_id))"
CAT = "cat AS (SELECT doc_id, 'Title of ' || doc_id AS title, CASE WHEN doc_id % 2 = 0 THEN 'v1' END AS version FROM documents WHERE lang <> 'fr')"


def _cited(spark, d):
    hits = R.bm25_top(_questions(spark, d), chunks(spark, d), 10)
    return hits.join(chunks(spark, d).select("chunk_id", "doc_id", "text", "quality", "page_start", "source"), "chunk_id")


def _catalogue(spark, d):
    return table(spark, d, "documents").where("lang <> 'fr'").select("doc_id", F.concat(F.lit("Title of "), F.col("doc_id").cast("string")).alias("title"), F.when(F.col("doc_id") % 2 == 0, "v1").alias("version"))


@query(f"WITH {CHUNKS}, {Q}, {BM25}, {HITS}, {CAT} SELECT query_id, chunk_id, rank AS citation_id, coalesce(title, source) AS title, version, page_start AS page, title IS NULL AS unresolved, round(0.30 + 0.15 + 0.15 + CASE WHEN version IS NOT NULL OR title IS NOT NULL THEN 0.05 ELSE 0 END, 6)::DOUBLE AS confidence FROM cited LEFT JOIN cat USING (doc_id)")
def citations(spark, d):
    return C.resolve(_cited(spark, d).withColumnRenamed("source", "source_path"), _catalogue(spark, d))


@query(f"WITH {CHUNKS}, {Q}, {BM25}, {HITS}, {CAT} SELECT DISTINCT doc_id FROM cited WHERE doc_id NOT IN (SELECT doc_id FROM cat)")
def unresolved_docs(spark, d):
    return C.unresolved(_cited(spark, d), _catalogue(spark, d))


ANSWERS = "ans AS (SELECT conv_id, turn, coalesce(text, '') || ' [1] [SOURCE ' || (2 + turn % 3) || '] [7, ' || (conv_id % 9) || ']' || CASE WHEN conv_id % 5 = 0 THEN ' I cannot determine that.' ELSE '' END AS answer FROM conversations WHERE role = 'assistant'), refs AS (SELECT conv_id, turn, list_transform(regexp_extract_all(answer, '(?i)\\[(?:SOURCE\\s+)?([0-9]+(?:\\s*,\\s*[0-9]+)*)\\]', 1), lambda x: x) AS r FROM ans), ids AS (SELECT conv_id, turn, list_sort(list_distinct(list_transform(flatten(list_transform(r, lambda x: string_split(x, ','))), lambda x: trim(x)::BIGINT))) AS c FROM refs)"


def _answers(spark, d):
    a = F.concat(F.coalesce("text", F.lit("")), F.lit(" [1] [SOURCE "), (2 + F.col("turn") % 3).cast("string"), F.lit("] [7, "), (F.col("conv_id") % 9).cast("string"), F.lit("]"), F.when(F.col("conv_id") % 5 == 0, " I cannot determine that.").otherwise(""))
    return table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", a.alias("answer"))


@query(f"WITH {ANSWERS} SELECT conv_id, turn, array_to_string(c, ',') AS cited FROM ids")
def citation_refs(spark, d):
    return _answers(spark, d).select("conv_id", "turn", F.array_join(F.array_sort(F.array_distinct(C.references(F.col("answer")))), ",").alias("cited"))


@query(f"WITH {ANSWERS} SELECT conv_id, turn, array_to_string(list_filter(c, lambda x: x NOT IN (1, 2, 3, 4)), ',') AS orphans, array_to_string(list_filter([1, 2, 3, 4], lambda x: NOT list_contains(c, x)), ',') AS uncited, len(list_filter(c, lambda x: x NOT IN (1, 2, 3, 4))) = 0 AS valid FROM ids")
def citation_validation(spark, d):
    return C.validate(_answers(spark, d), F.array(*(F.lit(x).cast("bigint") for x in (1, 2, 3, 4)))).select("conv_id", "turn", "orphans", "uncited", "valid")


@query(f"WITH {ANSWERS} SELECT conv_id, turn, conv_id % 5 = 0 OR contains(lower(answer), 'i cannot determine') AS abstained FROM ans")
def abstention(spark, d):
    return _answers(spark, d).select("conv_id", "turn", A.abstained(F.col("answer")).alias("abstained"))


@query("""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '\\b[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\\.[A-Za-z]{2,}\\b'))::BIGINT AS emails, len(regexp_extract_all(coalesce(text, ''), '\\b(?:\\+?[0-9][0-9\\s().-]{7,}[0-9])\\b'))::BIGINT AS phones FROM documents""")
def pii_findings(spark, d):
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.size(A.emails(t)).cast("bigint").alias("emails"), F.size(A.phones(t)).cast("bigint").alias("phones"))


@query(f"""WITH {ANSWERS} SELECT conv_id, turn, len(list_filter(c, lambda x: x NOT IN (1, 2, 3, 4))) = 0 AND NOT regexp_matches(answer, '\\b[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\\.[A-Za-z]{{2,}}\\b') AND NOT regexp_matches(answer, '\\b(?:\\+?[0-9][0-9\\s().-]{{7,}}[0-9])\\b') AS valid FROM ans JOIN ids USING (conv_id, turn)""")
def answer_validity(spark, d):
    return A.validity(_answers(spark, d), F.array(*(F.lit(x).cast("bigint") for x in (1, 2, 3, 4)))).select("conv_id", "turn", "valid")


PLANTED = "pl AS (SELECT query_id, chunk_id, doc_id, score, rank, quality, page_start, source, text || ' $' || (doc_id % 7) || ',000 ' || (2000 + doc_id % 3) AS text FROM cited)"


def _planted(spark, d):
    return _cited(spark, d).withColumn("text", F.concat("text", F.lit(" $"), (F.col("doc_id") % 7).cast("string"), F.lit(",000 "), (2000 + F.col("doc_id") % 3).cast("string")))


@query(f"WITH {CHUNKS}, {Q}, {BM25}, {HITS}, {PLANTED} SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, page_start, chunk_id) AS position FROM pl")
def context_order(spark, d):
    return C.ordered(_planted(spark, d)).select("query_id", "chunk_id", "position")


_DIST = "list_aggregate(list_filter(l, lambda x, i: list_position(l, x) = i)[:3], 'string_agg', ', ')"


@query(f"""WITH {CHUNKS}, {Q}, {BM25}, {HITS}, {PLANTED}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, page_start, chunk_id) AS position FROM pl),
m AS (SELECT query_id, flatten(list(regexp_extract_all(text, '\\b(?:19|20)[0-9]{{2}}\\b') ORDER BY position)) AS dates, flatten(list(regexp_extract_all(text, '\\$\\s?[0-9][0-9,]*(?:\\.[0-9]+)?') ORDER BY position)) AS amounts FROM o GROUP BY query_id)
SELECT query_id, CASE WHEN len(list_distinct(dates)) >= 2 THEN array_to_string((list_filter(dates, lambda x, i: list_position(dates, x) = i))[:3], ', ') END AS dates, CASE WHEN len(list_distinct(amounts)) >= 2 THEN array_to_string((list_filter(amounts, lambda x, i: list_position(amounts, x) = i))[:3], ', ') END AS amounts FROM m""")
def context_conflicts(spark, d):
    return C.conflicts(C.ordered(_planted(spark, d))).select("query_id", "dates", "amounts")


@query(f"""WITH {CHUNKS}, {Q}, {BM25}, {HITS}, {PLANTED}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, page_start, chunk_id) AS position FROM pl)
SELECT query_id, string_agg('[SOURCE ' || position || ' | doc: ' || source || ' | page ' || page_start || ' | section: Unknown section]' || chr(10) || text, chr(10) || chr(10) ORDER BY position) AS context, sum(len(regexp_extract_all(text, '[^\\s]+')))::BIGINT AS tokens, count(*) AS sources, count(DISTINCT doc_id) AS documents, round(avg(quality), 6) AS quality FROM o GROUP BY query_id""")
def context_format(spark, d):
    return C.formatted(C.ordered(_planted(spark, d)))


@query()
def context_window(spark, d):
    return C.formatted(C.compressed(C.ordered(C.deduplicated(_planted(spark, d))), _questions(spark, d)))


@query(f"""WITH {CHUNKS}, {Q}, {BM25}, {HITS} SELECT query_id, 'Question:' || chr(10) || question || chr(10) || chr(10) || 'Context:' || chr(10) || string_agg(chunk_id::VARCHAR, ' ' ORDER BY rank) || chr(10) || chr(10) || 'Answer with grounded claims only.' AS prompt FROM hits JOIN q USING (query_id) GROUP BY query_id, question""")
def prompt_text(spark, d):
    c = R.bm25_top(_questions(spark, d), chunks(spark, d), 10).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"].cast("string")), " ").alias("context"))
    return _questions(spark, d).join(c, "query_id").select("query_id", A.user_prompt(F.col("question"), F.col("context")).alias("prompt"))


def _with_blocks(spark, d):
    """Hits with the ids of ten lines' worth of blocks each, two thirds shared by neighbours."""
    return _cited(spark, d).select("query_id", "chunk_id", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (F.col("chunk_id") % 5) + i).alias("blocks"))


@query(f"WITH {CHUNKS}, {Q}, {BM25}, {HITS}, x AS (SELECT query_id, chunk_id, chunk_id % 5 AS r FROM cited) SELECT a.query_id, a.chunk_id AS a, b.chunk_id AS b, round((10 - abs(a.r - b.r)) / 10, 6) AS overlap FROM x a JOIN x b ON a.query_id = b.query_id AND a.chunk_id < b.chunk_id WHERE abs(a.r - b.r) <= 2")
def block_overlap_pairs(spark, d):
    return C.block_overlap(_with_blocks(spark, d))


@query("SELECT round(avg((doc_id % 6 <> 0)::INT), 6) AS score, count_if(doc_id % 6 = 0) AS without FROM documents")
def citation_auditability(spark, d):
    spans = F.when(F.col("doc_id") % 6 == 0, F.array().cast("array<string>")).otherwise(F.array("lang"))
    return C.auditability(table(spark, d, "documents").select(spans.alias("spans")))


@query()
def context_dedup(spark, d):
    return C.deduplicated(_planted(spark, d)).select("query_id", "chunk_id", "rank")


@query()
def context_compress(spark, d):
    return C.compressed(C.ordered(_planted(spark, d)), _questions(spark, d)).select("query_id", "chunk_id", "position")


@query("""WITH t AS (SELECT doc_id, kind, unnest(m) AS match, unnest(range(1, len(m) + 1)) AS k FROM (SELECT doc_id, 'email' AS kind, regexp_extract_all(coalesce(text, ''), '\\b[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\\.[A-Za-z]{2,}\\b') AS m FROM documents UNION ALL SELECT doc_id, 'phone', regexp_extract_all(coalesce(text, ''), '\\b(?:\\+?[0-9][0-9\\s().-]{7,}[0-9])\\b') FROM documents))
SELECT doc_id, kind, match, true AS found FROM t""")
def pii_places(spark, d):
    """Each finding, and whether its offsets are those of its text."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = A.findings(docs).join(docs, "doc_id")
    return found.select("doc_id", "kind", "match", (F.substr("text", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")) == F.col("match")).alias("found"))

"""Queries over chunks, embeddings and vector deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunks as K
from ..operators import embed as E
from ..operators import store as S
from .catalogue import query
from .fixtures import BLOCKS, VECTORS, blocks, table, vectors

NON = "regexp_extract_all({0}, '[^\\s\\x{{0B}}\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+')"
TOK = NON.format("coalesce(text, '')")


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


@query(f"""WITH t AS (SELECT doc_id, {TOK} AS t FROM documents), w AS (SELECT doc_id, t, unnest(range(0, ceil(greatest(len(t) - 512, 0) / 448)::BIGINT + 1)) AS w FROM t WHERE len(t) > 0)
SELECT doc_id, w AS window, w * 448 AS start, len(t[w * 448 + 1:w * 448 + 512])::BIGINT AS tokens, array_to_string(t[w * 448 + 1:w * 448 + 512], ' ') AS text FROM w""")
def token_windows(spark, d):
    return K.token_windows(_docs(spark, d), "doc_id")


FIXED = f"""bt AS (SELECT doc_id, block_seq, page, unnest({TOK}) AS tok, generate_subscripts({TOK}, 1) AS k FROM blocks), pos AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_seq, k) - 1 AS p, count(*) OVER (PARTITION BY doc_id) AS n FROM bt),
win AS (SELECT *, unnest(range(greatest(0, (p - 512) // 448 + CASE WHEN p >= 512 THEN 1 ELSE 0 END), least(p // 448, ceil(greatest(n - 512, 0) / 448)::BIGINT) + 1)) AS w FROM pos)"""


@query(f"WITH {BLOCKS}, {FIXED}, g AS (SELECT doc_id, w, block_seq, string_agg(tok, ' ' ORDER BY p) AS s, count(*) AS c, any_value(page) AS page FROM win WHERE p >= w * 448 AND p < w * 448 + 512 GROUP BY ALL) SELECT doc_id, w AS window, sum(c)::BIGINT AS tokens, min(page) AS page_start, max(page) AS page_end, string_agg(block_seq::VARCHAR, ',' ORDER BY block_seq) AS blocks, string_agg(s, ' ' ORDER BY block_seq) AS text FROM g GROUP BY ALL")
def fixed_chunks(spark, d):
    return K.fixed_chunks(blocks(spark, d))


@query(f"WITH {BLOCKS}, {FIXED}, g AS (SELECT doc_id, w, block_seq, string_agg(tok, ' ' ORDER BY p) AS s, any_value(page) AS page FROM win WHERE p >= w * 448 AND p < w * 448 + 512 GROUP BY ALL), c AS (SELECT doc_id, w, min(page) AS pg, string_agg(block_seq::VARCHAR, '|' ORDER BY block_seq) AS b, string_agg(s, ' ' ORDER BY block_seq) AS t FROM g GROUP BY ALL) SELECT doc_id || '_p' || pg || '_' || sha1(b || '|' || t[:500])[:12] AS chunk_id, doc_id, w AS window FROM c")
def chunk_model(spark, d):
    return K.chunk_ids(K.fixed_chunks(blocks(spark, d))).select("chunk_id", "doc_id", "window")


@query(f"WITH {BLOCKS}, n AS (SELECT *, {TOK} AS t FROM blocks WHERE trim(text) <> ''), a AS (SELECT doc_id, block_seq, lag(block_seq) OVER w AS previous_id, lead(block_seq) OVER w AS next_id, t, lag(t) OVER w AS p, lead(t) OVER w AS x FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY block_seq)) SELECT doc_id, block_seq, previous_id, next_id, coalesce(len(list_filter(range(1, least(len(p), len(t), 96) + 1), lambda k: p[len(p) - k + 1:] = t[:k])) > 0, FALSE) AS overlap_prev, coalesce(len(list_filter(range(1, least(len(x), len(t), 96) + 1), lambda k: t[len(t) - k + 1:] = x[:k])) > 0, FALSE) AS overlap_next FROM a")
def chunk_adjacency(spark, d):
    b = blocks(spark, d).where(F.trim("text") != "").withColumn("chunk_id", F.col("block_seq"))
    return K.adjacency(b, "block_seq").select("doc_id", "block_seq", "previous_id", "next_id", "overlap_prev", "overlap_next")


_D = "::DOUBLE"


@query(f"""WITH {BLOCKS}, t AS (SELECT *, len({TOK}) AS n FROM blocks) SELECT doc_id, block_seq, round(least(1.0{_D}, 0.3{_D} * CASE WHEN confidence = 0 THEN 0.7{_D} ELSE confidence END + 0.2{_D} * CASE WHEN block_type = 'heading' THEN 1.0{_D} ELSE 0.0{_D} END + 0.2{_D} * CASE WHEN n BETWEEN 64 AND 1024 THEN 1.0{_D} WHEN n > 0 AND n < 64 THEN round(n / 64, 4) WHEN n > 1024 THEN round(1024 / n, 4) ELSE 0.0{_D} END + 0.15{_D} + 0.15{_D} * CASE WHEN is_ocr THEN 0.0{_D} ELSE 1.0{_D} END), 4) AS quality FROM t""")
def chunk_quality(spark, d):
    s = K.quality_score(F.col("confidence"), F.lit(None).cast("double"), F.col("block_type") == "heading", F.col("section") != "", F.col("is_ocr"), F.size(X.nonspace(F.col("text"))))
    return blocks(spark, d).select("doc_id", "block_seq", s.alias("quality"))


@query(f"WITH {BLOCKS} SELECT doc_id, block_seq, array_to_string(list_transform(list_filter(list_transform({NON.format('lower(replace(x, chr(44), chr(32)))')}, lambda y: trim(y, '[]().:')), lambda y: regexp_matches(y, '^(p\\.|page)[0-9]{{1,9}}$')), lambda y: regexp_extract(y, '([0-9]+)$', 1)::BIGINT), ',') AS pages FROM (SELECT *, text || ' see p.' || block_seq || ', (page' || page || ')' AS x FROM blocks)")
def page_references(spark, d):
    x = F.concat("text", F.lit(" see p."), F.col("block_seq").cast("string"), F.lit(", (page"), F.col("page").cast("string"), F.lit(")"))
    return blocks(spark, d).select("doc_id", "block_seq", F.array_join(K.page_references(x), ",").alias("pages"))


@query(f"WITH {BLOCKS}, t AS (SELECT doc_id, block_seq, tok, count(*) AS c FROM (SELECT doc_id, block_seq, unnest({NON.format('lower(text)')}) AS tok FROM blocks) GROUP BY ALL), s AS (SELECT doc_id, block_seq, sum(c) AS n FROM t GROUP BY ALL), o AS (SELECT a.doc_id, a.block_seq, sum(least(a.c, b.c)) AS low FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.block_seq = b.block_seq + 1 AND a.tok = b.tok GROUP BY ALL) SELECT k.doc_id, k.block_seq, CASE WHEN coalesce(x.n, 0) + coalesce(y.n, 0) = 0 THEN 1.0 ELSE round(coalesce(low, 0) / (coalesce(x.n, 0) + coalesce(y.n, 0) - coalesce(low, 0)), 6) END::DOUBLE AS similarity FROM blocks k LEFT JOIN s x ON k.doc_id = x.doc_id AND k.block_seq = x.block_seq LEFT JOIN s y ON k.doc_id = y.doc_id AND k.block_seq = y.block_seq + 1 LEFT JOIN o ON k.doc_id = o.doc_id AND k.block_seq = o.block_seq WHERE k.block_seq > 0")
def adjacent_similarity(spark, d):
    return K.adjacent_similarity(blocks(spark, d))


@query(f"WITH {BLOCKS}, t AS (SELECT *, len({TOK})::BIGINT AS tokens FROM blocks WHERE trim(text) <> ''), s AS (SELECT *, CASE WHEN block_type = 'heading' THEN 'heading_anchored' WHEN block_type = 'table' THEN 'table_aware' WHEN tokens > 1024 THEN 'recursive_window' ELSE 'semantic_merge' END AS strategy FROM t) SELECT doc_id, block_seq, strategy, tokens, strategy = 'table_aware' AS standalone, strategy = 'heading_anchored' OR heading_level IS NOT NULL OR (is_ocr AND CASE WHEN confidence = 0 THEN 1 ELSE confidence END < 0.5) AS boundary FROM s")
def plan_strategy(spark, d):
    return K.plan(blocks(spark, d)).select("doc_id", "block_seq", "strategy", "tokens", "standalone", "boundary")


@query(f"WITH {BLOCKS}, b AS (SELECT doc_id, block_seq, trim(text) AS x FROM blocks WHERE trim(text) <> '') SELECT doc_id, block_seq, instr(coalesce(text, ''), x) - 1 AS start_char, CASE WHEN instr(coalesce(text, ''), x) > 0 THEN instr(coalesce(text, ''), x) - 1 + length(x) END AS end_char FROM b JOIN documents USING (doc_id)")
def source_spans_exact(spark, d):
    return K.source_spans(_docs(spark, d), blocks(spark, d))


@query()
def recursive_split(spark, d):
    return K.recursive_split(_docs(spark, d), "doc_id")


@query()
def semantic_chunks(spark, d):
    return K.chunk_ids(K.semantic_chunks(blocks(spark, d)))


LABEL = "'Part ' || (doc_id % 7)"


@query(f"""SELECT doc_id, trim(CASE doc_id % 4 WHEN 0 THEN '[CODE: sql]' || chr(10) || coalesce(text, '') WHEN 1 THEN '[SECTION: ' || {LABEL} || ']' || chr(10) || coalesce(text, '') ELSE '[HEADING: ' || {LABEL} || '] ' || coalesce(text, '') END) AS prepared FROM documents""")
def embedding_text(spark, d):
    kind = F.when(F.col("doc_id") % 4 == 0, "code").when(F.col("doc_id") % 4 == 1, "list").otherwise("paragraph")
    label = F.concat(F.lit("Part "), (F.col("doc_id") % 7).cast("string"))
    return _docs(spark, d).select("doc_id", E.embedding_text(kind, F.col("text"), label, F.lit("sql")).alias("prepared"))


@query(f"""WITH l AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(list_transform(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(trim(x), '|')), lambda x: x <> '' AND NOT regexp_matches(x, '^[-:]+$')), lambda x: array_to_string(list_filter(list_transform(string_split(x, '|'), lambda c: trim(c)), lambda c: c <> ''), ' ; ')), lambda x: x <> '') AS r FROM documents)
SELECT doc_id, trim('[TABLE: T]' || chr(10) || CASE WHEN len(r) = 0 THEN trim(t) ELSE array_to_string(r[:32], chr(10)) END) AS prepared FROM l""")
def table_serialize(spark, d):
    return _docs(spark, d).select("doc_id", E.serialize_table(F.col("text"), F.lit("T")).alias("prepared"))


@query(f"SELECT doc_id, len({TOK})::BIGINT AS tokens, len({TOK}) > 200 AS truncated, CASE WHEN len({TOK}) > 200 THEN array_to_string(({TOK})[:200], ' ') ELSE coalesce(text, '') END AS text FROM documents")
def embedding_truncate(spark, d):
    return E.truncated(_docs(spark, d), 200)


@query(f"""WITH t AS (SELECT doc_id, tok, count(*) AS n FROM (SELECT doc_id, unnest({NON.format("lower(coalesce(text, ''))")}) AS tok FROM documents) GROUP BY ALL), h AS (SELECT *, sha256(tok) AS h FROM t),
v AS (SELECT doc_id, ('0x' || h[:8])::BIGINT % 64 AS dim, sum(n * CASE WHEN ('0x' || h[9:10])::BIGINT % 2 = 0 THEN 1 ELSE -1 END) AS v FROM h GROUP BY ALL HAVING v <> 0) SELECT doc_id, dim, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6) AS value FROM v""")
def hash_embedding_sha(spark, d):
    return E.sha_embedding(_docs(spark, d), "doc_id")


@query()
def hash_embedding(spark, d):
    return E.hash_embeddings(_docs(spark, d)).select("doc_id", "embedding")


@query("SELECT vec_id, i - 1 AS dim, round(e[i] / n, 6) AS value FROM (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings), unnest(range(1, len(e) + 1)) AS t(i)")
def l2_normalize(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode(X.l2_normalize(F.col("embedding").cast("array<double>"))).alias("dim", "value"))
    return e.select("vec_id", F.col("dim").cast("bigint").alias("dim"), F.round("value", 6).alias("value"))


@query(f"WITH {VECTORS} SELECT a.doc_id, a.chunk_id AS a, b.chunk_id AS b, round(list_cosine_similarity(a.embedding, b.embedding), 6) AS similarity FROM vectors a JOIN vectors b ON a.doc_id = b.doc_id AND a.chunk_id < b.chunk_id WHERE round(list_cosine_similarity(a.embedding, b.embedding), 6) >= 0.98")
def vector_dup_pairs(spark, d):
    return E.same_document_pairs(vectors(spark, d))


@query()
def vector_dedup(spark, d):
    return E.vector_decisions(vectors(spark, d)).select("chunk_id", "doc_id", "decision", "duplicate_of")


@query("""WITH ex AS (SELECT vec_id AS chunk_id, label AS doc_id, CASE vec_id % 3 WHEN 0 THEN 'v1' WHEN 1 THEN 'v2' END AS version FROM embeddings), inc AS (SELECT DISTINCT label AS doc_id, CASE WHEN label % 2 = 0 THEN 'v2' END AS version FROM embeddings),
st AS (SELECT doc_id, count(*) AS stale, min(chunk_id) AS first_stale FROM ex JOIN inc USING (doc_id) WHERE inc.version IS NOT NULL AND ex.version IS DISTINCT FROM inc.version GROUP BY doc_id) SELECT doc_id, version, coalesce(stale, 0) AS stale, first_stale, stale IS NOT NULL AS replace FROM inc LEFT JOIN st USING (doc_id)""")
def reindex_plan(spark, d):
    e = table(spark, d, "embeddings")
    existing = e.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("doc_id"), F.when(F.col("vec_id") % 3 == 0, "v1").when(F.col("vec_id") % 3 == 1, "v2").alias("version"))
    return E.reindex_plan(e.select(F.col("label").alias("doc_id"), F.when(F.col("label") % 2 == 0, "v2").alias("version")), existing)


@query(f"WITH {VECTORS}, p AS (SELECT a.chunk_id, b.chunk_id AS other, round(list_cosine_similarity(a.embedding, b.embedding), 6) AS similarity FROM vectors a JOIN vectors b ON a.doc_id <> b.doc_id) SELECT chunk_id, arg_max(other, (similarity, -other)) AS other, max(similarity) AS similarity FROM p WHERE similarity >= 0.97 GROUP BY chunk_id")
def vector_cross_document(spark, d):
    return E.cross_document(vectors(spark, d))


@query(f"""WITH {BLOCKS}, s AS (SELECT *, list_filter(list_transform({NON.format('lower(replace(x, chr(44), chr(32)))')}, lambda y: trim(y, '[]().:')), lambda y: regexp_matches(y, '^(p\\.|page)[0-9]{{1,9}}$')) AS refs FROM (SELECT *, text || ' see p.' || block_seq AS x FROM blocks))
SELECT doc_id, block_seq, concat_ws(',', CASE WHEN confidence < 0.4 THEN 'low_quality' END, CASE WHEN confidence < 0.55 THEN 'low_parse_confidence' END, CASE WHEN is_ocr AND confidence < 0.5 THEN 'high_ocr_risk' END,
 CASE WHEN len(list_filter(refs, lambda y: regexp_extract(y, '([0-9]+)$', 1)::BIGINT NOT BETWEEN page AND page + 1)) > 0 THEN 'citation_out_of_bounds' END) AS flags, coalesce(regexp_matches(ltrim(text), '^\\p{{Ll}}'), false) AS inside FROM s""")
def chunk_flags(spark, d):
    refs = K.page_references(F.concat("text", F.lit(" see p."), F.col("block_seq").cast("string")))
    c = F.col("confidence")
    flags = K.quality_flags(c, c, F.col("is_ocr"), c, refs, F.col("page"), F.col("page") + 1)
    return blocks(spark, d).select("doc_id", "block_seq", F.array_join(flags, ",").alias("flags"), K.starts_inside(F.col("text")).alias("inside"))


@query(f"WITH {BLOCKS} SELECT doc_id, min(block_seq) AS block_seq, arg_min(page, block_seq) AS page, arg_min(section, block_seq) AS section FROM blocks WHERE block_seq % 4 = 3 GROUP BY doc_id")
def fallback_provenance(spark, d):
    """Only every fourth block of this fixture has any provenance."""
    known = F.col("block_seq") % 4 == 3
    b = blocks(spark, d).withColumns({c: F.when(known, F.col(c)) for c in ("page", "section", "doc_type")})
    return K.fallback_source(b).select("doc_id", "block_seq", "page", "section")


_STORE = "old AS (SELECT doc_id AS chunk_id, doc_id // 3 AS doc_id, coalesce(text, '') AS text FROM documents), new AS (SELECT item_id * 2 AS chunk_id, item_id // 3 AS doc_id, coalesce(text, '') AS text FROM benchmark)"


def _store(spark, d):
    """A store of all documents, three to a document, and the benchmark's items as what comes in."""
    third = lambda c: F.floor(F.col(c) / 3).cast("bigint").alias("doc_id")
    old = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), third("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    new = table(spark, d, "benchmark").select((F.col("item_id") * 2).alias("chunk_id"), third("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    return old, new


@query(f"WITH {_STORE} SELECT chunk_id, doc_id, sha256(text) AS sha FROM new UNION ALL SELECT chunk_id, doc_id, sha256(text) FROM old WHERE chunk_id NOT IN (SELECT chunk_id FROM new)")
def store_upsert(spark, d):
    return S.upsert(*_store(spark, d)).select("chunk_id", "doc_id", F.sha2("text", 256).alias("sha"))


@query(f"WITH {_STORE} SELECT chunk_id, doc_id, sha256(text) AS sha FROM new UNION ALL SELECT chunk_id, doc_id, sha256(text) FROM old WHERE chunk_id NOT IN (SELECT chunk_id FROM new) AND doc_id NOT IN (SELECT doc_id FROM new)")
def store_replace(spark, d):
    return S.replace_documents(*_store(spark, d)).select("chunk_id", "doc_id", F.sha2("text", 256).alias("sha"))


@query(f"WITH {_STORE} SELECT doc_id, count(*) FILTER (WHERE o) AS before, count(*) FILTER (WHERE n) AS after, count(*) FILTER (WHERE o AND NOT n) AS stale FROM (SELECT doc_id, chunk_id, bool_or(o) AS o, bool_or(n) AS n FROM (SELECT doc_id, chunk_id, true AS o, false AS n FROM old UNION ALL SELECT doc_id, chunk_id, false, true FROM new) GROUP BY ALL) WHERE doc_id IN (SELECT doc_id FROM new) GROUP BY doc_id")
def store_replaced(spark, d):
    return S.replaced(*_store(spark, d))


@query(f"WITH {_STORE} SELECT chunk_id, doc_id FROM old WHERE doc_id IN (SELECT doc_id FROM new)")
def store_by_document(spark, d):
    old, new = _store(spark, d)
    return S.by_document(old, new).select("chunk_id", "doc_id")


@query("SELECT doc_id AS chunk_id, coalesce(text, '') AS text, NULL::VARCHAR AS embedding_text, lang, n_chars FROM documents")
def store_round_trip(spark, d):
    """Chunks projected to stored documents and read back."""
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "text", F.lit("").alias("embedding_text"), "lang", "n_chars")
    back = S.from_stored(S.sparse_document(rows, ["lang", "n_chars"]), "lang string, n_chars bigint")
    return back.withColumn("chunk_id", F.col("chunk_id").cast("bigint"))

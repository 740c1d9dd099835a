"""Queries over files, parsing and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import parse as P
from ..sources import files as S
from ..sources import pages as G
from .catalogue import query
from .fixtures import BLOCKS, blocks, table

EXT = "CASE page_id % 6 WHEN 0 THEN '.html' WHEN 1 THEN '.pdf' WHEN 2 THEN '.TXT' WHEN 3 THEN '.exe' WHEN 4 THEN '' ELSE '.docx' END"
BODY = "CASE page_id % 5 WHEN 0 THEN coalesce(html, '') WHEN 1 THEN '%PDF-1.7 ' || CASE WHEN page_id % 2 = 0 THEN '/Encrypt' ELSE '' END WHEN 2 THEN '' WHEN 3 THEN 'From: a' || chr(10) || url ELSE 'plain text of host ' || split_part(url, '/', 3) END"
FILES = f"f AS (SELECT page_id AS ordinal, '/data/' || page_id || {EXT} AS path, lower({EXT}) AS ext, {BODY} AS body FROM pages), m AS (SELECT *, CASE WHEN starts_with(body, '%PDF') THEN 'application/pdf' WHEN contains(lower(body[:4096]), '<html') OR contains(lower(body[:4096]), '<!doctype html') OR contains(lower(body[:4096]), '<body') OR contains(lower(body[:4096]), '<head') THEN 'text/html' WHEN contains(lower(body[:4096]), '<?xml') THEN 'application/xml' WHEN contains(lower(body[:4096]), 'from:') THEN 'message/rfc822' WHEN body <> '' THEN 'text/plain' ELSE 'application/octet-stream' END AS media FROM f)"


def _files(spark, d):
    p = table(spark, d, "pages")
    ext = F.expr("CASE page_id % 6 WHEN 0 THEN '.html' WHEN 1 THEN '.pdf' WHEN 2 THEN '.TXT' WHEN 3 THEN '.exe' WHEN 4 THEN '' ELSE '.docx' END")
    body = F.expr("CASE page_id % 5 WHEN 0 THEN coalesce(html, '') WHEN 1 THEN concat('%PDF-1.7 ', CASE WHEN page_id % 2 = 0 THEN '/Encrypt' ELSE '' END) WHEN 2 THEN '' WHEN 3 THEN concat('From: a\\n', url) ELSE concat('plain text of host ', split_part(url, '/', 3)) END")
    return p.select(F.col("page_id").alias("ordinal"), F.concat(F.lit("/data/"), F.col("page_id").cast("string"), ext).alias("path"), F.encode(body, "UTF-8").alias("content"))


@query(f"WITH {FILES} SELECT ordinal, ext, media FROM m")
def media_sniff(spark, d):
    return _files(spark, d).select("ordinal", S.extension(F.col("path")).alias("ext"), S.media_type(F.col("content")).alias("media"))


@query(f"WITH {FILES} SELECT ordinal, CASE WHEN media = 'application/pdf' THEN 'pdf' WHEN ext = '.docx' THEN 'office' WHEN media = 'text/html' THEN 'html' WHEN media = 'application/xml' THEN 'xml' WHEN media = 'message/rfc822' THEN 'email' WHEN starts_with(media, 'text/') THEN 'text' ELSE CASE WHEN ext = '' THEN 'unknown' ELSE ext[2:] END END AS family FROM m")
def family_classify(spark, d):
    return _files(spark, d).select("ordinal", S.family(S.extension(F.col("path")), S.media_type(F.col("content"))).alias("family"))


_OK = "((ext = '.html' AND media = 'text/html') OR (ext = '.pdf' AND media = 'application/pdf') OR (ext = '.txt' AND media = 'text/plain'))"


@query(f"WITH {FILES} SELECT ordinal, ext IN ('.html', '.pdf', '.txt', '.docx') AS allowed, {_OK} AS consistent FROM m")
def extension_policy(spark, d):
    f = _files(spark, d)
    ext, media = S.extension(F.col("path")), S.media_type(F.col("content"))
    return f.select("ordinal", S.allowed(ext).alias("allowed"), S.consistent(ext, media).alias("consistent"))


@query(f"WITH {FILES} SELECT ordinal, sha256(body) AS sha FROM f")
def file_hash(spark, d):
    return _files(spark, d).select("ordinal", F.sha2("content", 256).alias("sha"))


@query(f"WITH {FILES} SELECT ordinal, row_number() OVER (PARTITION BY sha256(body) ORDER BY ordinal) > 1 AS duplicate FROM f")
def batch_duplicates(spark, d):
    return S.duplicates(_files(spark, d)).select("ordinal", "duplicate")


@query(f"""WITH {FILES}, i AS (SELECT ordinal, list_filter([CASE WHEN body = '' THEN 'empty_file' END, CASE WHEN ext NOT IN ('.html', '.pdf', '.txt', '.docx') THEN 'unsupported_extension' END, CASE WHEN NOT {_OK} THEN 'mime_mismatch' END, CASE WHEN ext = '.pdf' AND media <> 'application/pdf' THEN 'corrupted' END, CASE WHEN media = 'application/pdf' AND contains(body, '/Encrypt') THEN 'encrypted' END, CASE WHEN row_number() OVER (PARTITION BY sha256(body) ORDER BY ordinal) > 1 THEN 'duplicate' END], lambda x: x IS NOT NULL) AS s FROM m)
SELECT ordinal, array_to_string(s, ',') AS issues, (list_filter(s, lambda x: x <> 'mime_mismatch'))[1] AS failure_reason, len(list_filter(s, lambda x: x <> 'mime_mismatch')) = 0 AS is_valid FROM i""")
def validation_issues(spark, d):
    return S.validated(_files(spark, d)).select("ordinal", F.array_join("issues", ",").alias("issues"), "failure_reason", "is_valid")


STATS = "st AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' WHEN 2 THEN 'html' WHEN 3 THEN 'zip' ELSE 'pdf' END AS family, doc_id % 11 = 0 AS encrypted, 1 + n_chars // 300 AS pages, n_chars // (1 + doc_id % 9) AS chars, (1 + n_chars // 300) * (doc_id % 3) // 2 AS image_pages FROM documents), rt AS (SELECT *, CASE WHEN encrypted THEN 'encrypted_pdf' WHEN family = 'image' THEN 'image_document' WHEN family = 'pdf' AND chars / pages < 50 THEN 'scanned_pdf' WHEN family = 'pdf' AND image_pages / pages >= 0.6 AND chars / pages < 200 THEN 'image_heavy_pdf' WHEN family = 'pdf' THEN 'native_pdf' WHEN family = 'html' THEN 'html' ELSE 'unsupported_primary_type' END AS reason FROM st)"


def _stats(spark, d):
    return table(spark, d, "documents").selectExpr("doc_id", "CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' WHEN 2 THEN 'html' WHEN 3 THEN 'zip' ELSE 'pdf' END AS family", "doc_id % 11 = 0 AS encrypted", "1 + n_chars DIV 300 AS pages", "n_chars DIV (1 + doc_id % 9) AS chars", "((1 + n_chars DIV 300) * (doc_id % 3)) DIV 2 AS image_pages")


@query(f"WITH {STATS} SELECT doc_id, reason, CASE WHEN reason = 'encrypted_pdf' THEN 'manual_recovery' WHEN reason IN ('image_document', 'scanned_pdf') THEN 'ocr_only,docling,pymupdf,unstructured' WHEN reason = 'image_heavy_pdf' THEN 'docling,ocr_only,pymupdf,unstructured' WHEN reason = 'native_pdf' THEN 'docling,pymupdf,unstructured,ocr_only' ELSE 'pymupdf,unstructured' END AS parsers, reason IN ('image_document', 'scanned_pdf', 'image_heavy_pdf') AS requires_ocr FROM rt")
def parser_route(spark, d):
    return P.route(_stats(spark, d)).select("doc_id", "reason", F.array_join("parsers", ",").alias("parsers"), "requires_ocr")


ATT = "att AS (SELECT doc_id, step, CASE step WHEN 0 THEN 'docling' WHEN 1 THEN 'pymupdf' ELSE 'ocr_only' END AS parser, (doc_id + step) % 4 = 0 AS ok, CASE (doc_id + step) % 4 WHEN 1 THEN 'empty content' ELSE 'No module named x' END AS error FROM documents, (SELECT unnest([0, 1, 2]) AS step))"


def _attempts(spark, d):
    a = table(spark, d, "documents").select("doc_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("step"))
    return a.selectExpr("doc_id", "step", "CASE step WHEN 0 THEN 'docling' WHEN 1 THEN 'pymupdf' ELSE 'ocr_only' END AS parser", "(doc_id + step) % 4 = 0 AS ok", "CASE (doc_id + step) % 4 WHEN 1 THEN 'empty content' ELSE 'No module named x' END AS error")


@query(f"WITH {ATT} SELECT doc_id, min_by(parser, step) FILTER (ok) AS parser, count(*) AS attempts, min_by(error, step) FILTER (NOT ok) AS first_error FROM att GROUP BY doc_id")
def attempt_winner(spark, d):
    return P.winners(_attempts(spark, d), "doc_id")


@query(f"WITH {ATT} SELECT doc_id, step, CASE WHEN error = 'empty content' THEN 'primary_empty_output' ELSE 'primary_dependency_missing' END AS reason FROM att WHERE NOT ok")
def error_reason(spark, d):
    return _attempts(spark, d).where("not ok").select("doc_id", "step", P.error_reason(F.col("error"), F.lit("ValueError")).alias("reason"))


CONF = f"{BLOCKS}, has AS (SELECT doc_id, bool_or(block_type = 'table') AS tb, bool_or(heading_level IS NOT NULL) AS hd FROM blocks GROUP BY doc_id), {STATS}, cf AS (SELECT doc_id, round(least(1.0, greatest(0.0, 0.3::DOUBLE + CASE WHEN reason IN ('image_document', 'scanned_pdf', 'image_heavy_pdf') THEN -0.3 ELSE 0.4 END + CASE WHEN tb THEN 0.2 ELSE 0 END + CASE WHEN hd THEN 0.2 ELSE 0 END - CASE WHEN doc_id % 2 = 0 THEN 0.2 ELSE 0 END)), 6)::DOUBLE AS parse_confidence FROM rt JOIN has USING (doc_id))"


def _reports(spark, d):
    has = blocks(spark, d).groupBy("doc_id").agg(F.bool_or(F.col("block_type") == "table").alias("tb"), F.bool_or(F.col("heading_level").isNotNull()).alias("hd"))
    return P.route(_stats(spark, d)).join(has, "doc_id").select("doc_id", P.confidence(F.col("requires_ocr"), F.col("tb"), F.col("hd"), F.col("doc_id") % 2 == 0).alias("parse_confidence"))


@query(f"WITH {CONF} SELECT * FROM cf")
def parse_confidence(spark, d):
    return _reports(spark, d)


@query(f"WITH {CONF} SELECT doc_id, block_seq, parse_confidence, CASE WHEN parse_confidence >= 0.85 THEN 'high' WHEN parse_confidence >= 0.6 THEN 'medium' ELSE 'low' END AS confidence_bucket FROM blocks JOIN cf USING (doc_id)")
def provenance_join(spark, d):
    return P.provenance(blocks(spark, d), _reports(spark, d)).select("doc_id", "block_seq", "parse_confidence", "confidence_bucket")


@query(f"WITH {ATT}, w AS (SELECT doc_id, min_by(parser, step) FILTER (ok) AS parser FROM att GROUP BY doc_id) SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'rejected' WHEN doc_id % 11 = 0 THEN 'quarantined' WHEN parser IS NOT NULL THEN 'parsed' ELSE 'failed' END AS status FROM w")
def terminal_status(spark, d):
    return P.winners(_attempts(spark, d), "doc_id").select("doc_id", P.status(F.col("doc_id") % 17 != 0, F.col("parser"), F.col("doc_id") % 11 == 0).alias("status"))


@query()
def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", G.html_text(F.col("html")).alias("text"))


@query("SELECT doc_id, (i)::BIGINT AS page, trim(p[i]) AS text FROM (SELECT doc_id, string_split(replace(coalesce(text, ''), '. ', chr(12)), chr(12)) AS p FROM documents), unnest(range(1, len(p) + 1)) AS t(i) WHERE trim(p[i]) <> ''")
def formfeed_blocks(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit("\f")).alias("text"))
    return G.form_feed_blocks(docs)


@query(f"WITH {BLOCKS} SELECT doc_id, block_seq, doc_id || '_p' || page || '_b' || order_in_page || '_' || sha1(text[:500])[:12] AS block_id FROM blocks")
def block_ids(spark, d):
    return blocks(spark, d).select("doc_id", "block_seq", G.block_id(F.col("doc_id").cast("string"), F.col("page"), F.col("order_in_page"), F.col("text")).alias("block_id"))


@query(f"WITH {BLOCKS}, w AS (SELECT doc_id::VARCHAR AS page, '1' AS block, (block_seq // 3)::VARCHAR AS par, block_seq::VARCHAR AS line, i AS seq, t[i] AS text, ((doc_id + i * 7) % 130 - 5) AS conf FROM (SELECT doc_id, block_seq, string_split(text, ' ') AS t FROM blocks), unnest(range(1, len(t) + 1)) AS u(i)) SELECT page, block, par, line, string_agg(text, ' ' ORDER BY seq) AS text, round(avg(least(conf / 100, 1.0::DOUBLE)) + 1e-9, 6) AS confidence FROM w WHERE trim(text) <> '' AND conf >= 0 GROUP BY ALL")
def ocr_line_group(spark, d):
    w = blocks(spark, d).select(F.col("doc_id").cast("string").alias("page"), F.lit("1").alias("block"), F.expr("CAST(block_seq DIV 3 AS STRING)").alias("par"), F.col("block_seq").cast("string").alias("line"), "doc_id", F.posexplode(F.split("text", " ")).alias("seq", "text"))
    lines = G.ocr_lines(w.withColumn("conf", (F.col("doc_id") + (F.col("seq") + 1) * 7) % 130 - 5))
    return lines.withColumn("confidence", F.round(F.col("confidence") + 1e-9, 6))


PATHS = "p AS (SELECT page_id, url || CASE page_id % 8 WHEN 0 THEN '/sec/x' WHEN 1 THEN '/Court.pdf' WHEN 2 THEN '/ai_act' WHEN 3 THEN '/arXiv.html' WHEN 4 THEN '/a.htm' WHEN 5 THEN '/b.PDF' WHEN 6 THEN '/10-K.html' ELSE '/z' END AS path FROM pages)"


@query(f"WITH {PATHS} SELECT page_id, CASE WHEN contains(lower(path), '10-k') OR contains(lower(path), '/sec/') OR contains(lower(path), 'sec_') THEN 'sec_filing' WHEN contains(lower(path), 'court') OR contains(lower(path), 'opinion') THEN 'court_opinion' WHEN contains(lower(path), 'eur-lex') OR contains(lower(path), 'ai_act') THEN 'regulation' WHEN contains(lower(path), 'arxiv') THEN 'research_paper' WHEN regexp_matches(lower(path), '\\.html?$') THEN 'web_document' WHEN regexp_matches(lower(path), '\\.pdf$') THEN 'pdf_document' ELSE 'unknown' END AS doc_type FROM p")
def path_doc_type(spark, d):
    tail = F.expr("CASE page_id % 8 WHEN 0 THEN '/sec/x' WHEN 1 THEN '/Court.pdf' WHEN 2 THEN '/ai_act' WHEN 3 THEN '/arXiv.html' WHEN 4 THEN '/a.htm' WHEN 5 THEN '/b.PDF' WHEN 6 THEN '/10-K.html' ELSE '/z' END")
    return table(spark, d, "pages").select("page_id", G.doc_type(F.concat("url", tail)).alias("doc_type"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN greatest(page_id % 4, 1) ELSE page_id % 3 END AS page, CASE page_id % 4 WHEN 0 THEN 'Document' WHEN 1 THEN 'Document' ELSE 'Intro' END AS section, CASE WHEN page_id % 5 = 0 THEN 1 ELSE page_id % 5 END AS order_in_page FROM pages")
def enrich_defaults(spark, d):
    p = table(spark, d, "pages").selectExpr("page_id", "page_id % 3 AS page", "page_id % 4 AS index", "CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN ' HTML ' ELSE ' Intro' END AS section", "page_id % 5 AS order_in_page")
    return G.enriched(p).select("page_id", "page", "section", "order_in_page")

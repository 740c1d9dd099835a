"""Queries over audits, metrics, jobs and rate limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import chunks as K
from ..operators import monitor as M
from ..streaming import limiter
from .block_queries import _REASON
from .catalogue import query
from .fixtures import BLOCKS, blocks, table

AUDIT = """au AS (SELECT doc_id, 'p' AS parser_used, FALSE AS fallback_used, FALSE AS ocr_used, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 0.0 END AS parse_confidence, 'fixed' AS chunking_strategy, CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE 'a' END AS heading_anchor, doc_id % 7 <> 0 AS pv, [lang] AS source_block_ids, 0.5 AS chunk_quality_score FROM documents),
ms AS (SELECT doc_id, list_filter([CASE WHEN parse_confidence IS NULL THEN 'parse_confidence' END, CASE WHEN trim(heading_anchor) = '' THEN 'heading_anchor' END, CASE WHEN NOT pv THEN 'overlap_prev|previous_chunk_id' END, 'overlap_next|next_chunk_id', 'ingestion_timestamp', 'document_version', 'embedding_model', 'embedding_model_version'], lambda x: x IS NOT NULL) AS m FROM au)"""


def _audited(spark, d):
    c = table(spark, d, "documents").selectExpr("doc_id", "'p' AS parser_used", "false AS fallback_used", "false AS ocr_used", "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 0.0 END AS parse_confidence", "'fixed' AS chunking_strategy", "CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE 'a' END AS heading_anchor", "CASE WHEN doc_id % 7 <> 0 THEN 'c' END AS previous_chunk_id", "array(lang) AS source_block_ids", "0.5 AS chunk_quality_score")
    return M.audited(c)


@query(f"WITH {AUDIT} SELECT doc_id, array_to_string(m, ',') AS missing, round(1 - len(m) / 14.0::DOUBLE, 6) AS completeness, len(m) = 0 AS passed FROM ms")
def audit_completeness(spark, d):
    return _audited(spark, d).select("doc_id", F.array_join("missing", ",").alias("missing"), "completeness", "passed")


@query(f"WITH {AUDIT} SELECT count(*) AS chunks, round(avg(1 - len(m) / 14.0::DOUBLE), 5) AS score, count_if(1 - len(m) / 14.0::DOUBLE < 0.5) AS low FROM ms")
def audit_low(spark, d):
    return _audited(spark, d).agg(F.count("*").alias("chunks"), F.round(F.avg("completeness"), 5).alias("score"), F.count_if(F.col("completeness") < 0.5).alias("low"))


@query("SELECT event_type, count(*) AS n, round(avg((value > 50)::INT), 6) AS high_rate, round(avg((value < 10)::INT), 6) AS low_rate FROM events GROUP BY event_type")
def metric_rates(spark, d):
    return M.rates(table(spark, d, "events"), "event_type", high_rate=F.col("value") > 50, low_rate=F.col("value") < 10)


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def metric_quantiles(spark, d):
    return M.quantiles(table(spark, d, "events"), "event_type", "value")


@query("WITH r AS (SELECT event_type, round(avg((value > 50)::INT), 6) AS v FROM events GROUP BY event_type) SELECT event_type, CASE WHEN v > 0.3 THEN 'critical' WHEN v > 0.15 THEN 'warning' ELSE 'ok' END AS state FROM r")
def alert_status(spark, d):
    r = metric_rates(spark, d)
    return r.select("event_type", M.alert(F.col("high_rate"), F.lit(0.15), F.lit(0.3), F.lit("above")).alias("state"))


@query("SELECT CASE WHEN quality = 0 AND toxic = 1 THEN 'quarantined' WHEN quality = 0 THEN 'failed' ELSE 'parsed' END AS status, CASE WHEN quality = 0 THEN source END AS reason, count(*) AS documents FROM labels JOIN documents USING (doc_id) GROUP BY ALL")
def ingest_summary(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    s = F.when((F.col("quality") == 0) & (F.col("toxic") == 1), "quarantined").when(F.col("quality") == 0, "failed").otherwise("parsed")
    return M.ingest_summary(j.select(s.alias("status"), F.when(F.col("quality") == 0, F.col("source")).alias("reason")))


@query("SELECT user_id || '/' || event_type AS idempotency_key, arg_max(event_id, (ts, event_id)) AS job_id, arg_max(CASE WHEN value > 50 THEN 'failed' ELSE 'completed' END, (ts, event_id)) AS status FROM events GROUP BY ALL")
def job_latest(spark, d):
    j = table(spark, d, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("idempotency_key"), F.col("event_id").alias("job_id"), F.col("ts").alias("updated_at"), F.when(F.col("value") > 50, "failed").otherwise("completed").alias("status"))
    return M.latest(j)


@query("SELECT coalesce(CASE WHEN event_id % 4 <> 0 THEN event_id - event_id % 4 END, event_id) AS job_id, max(event_id % 4 + 1) + 1 AS next_attempt FROM events GROUP BY 1")
def job_attempts(spark, d):
    j = table(spark, d, "events").select(F.col("event_id").alias("job_id"), F.when(F.col("event_id") % 4 != 0, F.col("event_id") - F.col("event_id") % 4).alias("replay_of"), (F.col("event_id") % 4 + 1).alias("attempt"))
    return M.next_attempts(j)


@query("SELECT user_id AS job_id, event_id AS path FROM events WHERE value > 50")
def replay_paths(spark, d):
    r = table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("path"), F.when(F.col("value") > 80, "quarantined").when(F.col("value") > 50, "failed").otherwise("parsed").alias("status"))
    return M.replay_paths(r)


@query("""WITH RECURSIVE r AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
s AS (SELECT user_id, event_id, k, TRUE AS allowed, ts + INTERVAL 12 HOUR AS reset, 1 AS used FROM r WHERE k = 1
 UNION ALL SELECT r.user_id, r.event_id, r.k, r.ts >= s.reset OR s.used < 2, CASE WHEN r.ts >= s.reset THEN r.ts + INTERVAL 12 HOUR ELSE s.reset END, CASE WHEN r.ts >= s.reset THEN 1 WHEN s.used < 2 THEN s.used + 1 ELSE s.used END FROM s JOIN r ON r.user_id = s.user_id AND r.k = s.k + 1)
SELECT user_id, event_id, allowed FROM s""")
def rate_limit(spark, d):
    return limiter.limited(table(spark, d, "events"), "user_id", 2, 12 * 3600)


_NS = "regexp_extract_all(text, '[^\\s\\x{0B}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+')"


@query(f"""WITH {BLOCKS}, {{reason}}, t AS (SELECT *, len({_NS}) AS n FROM blocks WHERE trim(text) <> ''), v AS (
SELECT 'ocr_activation_rate' AS metric, 'ingestion' AS layer, avg(is_ocr::INT) AS value, NULL AS w, NULL AS c FROM blocks
UNION ALL SELECT 'block_drop_rate', 'block_quality', avg((reason IS NOT NULL)::INT), 0.10, 0.25 FROM r
UNION ALL SELECT 'standalone_block_ratio', 'chunking', avg((block_type = 'table')::INT), NULL, NULL FROM t
UNION ALL SELECT 'avg_chunk_token_count', 'chunking', avg(n), NULL, NULL FROM t
UNION ALL SELECT 'embedding_failure_rate', 'embedding', avg((value > 95)::INT), 0.01, 0.05 FROM events)
SELECT metric, layer, round(value, 5) AS value, CASE WHEN value > c THEN 'critical' WHEN value > w THEN 'warning' ELSE 'ok' END AS state FROM v""".replace("{reason}", _REASON))
def pipeline_metrics(spark, d):
    b = blocks(spark, d)
    plan = K.plan(b)
    return M.measured(
        spark,
        {
            "ocr_activation_rate": b.agg(F.avg(F.col("is_ocr").cast("int"))),
            "block_drop_rate": B.quality_reason(b).agg(F.avg(F.col("reason").isNotNull().cast("int"))),
            "standalone_block_ratio": plan.agg(F.avg(F.col("standalone").cast("int"))),
            "avg_chunk_token_count": plan.agg(F.avg("tokens")),
            "embedding_failure_rate": table(spark, d, "events").agg(F.avg((F.col("value") > 95).cast("int"))),
        },
    )


@query("SELECT unnest(['parser_fallback_rate_alert', 'manual_recovery_rate_alert', 'upsert_failure_rate_alert', 'chunk_quality_score_p50_alert', 'block_drop_rate', 'embedding_failure_rate']) AS metric, unnest([0.15, 0.02, 0.005, 0.6, 0.1, 0.01])::DOUBLE AS warning, unnest([0.3, 0.05, 0.02, 0.4, 0.25, 0.05])::DOUBLE AS critical")
def metric_thresholds(spark, d):
    return M.catalogue(spark).where("direction is not null").select("metric", "warning", "critical")

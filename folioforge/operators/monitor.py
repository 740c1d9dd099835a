"""Audit completeness, metric rates, alert states, ingest summaries and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Groups of fields of which one must be there.
REQUIREMENTS = (("parser_used",), ("fallback_used",), ("ocr_used",), ("parse_confidence",), ("chunking_strategy",), ("heading_anchor",), ("overlap_prev", "previous_chunk_id"), ("overlap_next", "next_chunk_id"), ("source_block_ids",), ("chunk_quality_score",), ("ingestion_timestamp",), ("document_version",), ("embedding_model",), ("embedding_model_version",))
_LAYERS = {
    "ingestion": "parser_success_rate parser_fallback_rate ocr_activation_rate parse_confidence_p50 parse_confidence_p95 file_type_failure_rate manual_recovery_rate",
    "block_quality": "block_drop_rate ocr_cleanup_rate artifact_removal_rate malformed_table_rate dedup_drop_rate",
    "chunking": "avg_chunk_token_count chunk_quality_score_p50 chunk_quality_score_p95 standalone_block_ratio overlap_validation_failures",
    "embedding": "embedding_failure_rate embedding_retry_rate vector_duplicate_rate upsert_failure_rate re_index_consistency_rate",
    "retrieval": "retrieval_hit_rate reranker_correction_rate citation_success_rate orphan_citation_rate unsupported_answer_rate faithfulness_score_p50",
    "alerts": "chunk_quality_score_p50_alert parser_fallback_rate_alert manual_recovery_rate_alert upsert_failure_rate_alert",
}
#: (warning, critical, direction) where set.
THRESHOLDS = {"embedding_failure_rate": (0.01, 0.05, "above"), "block_drop_rate": (0.10, 0.25, "above"), "chunk_quality_score_p50_alert": (0.60, 0.40, "below"), "parser_fallback_rate_alert": (0.15, 0.30, "above"), "manual_recovery_rate_alert": (0.02, 0.05, "above"), "upsert_failure_rate_alert": (0.005, 0.02, "above")}
#: name -> (layer, warning, critical, direction): the 32 metrics of the pipeline.
METRICS = {name: (layer, *THRESHOLDS.get(name, (None, None, None))) for layer, names in _LAYERS.items() for name in names.split()}


def catalogue(spark: SparkSession) -> DataFrame:
    """(metric, layer, warning, critical, direction)."""
    return spark.createDataFrame([(k, *v) for k, v in METRICS.items()], "metric string, layer string, warning double, critical double, direction string")


def measured(spark: SparkSession, values: dict[str, DataFrame]) -> DataFrame:
    """(metric, layer, value, state) of metrics given as one-row, one-column aggregates of stage tables."""
    rows = None
    for name, df in values.items():
        one = df.select(F.lit(name).alias("metric"), F.round(df[df.columns[0]].cast("double"), 5).alias("value"))
        rows = one if rows is None else rows.unionByName(one)
    j = rows.join(F.broadcast(catalogue(spark)), "metric")  # 32 rows
    return j.select("metric", "layer", "value", alert(F.col("value"), F.col("warning"), F.col("critical"), F.col("direction")).alias("state"))


def present(c: Column, kind: str) -> Column:
    """Not null, not blank, not an empty list; False and 0 are values."""
    if kind == "string":
        return F.coalesce(F.trim(c) != "", F.lit(False))
    if kind.startswith("array"):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    return c.isNotNull()


def audited(chunks: DataFrame, requirements=REQUIREMENTS) -> DataFrame:
    """missing (names of the groups), completeness and passed; a column that isn't there is missing."""
    kinds = dict(chunks.dtypes)
    tests = []
    for group in requirements:
        has = F.lit(False)
        for c in group:
            if c in kinds:
                has = has | present(F.col(c), kinds[c])
        tests.append(F.when(~has, F.lit("|".join(group))))
    c = chunks.withColumn("missing", F.filter(F.array(*tests), lambda x: x.isNotNull()))
    return c.withColumns({"completeness": F.round(1 - F.size("missing") / F.lit(float(len(requirements))), 6), "passed": F.size("missing") == 0})


def alert(value: Column, warning: Column, critical: Column, direction: Column) -> Column:
    """ok, warning or critical; null thresholds never alert."""
    above, below = direction == "above", direction == "below"
    worse = lambda t: (above & (value > t)) | (below & (value < t))
    return F.when(F.coalesce(worse(critical), F.lit(False)), "critical").when(F.coalesce(worse(warning), F.lit(False)), "warning").otherwise("ok")


def rates(rows: DataFrame, group: str, **conditions: Column) -> DataFrame:
    """Share of rows of each group for which each condition holds."""
    return rows.groupBy(group).agg(F.count("*").alias("n"), *(F.round(F.avg(c.cast("int")), 6).alias(k) for k, c in conditions.items()))


def quantiles(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Exact median and 95th percentile; the aggregate keeps counts of distinct values."""
    return rows.groupBy(group).agg(F.round(F.expr(f"percentile({value}, 0.5)"), 6).alias("p50"), F.round(F.expr(f"percentile({value}, 0.95)"), 6).alias("p95"))


def ingest_summary(results: DataFrame) -> DataFrame:
    """Counts by status and reason."""
    return results.groupBy("status", "reason").agg(F.count("*").alias("documents"))


def latest(jobs: DataFrame, key: str = "idempotency_key") -> DataFrame:
    """The record of each key that was updated last (the greatest id of several at once)."""
    best = jobs.groupBy(key).agg(F.max(F.struct("updated_at", "job_id", "status")).alias("x"))
    return best.select(key, "x.job_id", "x.status")


def next_attempts(jobs: DataFrame) -> DataFrame:
    """(job_id, next_attempt): one more than the highest attempt of a root job and its replays."""
    root = F.coalesce("replay_of", "job_id")
    return jobs.groupBy(root.alias("job_id")).agg((F.max("attempt") + 1).cast("bigint").alias("next_attempt"))


def replay_paths(results: DataFrame, failed_only: bool = True) -> DataFrame:
    """(job_id, path) to run again: all of a job, or those that failed or were set aside."""
    return results.where(F.col("status").isin("failed", "quarantined")).select("job_id", "path") if failed_only else results.select("job_id", "path")



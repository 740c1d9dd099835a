"""Views that bind the driver's tables to the engine's entities, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block for each line of each document; attributes follow from id and position."""
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "text")).selectExpr(
        "doc_id",
        "source",
        "CAST(pos AS BIGINT) AS block_seq",
        "CAST(1 + pos DIV 5 AS BIGINT) AS page",
        "CAST(pos % 5 AS BIGINT) AS order_in_page",
        "CASE doc_id % 4 WHEN 0 THEN 'contract' WHEN 1 THEN 'policy' WHEN 2 THEN 'research_paper' ELSE 'web_document' END AS doc_type",
        "CASE WHEN length(text) - length(replace(text, '|', '')) >= 2 THEN 'table' WHEN pos % 7 = 3 THEN 'heading' WHEN doc_id % 4 = 0 THEN 'clause' ELSE 'paragraph' END AS block_type",
        "text",
        "doc_id % 10 = 0 AS is_ocr",
        "CAST((doc_id * 7 + pos * 13) % 100 AS DOUBLE) / 100 AS confidence",
        "CASE WHEN pos % 7 = 3 THEN CAST(1 + (doc_id + pos) % 3 AS BIGINT) END AS heading_level",
        "concat('Section ', CAST(pos DIV 10 AS STRING)) AS section",
    )


BLOCKS = """blocks AS (SELECT doc_id, source, pos AS block_seq, 1 + pos // 5 AS page, pos % 5 AS order_in_page,
 CASE doc_id % 4 WHEN 0 THEN 'contract' WHEN 1 THEN 'policy' WHEN 2 THEN 'research_paper' ELSE 'web_document' END AS doc_type,
 CASE WHEN length(text) - length(replace(text, '|', '')) >= 2 THEN 'table' WHEN pos % 7 = 3 THEN 'heading' WHEN doc_id % 4 = 0 THEN 'clause' ELSE 'paragraph' END AS block_type,
 text, doc_id % 10 = 0 AS is_ocr, ((doc_id * 7 + pos * 13) % 100)::DOUBLE / 100 AS confidence,
 CASE WHEN pos % 7 = 3 THEN 1 + (doc_id + pos) % 3 END AS heading_level, 'Section ' || (pos // 10)::VARCHAR AS section
 FROM (SELECT doc_id, source, (p - 1)::BIGINT AS pos, l[p] AS text FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS t(p)))"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as a dense store, with a perturbed copy of every third one under the same document."""
    base = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("bigint").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    copies = base.where("chunk_id % 3 = 0").select((F.col("chunk_id") + 10_000_000).alias("chunk_id"), F.when(F.col("chunk_id") % 2 == 0, F.col("doc_id")).otherwise(F.col("doc_id") + 1).alias("doc_id"), F.transform("embedding", lambda x, i: x + F.when(i == 0, 0.01).otherwise(0.0)).alias("embedding"))
    return base.unionByName(copies)


VECTORS = """base AS (SELECT vec_id AS chunk_id, label::BIGINT AS doc_id, embedding::DOUBLE[] AS embedding FROM embeddings),
vectors AS (SELECT * FROM base UNION ALL SELECT chunk_id + 10000000, CASE WHEN chunk_id % 2 = 0 THEN doc_id ELSE doc_id + 1 END, list_transform(embedding, lambda x, i: x + CASE WHEN i = 1 THEN 0.01 ELSE 0.0 END)::DOUBLE[] FROM base WHERE chunk_id % 3 = 0)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk per document."""
    return table(spark, sf_dir, "documents").selectExpr("doc_id AS chunk_id", "doc_id", "coalesce(text, '') AS text", "lang", "source", "CAST(n_chars % 100 AS DOUBLE) / 100 AS quality", "1 + doc_id % 9 AS page_start")


CHUNKS = "chunks AS (SELECT doc_id AS chunk_id, doc_id, coalesce(text, '') AS text, lang, source, (n_chars % 100)::DOUBLE / 100 AS quality, 1 + doc_id % 9 AS page_start FROM documents)"
WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+')"


def words_sql(column: str) -> str:
    return WORDS.format(column)

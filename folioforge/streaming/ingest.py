"""File-stream ingestion: each micro-batch runs the batch pipeline and publishes its own part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import normalize


def line_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of documents (doc_id, text) as they come in."""
    b = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "text"))
    return b.selectExpr("doc_id", "CAST(pos AS BIGINT) AS block_seq", "CAST(1 + pos DIV 5 AS BIGINT) AS page", "'web_document' AS doc_type", "'paragraph' AS block_type", "text", "false AS is_ocr", "CAST(NULL AS DOUBLE) AS confidence", "CAST(NULL AS BIGINT) AS heading_level", "'Document' AS section")


def ingest_stream(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = "doc_id long, text string") -> StreamingQuery:
    """Normalizes every new Parquet file under ``source`` into ``target``; a batch that is run again overwrites its own folder."""
    docs = spark.readStream.schema(schema).parquet(source)

    def write(batch: DataFrame, epoch: int) -> None:
        normalize.normalize(line_blocks(batch)).write.mode("overwrite").parquet(f"{target}/batch={epoch}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Index store over versioned Parquet: upsert, replace, delete, list, restore, and payload projections.

A version is a folder of its own that is never written twice.  Which one counts is said by pointer
files, one for each publication, that are renamed into place: readers take the last whole one, so
they see a version or the one before it, never a part.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def dimensions(vectors: Column, expected: int) -> Column:
    """Reason why a vector can't be stored, or null."""
    return F.when(vectors.isNull() | (F.size(vectors) == 0), "missing_embedding").when(F.size(vectors) != expected, "dimension_mismatch")


def latest(rows: DataFrame, key: str = "chunk_id", order: str | None = None) -> DataFrame:
    """One row a key: the one of the greatest ``order``; with none, of the greatest hash of its content."""
    by = F.desc(order) if order else F.desc(F.xxhash64(*rows.columns))
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(by))).where("_nth = 1").drop("_nth")


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "chunk_id", order: str | None = None) -> DataFrame:
    """existing with incoming's rows in place of those of the same key; repeated keys of incoming count once."""
    return existing.join(incoming.select(key), key, "left_anti").select(*existing.columns).unionByName(latest(incoming, key, order).select(*existing.columns))


def by_document(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows of the given documents."""
    return rows.join(documents.select("doc_id").distinct(), "doc_id", "left_semi").select(*rows.columns)


def delete(rows: DataFrame, keys: DataFrame, key: str = "chunk_id") -> DataFrame:
    return rows.join(keys.select(key), key, "left_anti").select(*rows.columns)


def replace_documents(existing: DataFrame, incoming: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Every document of incoming has incoming's rows alone; rows of other documents with one of their keys go too."""
    kept = existing.join(incoming.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_anti")
    return upsert(kept.select(*existing.columns), incoming, key)


def replaced(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """(doc_id, before, after, stale) of each document of incoming: its rows now and then, and those that leave."""
    old = existing.select("doc_id", "chunk_id").distinct().withColumn("_old", F.lit(1))
    new = incoming.select("doc_id", "chunk_id").distinct().withColumn("_new", F.lit(1))
    both = old.join(new.select("doc_id").distinct(), "doc_id", "left_semi").join(new, ["doc_id", "chunk_id"], "full")
    n = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return both.groupBy("doc_id").agg(n("_old").alias("before"), n("_new").alias("after"), F.count_if(F.col("_new").isNull()).alias("stale"))


def dense_payload(chunks: DataFrame, metadata: list[str], stamp: Column | None = None) -> DataFrame:
    """chunk_id, text, the fields that filters use, the time and all metadata as one column."""
    fields = ["doc_id", "document_version", "doc_type", "section_path", "page_start", "chunk_type", "parser_used", "parse_confidence", "chunk_quality_score"]
    own = [F.col(c) if c in chunks.columns else F.lit(None).cast("string").alias(c) for c in ["chunk_id", "text", "embedding_text", *fields]]
    return chunks.select(*own, (F.current_timestamp() if stamp is None else stamp).alias("ingestion_timestamp"), F.to_json(F.struct(*metadata)).alias("metadata"))


def sparse_document(chunks: DataFrame, metadata: list[str]) -> DataFrame:
    own = [F.col(c) if c in chunks.columns else F.lit(None).cast("string").alias(c) for c in ("chunk_id", "text", "embedding_text")]
    return chunks.select(*own, F.to_json(F.struct(*metadata)).alias("metadata"))


def from_stored(rows: DataFrame, schema: str) -> DataFrame:
    """Chunks of payloads or documents: metadata read back; a null id is unknown_chunk, an empty embedding text null."""
    return rows.select(F.coalesce("chunk_id", F.lit("unknown_chunk")).alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text"), F.nullif("embedding_text", F.lit("")).alias("embedding_text"), F.from_json("metadata", schema).alias("m")).select("chunk_id", "text", "embedding_text", "m.*")


def _hadoop(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    at = path(folder)
    return path, at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _pointers(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    path, at, fs = _hadoop(spark, f"{folder}/pointers")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted((int(n.split("-", 1)[0]), n.split("-", 1)[1]) for n in names if n[:1].isdigit())


def publish(tables: dict[str, DataFrame], folder: str, version: str | None = None) -> str:
    """Writes the tables as a version of the store and, when all are written, makes it the one that counts.

    Every table is written once and counted from what was written.  A job lost on the way leaves an unnamed
    folder and the version before it in place; two publications at once leave one of them in place.
    """
    spark = next(iter(tables.values())).sparkSession
    version = version or uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{version}/{name}")
    point(spark, folder, version)
    return version


def point(spark: SparkSession, folder: str, version: str) -> None:
    """Makes a written version the one that counts, by one rename; so an earlier one is restored as well."""
    path, at, fs = _hadoop(spark, f"{folder}/pointers")
    fs.mkdirs(at)
    number = max((n for n, _ in _pointers(spark, folder)), default=0) + 1
    aside = path(f"{folder}/pointers/.{uuid.uuid4().hex}")
    fs.create(aside).close()
    if not fs.rename(aside, path(f"{folder}/pointers/{number:012d}-{version}")):
        raise RuntimeError(f"version {version} was not published")


def current(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the version that counts."""
    found = _pointers(spark, folder)
    if not found:
        raise FileNotFoundError(f"nothing is published in {folder}")
    return spark.read.parquet(f"{folder}/{found[-1][1]}/{name}")


def restore(spark: SparkSession, folder: str) -> str:
    """Makes the version before the one that counts count again."""
    found = _pointers(spark, folder)
    earlier = [v for _, v in found[:-1] if v != found[-1][1]]
    if not earlier:
        raise RuntimeError("there is no earlier version")
    point(spark, folder, earlier[-1])
    return earlier[-1]

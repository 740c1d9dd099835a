"""The corpus pipeline: stages over documents, each written as Parquet and read again.

1. toxicity: documents that the classifier scores 0.5 or more go; it is trained on the labelled rows
   that no one holds out.
2. line_dedup: equal lines, and near-duplicate ones of 40 bytes or more, go, but for the first of
   each class; a document that was nothing but such lines and blank ones goes with them.
3. near_dedup: of each group of near-duplicate documents the one with the least doc_id stays.
4. decontamination: documents in which windows of benchmark items occur go.
5. packing: what is left is packed into token sequences; the last stage returns the packing.

All stages but the last keep every column of documents, whatever its name, and keep repeated rows
apart from each other only where a stage names rows: rows that share an id are one document, all of which
stays or goes in near_dedup.  Null and empty texts are clean, have no lines to drop, are no duplicates
and hold no benchmark passage; rows without an id pass all stages by their text alone.  Empty tables give
empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import core, decontam, linededup, minhash, packing, toxicity


def _nested(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns as one, whose names can't clash with a stage's own."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest or [F.lit(None).cast("string").alias("none")]).alias("rest_"))


def _flat(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*(F.col(c) if c in ("doc_id", "text") else F.col("rest_").getField(c).alias(c) for c in columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts count as clean."""
    model = toxicity.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _flat(toxicity.scored(_nested(docs), model).where("score < 0.5"), docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars is that of the text that stays; null texts stay null."""
    gone = linededup.removals(core.keyed(docs)).select("k0", "k1", F.transform("gone", lambda g: g["line"]).alias("gone"))
    rows = linededup.without_lines(core.with_keys(_nested(docs)).join(gone, ["k0", "k1"], "left"))
    rows = rows.where(F.col("gone").isNull() | F.col("text").rlike(r"[^ \t-\r]"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        rows = rows.withColumn("rest_", F.when(F.col("gone").isNull(), F.col("rest_")).otherwise(F.col("rest_").withField("n_chars", F.length("text").cast(kind))))
    return _flat(rows, docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without an id, or without words, are never duplicates."""
    gone = minhash.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.flagged(_nested(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _flat(found.where("not contaminated"), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, str(public_tokenizers.path("byte_bpe_50k.json")), 2048)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_near_duplicates), ("decontamination", drop_contaminated), ("packing", pack)]

#: SQL can express neither the classifier nor the tokenizer; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what a stage wrote on its way is deleted once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = len(core.made())
    for _, stage in STAGES[:-1]:
        docs = core.materialise(stage(spark, docs, sf_dir))
        core.release(first, len(core.made()) - 1)
    return STAGES[-1][1](spark, docs, sf_dir)

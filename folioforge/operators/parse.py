"""Parser routing, attempts, provenance and terminal status."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A backend turns (path, content) into block texts, or raises; real converters are plugged in here.
Backend = Callable[[str, bytes], list[str]]

ORDERS = {
    "manual": ["manual_recovery"],
    "ocr": ["ocr_only", "docling", "pymupdf", "unstructured"],
    "mixed": ["docling", "ocr_only", "pymupdf", "unstructured"],
    "native": ["docling", "pymupdf", "unstructured", "ocr_only"],
    "plain": ["pymupdf", "unstructured"],
}


def route(files: DataFrame) -> DataFrame:
    """reason, parsers (in order) and requires_ocr from family, encrypted, pages, chars and image_pages."""
    per_page = F.col("chars") / F.greatest("pages", F.lit(1))
    scanned = (F.col("family") == "pdf") & (per_page < 50)
    images = (F.col("family") == "pdf") & (F.col("image_pages") / F.greatest("pages", F.lit(1)) >= 0.6) & (per_page < 200)
    reason = F.when(F.col("encrypted"), "encrypted_pdf").when(F.col("family") == "image", "image_document").when(scanned, "scanned_pdf").when(images, "image_heavy_pdf").when(F.col("family") == "pdf", "native_pdf").when(F.col("family").isin("email", "html", "office", "text", "xml"), F.col("family")).otherwise("unsupported_primary_type")
    kind = F.when(F.col("reason") == "encrypted_pdf", "manual").when(F.col("reason").isin("image_document", "scanned_pdf"), "ocr").when(F.col("reason") == "image_heavy_pdf", "mixed").when(F.col("reason") == "native_pdf", "native").otherwise("plain")
    f = files.withColumn("reason", reason).withColumn("_kind", kind)
    order = F.coalesce(*(F.when(F.col("_kind") == k, F.array(*(F.lit(x) for x in v))) for k, v in ORDERS.items()))
    return f.withColumn("parsers", order).withColumn("requires_ocr", F.col("_kind").isin("ocr", "mixed")).drop("_kind")


def error_reason(message: Column, kind: Column) -> Column:
    m = F.lower(message)
    has = lambda x: F.contains(m, F.lit(x))
    return F.when((kind == "ModuleNotFoundError") | has("not installed") | has("no module named"), "primary_dependency_missing").when(has("empty content") | has("no extractable text"), "primary_empty_output").when(kind == "TimeoutError", "primary_timeout").when(has("manual recovery") | has("encrypted"), "manual_recovery_required").otherwise("primary_parse_error")


def parse(files: DataFrame, backends: dict[str, Backend]) -> DataFrame:
    """(path, parser, step, ok, error, kind, texts) of every attempt, until one yields text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                for step, name in enumerate(r.parsers):
                    try:
                        texts = [t for t in backends[name](r.path, bytes(r.content)) if t and t.strip()]
                        if not texts:
                            raise ValueError("empty content")
                        out.append((r.path, name, step, True, None, None, texts))
                        break
                    except Exception as e:  # noqa: BLE001 - any failure of a backend is an attempt to record
                        out.append((r.path, name, step, False, str(e), type(e).__name__, None))
            yield pd.DataFrame(out, columns=["path", "parser", "step", "ok", "error", "kind", "texts"])

    return files.select("path", "content", "parsers").mapInPandas(run, "path string, parser string, step int, ok boolean, error string, kind string, texts array<string>")


def winners(attempts: DataFrame, key: str = "path") -> DataFrame:
    """Per file its first successful parser, the number of attempts and the first failure."""
    return attempts.groupBy(key).agg(F.min_by(F.when(F.col("ok"), F.col("parser")), F.when(F.col("ok"), F.col("step"))).alias("parser"), F.count("*").alias("attempts"), F.min_by(F.when(~F.col("ok"), F.col("error")), F.when(~F.col("ok"), F.col("step"))).alias("first_error"))


def confidence(requires_ocr: Column, has_table: Column, has_heading: Column, fallback: Column) -> Column:
    """0.3, more for native routes and structure, less for OCR and fallbacks; between 0 and 1."""
    s = F.lit(0.3) + F.when(requires_ocr, -0.3).otherwise(0.4) + F.when(has_table, 0.2).otherwise(0.0) + F.when(has_heading, 0.2).otherwise(0.0) - F.when(fallback, 0.2).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), s)), 6)


def bucket(c: Column) -> Column:
    return F.when(c >= 0.85, "high").when(c >= 0.6, "medium").otherwise("low")


def provenance(blocks: DataFrame, reports: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each document's report on all of its blocks."""
    return blocks.join(reports.withColumn("confidence_bucket", bucket(F.col("parse_confidence"))), key)


def status(is_valid: Column, parser: Column, manual: Column) -> Column:
    return F.when(~is_valid, "rejected").when(manual, "quarantined").when(parser.isNotNull(), "parsed").otherwise("failed")

"""File tables: scanning, type detection, validation, duplicates.

A file table has path, content (binary) and optionally ordinal.  ``scan`` builds one with the
``binaryFile`` source; everything else is columns over it.
"""

from __future__ import annotations

import io
import zipfile
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OOXML = "application/vnd.openxmlformats-officedocument."
MEDIA = {
    ".pdf": ("application/pdf",), ".html": ("text/html",), ".htm": ("text/html",), ".txt": ("text/plain",), ".md": ("text/plain",), ".xml": ("application/xml", "text/plain"),
    ".docx": (OOXML + "wordprocessingml.document",), ".xlsx": (OOXML + "spreadsheetml.sheet",), ".pptx": (OOXML + "presentationml.presentation",),
    ".png": ("image/png",), ".jpg": ("image/jpeg",), ".jpeg": ("image/jpeg",), ".tif": ("image/tiff",), ".tiff": ("image/tiff",), ".eml": ("message/rfc822", "text/plain"), ".msg": ("application/octet-stream",),
}
IMAGES, OFFICE, MAIL = (tuple(f".{x}" for x in kinds.split()) for kinds in ("jpg jpeg png tif tiff", "docx pptx xlsx", "eml msg"))
WINDOW = 4096
MESSAGES = {"empty_file": "No content.", "file_too_large": "Too large.", "unsupported_extension": "The extension is not supported.", "mime_mismatch": "Content and extension disagree.", "encrypted": "The file is encrypted.", "corrupted": "The file is damaged.", "duplicate": "The same content came before."}
BLOCKING = ("empty_file", "file_too_large", "unsupported_extension", "encrypted", "corrupted", "duplicate")


def scan(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, length, content) of a folder's files; the path is their order.  The source leaves out files without content."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return f.select("path", "length", "content")


def extension(path: Column) -> Column:
    """Lower-case suffix with its dot, or the empty string."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[A-Za-z0-9]+)$", 1))


def media_type(content: Column) -> Column:
    """By signature, then by markers in the first bytes; an OOXML container is plain zip here (see container_type)."""
    head = F.substring(content, 1, WINDOW)
    hexed = F.hex(F.substring(content, 1, 8))
    # bytes as Latin-1 text: markers are ASCII, and every byte is one character
    low = F.lower(F.decode(head, "ISO-8859-1"))
    has = lambda *m: reduce(lambda a, b: a | b, (F.contains(low, F.lit(x)) for x in m))
    text = (F.length(head) > 0) & ~F.contains(low, F.lit("\0")) & F.is_valid_utf8(head.cast("string"))
    return (
        F.when(F.startswith(hexed, F.lit("25504446")), "application/pdf")
        .when(F.startswith(hexed, F.lit("504B0304")), "application/zip")
        .when(hexed == "89504E470D0A1A0A", "image/png")
        .when(F.startswith(hexed, F.lit("FFD8FF")), "image/jpeg")
        .when(F.startswith(hexed, F.lit("49492A00")) | F.startswith(hexed, F.lit("4D4D002A")), "image/tiff")
        .when(has("<html", "<!doctype html", "<body", "<head"), "text/html")
        .when(has("<?xml"), "application/xml")
        .when(has("from:", "subject:", "mime-version:", "content-type:"), "message/rfc822")
        .when(text, "text/plain")
        .otherwise("application/octet-stream")
    )


@F.pandas_udf(T.StringType())
def container_type(content: pd.Series) -> pd.Series:
    """OOXML kind of a zip container by its members; "corrupted" if it can't be read."""

    def one(raw):
        try:
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                names = z.namelist()
                if z.testzip() is not None:
                    return "corrupted"
        except (zipfile.BadZipFile, OSError, EOFError):
            return "corrupted"
        if not set(names) & {"[Content_Types].xml"}:
            return "application/zip"
        for folder, kind in (("word/", "wordprocessingml.document"), ("xl/", "spreadsheetml.sheet"), ("ppt/", "presentationml.presentation")):
            if any(n.startswith(folder) for n in names):
                return OOXML + kind
        return "application/zip"

    return content.map(one, na_action="ignore")


def family(ext: Column, media: Column) -> Column:
    """Parser family of a file."""
    bare = F.nullif(F.regexp_replace(ext, r"^\.", ""), F.lit(""))
    return (
        F.when(media == "application/pdf", "pdf")
        .when(F.startswith(media, F.lit("image/")) | ext.isin(*IMAGES), "image")
        .when(F.startswith(media, F.lit(OOXML)) | ext.isin(*OFFICE), "office")
        .when(media == "text/html", "html")
        .when(media == "application/xml", "xml")
        .when((media == "message/rfc822") | ext.isin(*MAIL), "email")
        .when(F.startswith(media, F.lit("text/")), "text")
        .otherwise(F.coalesce(bare, F.lit("unknown")))
    )


def allowed(ext: Column) -> Column:
    return ext.isin(*MEDIA)


def consistent(ext: Column, media: Column) -> Column:
    return reduce(lambda a, b: a | b, ((ext == e) & media.isin(*m) for e, m in MEDIA.items()))


def duplicates(files: DataFrame, order: str = "ordinal") -> DataFrame:
    """``duplicate``: an earlier file of the batch has the same bytes; by a minimum per digest, not a sort of copies."""
    f = files.withColumn("sha", F.sha2("content", 256)) if "sha" not in files.columns else files
    first = f.groupBy("sha").agg(F.min(order).alias("_first"))
    return f.join(first, "sha").withColumn("duplicate", F.col(order) > F.col("_first")).drop("_first")


def validated(files: DataFrame, order: str = "ordinal", least: int = 1, most: int = 1_000_000_000) -> DataFrame:
    """Issues of each file, the first blocking one as failure_reason, and is_valid."""
    f = duplicates(files.withColumns({"ext": extension(F.col("path")), "media": media_type(F.col("content"))}), order)
    n = F.length("content")
    pdf = F.col("media") == "application/pdf"
    locked = pdf & F.contains(F.decode(F.substring("content", 1, WINDOW), "ISO-8859-1"), F.lit("/Encrypt"))
    broken = (F.col("ext") == ".pdf") & ~pdf
    rules = [("empty_file", n < least), ("file_too_large", n > most), ("unsupported_extension", ~allowed(F.col("ext"))), ("mime_mismatch", ~consistent(F.col("ext"), F.col("media"))), ("corrupted", broken), ("encrypted", locked), ("duplicate", F.col("duplicate"))]
    issues = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in rules)), lambda x: x.isNotNull())
    f = f.withColumn("issues", issues)
    stops = F.filter("issues", lambda x: x.isin(*BLOCKING))
    return f.withColumns({"failure_reason": F.try_element_at(stops, F.lit(1)), "is_valid": F.size(stops) == 0})


def load_reason(message: Column, kind: Column) -> Column:
    """Reason code of a failed load by its message."""
    m = F.lower(message)
    rules = {"symlinked": "symlink_not_allowed", "outside the configured roots": "outside_allowed_roots", "does not exist": "file_not_found", "not a file": "not_a_file"}
    return F.coalesce(*(F.when(F.contains(m, F.lit(k)), v) for k, v in rules.items()), kind)

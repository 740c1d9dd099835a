"""Block normalization: artifact lines, headings, section paths, code, tables, OCR, text, metadata.

Each function adds or replaces columns of a block table; blocks of a document are ordered by
``block_seq``.  Everything is a Catalyst expression but the Unicode form of normalize_text.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

PROTECTED = ("table", "code", "code_block")
LEGAL = ("contract", "legislation", "policy", "regulation")
ARTIFACT = r"(?i)^(page\s+[0-9]+(\s+of\s+[0-9]+)?|(generated by|exported by|printed from)\b.*)$"
BANNER = r"(?i)^(confidential|private and confidential|internal use only)$"
NOISE = r"^[^\p{L}\p{N}]{6,}$"


def clean_artifacts(blocks: DataFrame, text: str = "text") -> DataFrame:
    """Drops lines that are page numbers, export notes, scanner noise or banners; banners stay in legal documents."""
    legal = F.col("doc_type").isin(*LEGAL)
    lines = F.transform(F.split(text, r"\R"), lambda x: F.trim(x))
    keep = F.filter(lines, lambda x: (x != "") & ~x.rlike(ARTIFACT) & ~x.rlike(NOISE) & (legal | ~x.rlike(BANNER)))
    cleaned = F.when(F.col("block_type").isin(*PROTECTED) | (F.trim(F.col(text)) == ""), F.col(text)).otherwise(F.array_join(keep, "\n"))
    removed = F.when(F.col("block_type").isin(*PROTECTED) | (F.trim(F.col(text)) == ""), F.lit(0)).otherwise(F.size(lines) - F.size(keep))
    return blocks.withColumn("removed_lines", removed.cast("bigint")).withColumn(text, cleaned)


def normalize_headings(blocks: DataFrame, max_words: int = 18, sentence_chars: int = 140) -> DataFrame:
    """Candidates (type heading or section, or a level) become headings, or paragraphs where they read like one."""
    compact = F.trim(F.regexp_replace("text", r"\s+", " "))
    title = F.when(compact == "", F.lit("Document")).otherwise(compact)
    candidate = F.col("block_type").isin("heading", "section") | F.col("heading_level").isNotNull()
    demote = F.col("heading_level").isNull() & ((F.size(X.nonspace(title)) > max_words) | ((F.length(title) > sentence_chars) & title.rlike(r"[.!?]$")))
    return blocks.withColumns(
        {
            "heading_demoted": candidate & demote,
            "block_type": F.when(candidate & demote, "paragraph").when(candidate, "heading").otherwise(F.col("block_type")),
            "section": F.when(candidate & ~demote, title).otherwise(F.col("section")),
            "heading_level": F.when(candidate & ~demote, F.coalesce("heading_level", F.lit(1))).otherwise(F.col("heading_level")).cast("bigint"),
            "text": F.when(candidate, title).otherwise(F.col("text")),
        }
    )


def section_paths(blocks: DataFrame, default: str = "Document") -> DataFrame:
    """The section lineage of every block, as a stack of open headings holds it.

    A heading closes all open ones of its level or a greater one; levels may be any number, null
    counts as 1, titles are whole (``section``, else the text, else ``default``).  Adds ``path`` (titles joined by
    " > ", "" before the first heading), ``depth``, ``parents`` (of a heading the titles above it, of
    other blocks all open ones), ``section_path`` (the open titles, else the block's own section)
    and sets ``section`` where it is blank.

    The stacks of a document are built once, from its headings alone; each block looks up the one of
    the headings before it.
    """
    heading = F.col("block_type") == "heading"
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    title = F.trim(F.when(~blank(F.col("section")), F.col("section")).when(~blank(F.col("text")), F.col("text")).otherwise(F.lit(default)))
    entry = F.struct(F.coalesce(F.col("heading_level").cast("long"), F.lit(1).cast("long")).alias("level"), title.alias("title"))
    none = F.array().cast("array<struct<level:bigint,title:string>>")

    def push(done, x):
        open_ = F.coalesce(F.try_element_at(done, F.lit(-1)), none)
        return F.concat(done, F.array(F.concat(F.filter(open_, lambda y: y["level"] < x["h"]["level"]), F.array(x["h"]))))

    own = blocks.where(heading).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_seq", entry.alias("h")))).alias("_h"))
    own = own.select(F.col("doc_id").alias("_doc"), F.aggregate("_h", F.array().cast("array<array<struct<level:bigint,title:string>>>"), push).alias("_stacks"))
    at = Window.partitionBy("doc_id").orderBy("block_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = blocks.withColumn("_n", F.count_if(heading).over(at).cast("int")).join(own, F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
    open_ = F.transform(F.coalesce(F.get("_stacks", F.col("_n") - 1), none), lambda x: x["title"])
    b = seen.withColumn("_open", open_).drop("_stacks", "_doc", "_n")
    section = F.when(heading, F.try_element_at("_open", F.lit(-1))).when(~blank(F.col("section")), F.trim("section")).otherwise(F.coalesce(F.try_element_at("_open", F.lit(-1)), F.lit(default)))
    b = b.withColumn("section", section)
    return b.withColumns({
        "path": F.array_join("_open", " > "),
        "depth": F.size("_open").cast("bigint"),
        "parents": F.when(heading, F.slice("_open", 1, F.greatest(F.size("_open") - 1, F.lit(0)))).otherwise(F.col("_open")),
        "section_path": F.when(F.size("_open") > 0, F.col("_open")).otherwise(F.array("section")),
    }).drop("_open")


def normalize_code(blocks: DataFrame) -> DataFrame:
    """Code blocks: line feeds unified, trailing blanks cut, language of the fence, type code_block."""
    code = F.col("block_type").isin("code", "code_block")
    unix = F.regexp_replace(F.regexp_replace("text", "\r\n?", "\n"), r"(?m)[ \t]+$", "")
    return blocks.withColumns({"code_language": F.when(code, F.nullif(F.lower(F.regexp_extract("text", r"^\s*```([A-Za-z0-9_+-]+)", 1)), F.lit(""))), "text": F.when(code, F.regexp_replace(unix, "^\n+|\n+$", "")).otherwise(F.col("text")), "block_type": F.when(code, "code_block").otherwise(F.col("block_type"))})


def table_rows(text: Column) -> Column:
    """Cells of each non-blank line: by bars (outer ones cut), else by tabs, else one."""
    lines = F.filter(F.transform(F.split(text, r"\R"), lambda x: F.trim(x)), lambda x: x != "")
    cell = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.transform(lines, lambda x: F.transform(F.when(F.contains(x, F.lit("|")), F.split(F.regexp_replace(x, r"^\|+|\|+$", ""), r"\|")).otherwise(F.split(x, "\t")), cell))


def normalize_tables(blocks: DataFrame) -> DataFrame:
    """Tables as padded markdown with a divider after the first of several rows, and their shape."""
    rows = table_rows(F.col("text"))
    table = F.col("block_type") == "table"
    b = blocks.withColumn("_rows", F.when(table, rows))
    width = F.array_max(F.transform("_rows", F.size))
    padded = F.transform("_rows", lambda r: F.concat(r, F.array_repeat(F.lit(""), F.col("_width") - F.size(r))))
    b = b.withColumn("_width", width).withColumn("_padded", padded)
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    drawn = F.transform("_padded", line)
    divider = line(F.array_repeat(F.lit("---"), F.col("_width")))
    full = F.when(F.size("_rows") == 1, drawn[0]).otherwise(F.array_join(F.concat(F.slice(drawn, 1, 1), F.array(divider), F.slice(drawn, 2, F.greatest(F.size("_rows") - 1, F.lit(1)))), "\n"))
    return b.withColumns({"table_rows": F.size("_rows").cast("bigint"), "table_columns": F.col("_width").cast("bigint"), "ragged": F.exists("_rows", lambda r: F.size(r) != F.col("_width")), "text": F.when(table & (F.size("_rows") > 0), full).otherwise(F.col("text"))}).drop("_rows", "_width", "_padded")


def ocr_policy(blocks: DataFrame, reject: float = 0.2, abstain: float = 0.5, medium: float = 0.75) -> DataFrame:
    """Bucket and action of OCR blocks by confidence; text without broken lines; rejected ones are marked."""
    c = F.when(F.col("is_ocr"), F.col("confidence"))
    joined = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2"), r"([^\n])\n([^\n])", "$1 $2"), "[ \t]{2,}", " ")
    return blocks.withColumns(
        {
            "ocr_bucket": F.when(~F.col("is_ocr"), None).when(c.isNull(), "unknown").when(c < abstain, "low").when(c < medium, "medium").otherwise("high"),
            "ocr_action": F.when(~F.col("is_ocr"), None).when(c.isNull(), "unknown").when(c < reject, "reject").when(c < abstain, "abstain").otherwise("pass"),
            "text": F.when(F.col("is_ocr"), F.trim(joined)).otherwise(F.col("text")),
            "ocr_dropped": F.coalesce(c < reject, F.lit(False)),
        }
    )


SPACED = re.compile(r"\b(?:\w ){2,}\w\b")


@F.pandas_udf(T.StringType())
def readable(text: pd.Series, spaced: pd.Series, protected: pd.Series) -> pd.Series:
    """Where spaced, letters spelled apart ("w o r d") are written together; NFKC where not protected.  One worker a task for both."""

    def one(t, apart, keep):
        if t is None:
            return None
        t = SPACED.sub(lambda m: m.group(0).replace(" ", ""), t) if apart else t
        return t if keep else unicodedata.normalize("NFKC", t)

    return pd.Series([one(*x) for x in zip(text, spaced, protected)], index=text.index, dtype=object)


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def normalize_text(blocks: DataFrame, compatibility: bool = True) -> DataFrame:
    """NFKC, no control characters, single blanks, no blank lines; protected types stay.  ``dropped`` marks what is left empty."""
    t = nfkc(F.col("text")) if compatibility else F.col("text")
    t = F.regexp_replace(t, "[\\x00-\\x08\\x0B-\\x1F\\u200B]", "")
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \t]{2,}", " "))), lambda x: x != "")
    clean = F.when(F.col("block_type").isin(*PROTECTED), F.col("text")).otherwise(F.array_join(lines, "\n"))
    b = blocks.withColumn("text", clean)
    return b.withColumn("dropped", (F.col("block_type") != "heading") & ((F.length(F.trim("text")) < 3) | F.trim("text").isin("-", "--", "---")))


def enrich_metadata(blocks: DataFrame) -> DataFrame:
    """Running index over the blocks that are left, and the section's anchor."""
    w = Window.partitionBy("doc_id").orderBy("block_seq")
    return blocks.withColumns({"block_index": (F.row_number().over(w) - 1).cast("bigint"), "anchor": X.slug(F.col("section")), "protected": F.col("block_type").isin(*PROTECTED)})


def normalize(blocks: DataFrame) -> DataFrame:
    """The whole chain in its order; blocks that a stage drops are gone for the next."""
    b = clean_artifacts(blocks)
    b = normalize_headings(b)
    b = section_paths(b)
    b = normalize_tables(normalize_code(b))
    low = F.col("is_ocr") & (F.col("confidence") < 0.5)
    b = ocr_policy(b).where(~F.col("ocr_dropped"))
    # as not deterministic, or the filters on its result would run it once more
    b = b.withColumn("text", readable.asNondeterministic()(F.col("text"), F.coalesce(low, F.lit(False)), F.col("block_type").isin(*PROTECTED)))
    b = normalize_text(b, compatibility=False).where(~F.col("dropped"))
    return enrich_metadata(b.where(F.trim("text") != ""))

"""Text sources: HTML text, form-feed pages, OCR lines, block construction, XML feeds, QA sets."""

from __future__ import annotations

from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []

    def handle_data(self, data):
        if data.strip():
            self.parts.append(data.strip())


@F.pandas_udf(T.StringType())
def html_text(page: pd.Series) -> pd.Series:
    """All data nodes, trimmed and joined by a blank; scripts and styles are data here as well."""

    def one(h):
        p = _Text()
        p.feed(h)
        p.close()
        return " ".join(p.parts)

    return page.map(one, na_action="ignore")


def form_feed_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A block for each non-empty part between form feeds; page numbers count all parts."""
    p = docs.select(key, F.posexplode(F.split(text, "\f")).alias("pos", "text"))
    return p.select(key, (F.col("pos") + 1).cast("bigint").alias("page"), F.trim("text").alias("text")).where("text <> ''")


def block_id(stem: Column, page: Column, order: Column, text: Column) -> Column:
    """Deterministic id from place and the text's head."""
    return F.concat(stem, F.lit("_p"), page.cast("string"), F.lit("_b"), order.cast("string"), F.lit("_"), F.substring(F.sha1(F.substring(text, 1, 500)), 1, 12))


def ocr_lines(rows: DataFrame) -> DataFrame:
    """Words (page, block, par, line, seq, text, conf) to lines: text in order of seq, mean confidence."""
    w = rows.where((F.trim("text") != "") & (F.col("conf") >= 0))
    g = w.groupBy("page", "block", "par", "line").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("w"), F.avg(F.least(F.col("conf") / 100, F.lit(1.0))).alias("confidence"))
    return g.select("page", "block", "par", "line", F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("text"), "confidence")


def doc_type(path: Column) -> Column:
    """Kind of a document by words of its path."""
    p = F.lower(path)
    has = lambda *m: reduce(lambda a, b: a | b, (F.contains(p, F.lit(x)) for x in m))
    return F.when(has("10-k", "/sec/", "sec_"), "sec_filing").when(has("court", "opinion"), "court_opinion").when(has("eur-lex", "ai_act"), "regulation").when(has("arxiv"), "research_paper").when(p.rlike(r"\.html?$"), "web_document").when(p.rlike(r"\.pdf$"), "pdf_document").otherwise("unknown")


def enriched(rows: DataFrame) -> DataFrame:
    """Defaults of page, section and order; 0 and generic sections count as missing."""
    s = F.trim("section")
    return rows.withColumns({"page": F.coalesce(F.nullif("page", F.lit(0)), F.greatest("index", F.lit(1))).cast("bigint"), "section": F.when(s.isNull() | F.lower(s).isin("", "html", "page", "unknown"), "Document").otherwise(s), "order_in_page": F.coalesce(F.nullif("order_in_page", F.lit(0)), F.lit(1)).cast("bigint")})


QA = T.StructType([T.StructField("question_id", T.StringType()), T.StructField("question", T.StringType()), T.StructField("gold_answer", T.StringType()), T.StructField("gold_chunk_ids", T.ArrayType(T.StringType())), T.StructField("gold_doc_ids", T.ArrayType(T.StringType())), T.StructField("difficulty", T.StringType()), T.StructField("notes", T.StringType())])


def read_qa(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of questions; an incomplete one is an error of the file."""
    return spark.read.schema(QA).option("mode", "FAILFAST").json(path, multiLine=True)


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; blank ones are skipped."""
    return spark.read.schema(schema).json(path)


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, summary, authors, published, pdf) of an Atom feed, by the built-in XML source."""
    person = T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))
    link = T.ArrayType(T.StructType([T.StructField("_href", T.StringType()), T.StructField("_title", T.StringType())]))
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("summary", T.StringType()), T.StructField("published", T.StringType()), T.StructField("author", person), T.StructField("link", link)])
    f = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    clean = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return f.select(F.regexp_extract("id", r"([^/]+)$", 1).alias("id"), clean("title").alias("title"), clean("summary").alias("summary"), F.transform("author", lambda a: a["name"]).alias("authors"), "published", F.try_element_at(F.transform(F.filter("link", lambda x: x["_title"] == "pdf"), lambda x: x["_href"]), F.lit(1)).alias("pdf")).dropDuplicates(["id"])

"""Citations and context windows."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

NUMBER = "[0-9]+"
REFERENCE = rf"(?i)\[(?:SOURCE\s+)?({NUMBER}(?:\s*,\s*{NUMBER})*)\]"


def numbered(hits: DataFrame, start: int = 1) -> DataFrame:
    """Citation ids in rank order."""
    w = Window.partitionBy("query_id").orderBy("rank")
    return hits.withColumn("citation_id", (F.row_number().over(w) + start - 1).cast("bigint"))


def resolve(hits: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Citations with title, version and page; the title falls back to the source's name, then to the ids."""
    h = numbered(hits).join(catalogue.select("doc_id", F.col("title").alias("_title"), F.col("version").alias("_version")), "doc_id", "left")
    stem = F.nullif(F.regexp_extract("source_path", r"([^/]+?)(\.[^./]*)?$", 1), F.lit(""))
    known = F.col("_title").isNotNull()
    said = lambda c: (F.coalesce(F.col(c).cast("string"), F.lit("")) != "") if c in hits.columns else F.lit(False)
    signals = [(F.col("page_start") >= 1, 0.15), (known | stem.isNotNull(), 0.15), (said("section_path") | said("section_title"), 0.15), (said("heading_anchor"), 0.10), (said("source_block_ids"), 0.10), (F.col("_version").isNotNull() | known, 0.05)]
    confidence = sum((F.when(c, w).otherwise(0.0) for c, w in signals), F.lit(0.30))
    return h.select("query_id", "chunk_id", "citation_id", F.coalesce("_title", stem, F.col("doc_id").cast("string")).alias("title"), F.col("_version").alias("version"), F.col("page_start").alias("page"), (~known).alias("unresolved"), F.round(F.least(confidence, F.lit(1.0)), 6).alias("confidence"))


def unresolved(hits: DataFrame, catalogue: DataFrame) -> DataFrame:
    return hits.where(F.col("doc_id").isNotNull()).select("doc_id").distinct().join(catalogue, "doc_id", "left_anti")


def references(answer: Column) -> Column:
    """Cited ids in reading order; a group such as [1, 2] gives each."""
    groups = F.regexp_extract_all(answer, F.lit(REFERENCE), F.lit(1))
    return F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, ","))), lambda x: F.trim(x).cast("bigint"))


def _places(text: Column, pattern: str) -> Column:
    """(m, start, end) of all matches in order, in characters, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<m:string,start:int,end:int>>")

    def step(done, m):
        behind = F.coalesce(F.try_element_at(done, F.lit(-1))["end"], F.lit(0))
        start = behind + F.call_function("instr", F.substr(text, behind + 1), m) - 1
        return F.concat(done, F.array(F.struct(m.alias("m"), start.cast("int").alias("start"), (start + F.length(m)).cast("int").alias("end"))))

    return F.aggregate(found, none, step)


def reference_places(answers: DataFrame) -> DataFrame:
    """A row for every cited id: the columns beside answer, id, and start and end of the bracket that names it."""
    keys = [c for c in answers.columns if c != "answer"]
    rows = answers.select(*keys, F.explode(_places(F.col("answer"), REFERENCE)).alias("p"))
    return rows.select(*keys, F.explode(F.split(F.regexp_replace("p.m", r"(?i)^\[(?:SOURCE\s+)?|\]$", ""), ",")).alias("id"), F.col("p.start").cast("bigint").alias("start"), F.col("p.end").cast("bigint").alias("end")).withColumn("id", F.trim("id").cast("bigint"))


def validate(answers: DataFrame, resolved: Column) -> DataFrame:
    """Orphans (cited, not resolved) and uncited ids, ascending; valid without orphans."""
    cited = F.array_distinct(references(F.col("answer")))
    orphans = F.array_sort(F.array_except(cited, resolved))
    return answers.withColumns({"orphans": F.array_join(orphans, ","), "uncited": F.array_join(F.array_sort(F.array_except(resolved, cited)), ","), "valid": F.size(orphans) == 0})


def ordered(sources: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id", "page_start", "chunk_id")
    return sources.withColumn("position", F.row_number().over(w).cast("bigint"))


def _distinct_in_order(pattern: str) -> Column:
    """Distinct matches over a query's sources, in order of position and place."""
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    return F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("position", found.alias("m")))), lambda x: x["m"])))


def conflicts(sources: DataFrame, least: int = 2, sample: int = 3) -> DataFrame:
    """Per query the differing years, amounts and percentages; null where there is no conflict.  A query's sources are at most its top k."""
    patterns = {"dates": r"\b(?:19|20)[0-9]{2}\b", "amounts": r"\$\s?[0-9][0-9,]*(?:\.[0-9]+)?", "percentages": r"\b[0-9]+(?:\.[0-9]+)?%"}
    g = sources.groupBy("query_id").agg(*(_distinct_in_order(p).alias(n) for n, p in patterns.items()))
    return g.select("query_id", *(F.when(F.size(n) >= least, F.array_join(F.slice(n, 1, sample), ", ")).alias(n) for n in patterns))


def formatted(sources: DataFrame) -> DataFrame:
    """The prompt's context of each query, with totals."""
    head = F.concat(F.lit("[SOURCE "), F.col("position").cast("string"), F.lit(" | doc: "), F.col("source"), F.lit(" | page "), F.col("page_start").cast("string"), F.lit(" | section: Unknown section]\n"), F.col("text"))
    g = sources.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", head.alias("t")))).alias("b"), F.sum(F.size(X.nonspace(F.col("text")))).alias("tokens"), F.count("*").alias("sources"), F.countDistinct("doc_id").alias("documents"), F.round(F.avg("quality"), 6).alias("quality"))
    return g.select("query_id", F.array_join(F.transform("b", lambda x: x["t"]), "\n\n").alias("context"), "tokens", "sources", "documents", "quality")


def block_overlap(sources: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(query_id, a, b, overlap): pairs of a query's sources (with an array ``blocks``) whose smaller block set mostly lies in the other.

    Sources meet on a shared block of the same query; a query has at most its top k.
    """
    s = sources.select("query_id", "chunk_id", F.array_distinct("blocks").alias("_b"))
    e = s.select("query_id", "chunk_id", F.size("_b").alias("_n"), F.explode("_b").alias("_x"))
    o = e.select("query_id", "_x", F.col("chunk_id").alias("b"), F.col("_n").alias("_m"))
    p = e.join(o, ["query_id", "_x"]).where(F.col("chunk_id") < F.col("b")).groupBy("query_id", F.col("chunk_id").alias("a"), "b").agg(F.count("*").alias("_c"), F.first(F.least("_n", "_m")).alias("_s"))
    return p.select("query_id", "a", "b", F.round(F.col("_c") / F.col("_s"), 6).alias("overlap")).where(F.col("overlap") >= threshold)


def auditability(chunks: DataFrame, spans: str = "spans") -> DataFrame:
    """Share of chunks with source spans, and how many have none."""
    has = F.coalesce(F.size(spans) > 0, F.lit(False))
    return chunks.agg(F.round(F.coalesce(F.avg(has.cast("int")), F.lit(0.0)), 6).alias("score"), F.count_if(~has).alias("without"))


def deduplicated(sources: DataFrame, similarity: float = 0.98) -> DataFrame:
    """Per query, in rank order, sources that don't repeat a kept one.  The group is a query's hits: at most its top k."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[int] = []
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        for i, r in pdf.iterrows():
            same = False
            for j in kept:
                o = pdf.loc[j]
                m = SequenceMatcher(None, o["text"], r["text"], autojunk=False) if o["chunk_id"] != r["chunk_id"] else None
                if m is None or (m.real_quick_ratio() >= similarity and m.quick_ratio() >= similarity and m.ratio() >= similarity):
                    same = True
                    break
            if not same:
                kept.append(i)
        return pdf.loc[kept]

    return sources.groupBy("query_id").applyInPandas(run, sources.schema)


def compressed(sources: DataFrame, questions: DataFrame, limit: int = 3000) -> DataFrame:
    """While a query's sources exceed the token limit, the weakest one that isn't a query word's only support goes."""
    rows = sources.join(questions.select("query_id", X.word_set(F.col("question")).alias("_terms")), "query_id").withColumns({"_words": X.word_set(F.col("text")), "_tokens": F.size(X.nonspace(F.col("text")))})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rest = list(pdf.index)
        terms = set(pdf["_terms"].iloc[0])
        own = {i: terms & set(pdf.at[i, "_words"]) for i in rest}
        while sum(pdf.loc[rest, "_tokens"]) > limit and len(rest) > 1:
            free = [i for i in rest if all(any(t in own[j] for j in rest if j != i) for t in own[i])]
            if not free:
                break
            rest.remove(min(free, key=lambda i: (pdf.at[i, "quality"], pdf.at[i, "score"], -pdf.at[i, "position"])))
        return pdf.loc[rest]

    return rows.groupBy("query_id").applyInPandas(run, rows.schema).drop("_terms", "_words", "_tokens")

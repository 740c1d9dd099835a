"""Token windows, chunk planning, fixed and semantic chunking, chunk scores."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.stream import by_key, slices


@dataclass(frozen=True)
class Limits:
    least: int = 64
    target: int = 512
    most: int = 1024
    overlap: int = 96
    similarity: float = 0.72


SEPARATORS = ("\n\n", "\n", *(f"{mark} " for mark in ".?!;,"), " ")
VISUAL = ("image", "image_caption", "caption", "table_caption")
STANDALONE = ("standalone", "table_aware")


def window_starts(n: Column, size: int, overlap: int) -> Column:
    """Starts of the windows over n tokens; the last one reaches the end."""
    stride = max(size - overlap, 1)
    last = F.ceil(F.greatest(n - size, F.lit(0)) / stride).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: i * stride)).otherwise(F.array().cast("array<int>"))


def token_windows(rows: DataFrame, key: str, size: int = 512, overlap: int = 64, text: str = "text") -> DataFrame:
    """(key, window, start, tokens, text) of each row's token windows."""
    t = rows.select(key, X.nonspace(F.col(text)).alias("_t"))
    w = t.select(key, "_t", F.posexplode(window_starts(F.size("_t"), size, overlap)).alias("window", "start"))
    part = F.slice("_t", F.col("start") + 1, F.lit(size))
    return w.select(key, F.col("window").cast("bigint").alias("window"), F.col("start").cast("bigint").alias("start"), F.size(part).cast("bigint").alias("tokens"), F.array_join(part, " ").alias("text"))


def fixed_chunks(blocks: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """Windows over all tokens of a document, across its blocks, with the blocks each one touches.

    A running sum places each block in the token stream; a block meets only the windows it
    overlaps, so tokens are never exploded one by one.
    """
    w = Window.partitionBy("doc_id").orderBy("block_seq")
    b = blocks.select("doc_id", "block_seq", "page", X.nonspace(F.col("text")).alias("_t")).where(F.size("_t") > 0)
    b = b.withColumn("_end", F.sum(F.size("_t")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_start", F.col("_end") - F.size("_t"))
    total = b.groupBy("doc_id").agg(F.max("_end").alias("_n"))
    stride = max(size - overlap, 1)
    b = b.join(total, "doc_id").withColumn("_last", F.ceil(F.greatest(F.col("_n") - size, F.lit(0)) / stride))
    low = F.greatest(F.lit(0), F.floor((F.col("_start") - size) / stride) + 1)
    high = F.least(F.col("_last"), F.floor((F.col("_end") - 1) / stride))
    hit = b.where(low <= high).withColumn("window", F.explode(F.sequence(low, high)))
    at = F.col("window") * stride
    a = F.greatest(at - F.col("_start"), F.lit(0))
    z = F.least(at + size, F.col("_end")) - F.col("_start")
    own = hit.withColumn("_part", F.array_join(F.slice("_t", (a + 1).cast("int"), (z - a).cast("int")), " ")).withColumn("_k", z - a).where("_k > 0")
    g = own.groupBy("doc_id", "window").agg(F.array_sort(F.collect_list(F.struct("block_seq", "_part"))).alias("_p"), F.sum("_k").alias("tokens"), F.min("page").alias("page_start"), F.max("page").alias("page_end"))
    return g.select("doc_id", "window", "tokens", "page_start", "page_end", F.array_join(F.transform("_p", lambda x: x["block_seq"].cast("string")), ",").alias("blocks"), F.array_join(F.transform("_p", lambda x: x["_part"]), " ").alias("text"))


def plan(blocks: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """strategy, tokens, standalone and boundary of each non-blank block."""
    b = blocks.where(F.trim("text") != "").withColumn("tokens", F.size(X.nonspace(F.col("text"))).cast("bigint"))
    kind = F.col("block_type")
    strategy = F.when(kind.isin("heading", "list"), "heading_anchored").when(kind == "table", "table_aware").when(kind.isin("code", "code_block", "definition", *VISUAL), "standalone").when(F.col("tokens") > limits.most, "recursive_window").otherwise("semantic_merge")
    c = F.when(F.coalesce("confidence", F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("confidence"))
    b = b.withColumn("strategy", strategy)
    return b.withColumns({"standalone": F.col("strategy").isin(*STANDALONE), "boundary": (F.col("strategy") == "heading_anchored") | F.col("heading_level").isNotNull() | (F.col("is_ocr") & (c < 0.5))})


def split_recursively(text: str, limits: Limits = Limits()) -> list[str]:
    """Splits at ever finer separators until the pieces fit, then merges small ones up to the target."""
    count = lambda t: len(t.split())

    def pieces(t: str, separators: tuple[str, ...]) -> list[str]:
        if count(t) <= limits.most:
            return [t.strip()]
        if not separators:
            tokens, stride, out = t.split(), max(limits.target - limits.overlap, 1), []
            for i in range(0, len(tokens), stride):
                out.append(" ".join(tokens[i : i + limits.target]))
                if i + limits.target >= len(tokens):
                    break
            return out
        sep, rest = separators[0], separators[1:]
        raw = t.split(sep)
        parts = [x for x in ((p + (sep if i < len(raw) - 1 else "")).strip() for i, p in enumerate(raw)) if x]
        return [y for x in parts for y in pieces(x, rest)] if len(parts) > 1 else pieces(t, rest)

    merged: list[str] = []
    held, size = [], 0
    for p in pieces(text.strip(), SEPARATORS) if text.strip() else []:
        n = count(p)
        if held and not (size + n <= limits.target or (size < limits.least and size + n <= limits.most)):
            merged.append("\n\n".join(held))
            held, size = [], 0
        held.append(p)
        size += n
    return [*merged, "\n\n".join(held)] if held else merged


def recursive_split(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, part, text) of each row's pieces; a task holds those of a few texts at once."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            parts = [(i, k, p) for i, t in enumerate(b.column(1).to_pylist()) for k, p in enumerate(split_recursively(t or ""))]
            if parts:
                at, part, made = zip(*parts)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(part, pa.int32()), pa.array(made, pa.string())], [key, "part", "text"])

    return rows.select(key, text).mapInArrow(run, f"{key} {kind}, part int, text string")


def multiset_jaccard(x: Counter, y: Counter) -> float:
    low = common(x, y)
    union = x.total() + y.total() - low
    return low / union if union else 1.0


def common(x: Counter, y: Counter) -> int:
    """Size of the intersection of two multisets."""
    if len(x) > len(y):
        x, y = y, x
    return sum(min(n, y[t]) for t, n in x.items() if t in y)


def semantic_chunks(blocks: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Chunks of a running buffer over a document's blocks; headings and lists flush it and become the anchor.

    The state runs through a document, so a document's blocks come in order to one task.
    """

    def label(v: str | None) -> str | None:
        return v.strip() if v and v.strip().lower() not in ("text", "table", "paragraph", "footnote", "caption", "") else None

    def human(v: str) -> str:
        return " ".join(re.sub(r"(?<=[0-9])-(?=[0-9])", ".", v.replace("_", " ")).replace("-", " ").split())

    def bag(r) -> Counter:
        return Counter(r.text.lower().split())

    def run(blocks: list) -> list[tuple]:
        out, held, anchor, size, last = [], [], None, 0, None

        def add(parts, rows, strategy, tokens, at):
            head = label(rows[0].section) or (human(at) if at else None)
            parts = [p.strip() for p in parts if p.strip()]
            if head and parts and parts[0] != head:
                parts.insert(0, head)
            kinds = {r.block_type for r in rows}
            kind = "table" if "table" in kinds else "code" if kinds & {"code", "code_block"} else "list" if "list" in kinds else "paragraph"
            out.append((rows[0].doc_id, len(out), strategy, kind, tokens, at, min(r.page for r in rows), max(r.page for r in rows), ",".join(str(r.block_seq) for r in rows), "\n\n".join(parts)))

        def flush():
            if held:
                add([r.text for r in held], list(held), "semantic_merge", sum(r.tokens for r in held), anchor)
                held.clear()

        for r in blocks:
            own = (r.text.strip() if r.block_type == "heading" else None) or (r.section or "").strip() or None
            if r.strategy == "heading_anchored":
                flush()
                anchor = own or r.text
            elif r.strategy == "recursive_window":
                flush()
                for part in split_recursively(r.text, limits):
                    add([part], [r], r.strategy, len(part.split()), anchor)
            elif r.standalone:
                flush()
                add([r.text], [r], r.strategy, r.tokens, anchor)
            else:
                size, now = size if held else 0, None
                if held and not r.boundary and size + r.tokens <= limits.most and size >= limits.least:
                    now = bag(r)
                    new = multiset_jaccard(last if last is not None else bag(held[-1]), now) < limits.similarity
                else:
                    new = held and (r.boundary or size + r.tokens > limits.most)
                if new:
                    flush()
                    size = 0
                held.append(r)
                size, last = size + r.tokens, now
                anchor = anchor or own
        flush()
        return out

    p = plan(blocks, limits).select("doc_id", "block_seq", "page", "block_type", "section", "text", "strategy", "tokens", "standalone", "boundary")
    return by_key(p, "doc_id", "block_seq", run, "doc_id long, chunk_index long, strategy string, chunk_type string, tokens long, anchor string, page_start long, page_end long, blocks string, text string")


def chunk_ids(chunks: DataFrame) -> DataFrame:
    """chunk_id from document, first page, block ids and the text's head."""
    digest = F.substring(F.sha1(F.concat(F.replace(F.col("blocks"), F.lit(","), F.lit("|")), F.lit("|"), F.substring("text", 1, 500))), 1, 12)
    return chunks.withColumn("chunk_id", F.concat_ws("_", F.col("doc_id").cast("string"), F.concat(F.lit("p"), F.col("page_start").cast("string")), digest))


def adjacency(chunks: DataFrame, order: str, overlap: int = 96) -> DataFrame:
    """previous_id, next_id, and whether a suffix of the one before is a prefix of this one (and so for the next)."""
    w = Window.partitionBy("doc_id").orderBy(order)
    c = chunks.withColumn("_t", X.nonspace(F.col("text"))).withColumns({"_p": F.lag("_t").over(w), "_n": F.lead("_t").over(w)})

    def shared(a: Column, b: Column) -> Column:
        limit = F.least(F.size(a), F.size(b), F.lit(max(overlap, 1)))
        return F.coalesce(F.when(limit > 0, F.exists(F.sequence(F.lit(1), limit), lambda k: F.slice(a, -k, k) == F.slice(b, F.lit(1), k))), F.lit(False))

    return c.withColumns({"previous_id": F.lag("chunk_id").over(w), "next_id": F.lead("chunk_id").over(w), "overlap_prev": shared(F.col("_p"), F.col("_t")), "overlap_next": shared(F.col("_t"), F.col("_n"))}).drop("_t", "_p", "_n")


def quality_score(parse: Column, average: Column, anchor: Column, section: Column, ocr: Column, tokens: Column, limits: Limits = Limits()) -> Column:
    """Weighted chunk quality; a confidence of 0 counts as missing."""
    p = F.coalesce(F.nullif(parse, F.lit(0.0)), F.nullif(average, F.lit(0.0)), F.lit(0.7))
    budget = F.when(tokens.between(limits.least, limits.most), F.lit(1.0)).when((tokens > 0) & (tokens < limits.least), F.round(tokens / limits.least, 4)).when(tokens > limits.most, F.round(limits.most / tokens, 4)).otherwise(F.lit(0.0))
    yes = lambda c: F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.round(F.least(F.lit(1.0), 0.30 * p + 0.20 * yes(anchor) + 0.20 * budget + 0.15 * yes(section) + 0.15 * yes(~ocr)), 4)


def page_references(text: Column) -> Column:
    """Pages named as p.N or pageN."""
    parts = F.transform(X.nonspace(F.lower(F.replace(text, F.lit(","), F.lit(" ")))), lambda x: F.regexp_replace(x, r"^[\[\]().:]+|[\[\]().:]+$", ""))
    return F.transform(F.filter(parts, lambda x: x.rlike(r"^(p\.|page)[0-9]{1,9}$")), lambda x: F.regexp_extract(x, "([0-9]+)$", 1).cast("bigint"))


def adjacent_similarity(blocks: DataFrame) -> DataFrame:
    """Multiset Jaccard of every block with the one before it in its document."""

    def run(rows: list) -> list[tuple]:
        bags = [Counter(r.tokens or ()) for r in rows]
        return [(r.doc_id, r.block_seq, low := common(x, y), x.total() + y.total() - low) for r, x, y in zip(rows[1:], bags, bags[1:])]

    tokens = X.nonspace(F.lower("text")).alias("tokens")
    b = by_key(blocks.select("doc_id", "block_seq", "text"), "doc_id", "block_seq", run, "doc_id long, block_seq long, low long, total long", ["doc_id", "block_seq", tokens])
    return b.select("doc_id", "block_seq", F.when(F.col("total") == 0, F.lit(1.0)).otherwise(F.round(F.col("low") / F.col("total"), 6)).alias("similarity"))


def source_spans(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """Where each block's text lies in its document's chunk, by exact search; -1 where it doesn't."""
    j = blocks.select("doc_id", "block_seq", F.trim("text").alias("_b")).where("_b <> ''").join(chunks.select("doc_id", F.col("text").alias("_c")), "doc_id")
    at = F.instr("_c", F.col("_b")) - 1
    return j.select("doc_id", "block_seq", at.cast("bigint").alias("start_char"), F.when(at >= 0, at + F.length("_b")).cast("bigint").alias("end_char"))


def quality_flags(score: Column, parse: Column, ocr: Column, average: Column, references: Column, first: Column, last: Column, low: float = 0.40, low_parse: float = 0.55, low_ocr: float = 0.50) -> Column:
    """Flags of a chunk, in the order low_quality, low_parse_confidence, high_ocr_risk, citation_out_of_bounds."""
    flags = [F.when(score < low, "low_quality"), F.when(parse < low_parse, "low_parse_confidence"), F.when(ocr & (F.coalesce(average, F.lit(0.0)) < low_ocr), "high_ocr_risk"), F.when(F.exists(references, lambda p: (p < first) | (p > last)), "citation_out_of_bounds")]
    return F.filter(F.array(*flags), lambda x: x.isNotNull())


def starts_inside(text: Column) -> Column:
    """Whether a chunk seems to begin inside a sentence: its first character is a lower-case letter."""
    return F.coalesce(F.ltrim(text).rlike(r"^\p{Ll}"), F.lit(False))


def final_text(text: Column) -> Column:
    """Lines without blanks at their ends."""
    lines = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n")
    return F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"\s+$", "")), "\n")


def fallback_source(blocks: DataFrame, keys: tuple[str, ...] = ("block_id", "page", "section", "doc_type", "source_path", "parser_used")) -> DataFrame:
    """Of each document the first block that has any of the keys: provenance of a chunk whose text is found in none."""
    known = [c for c in keys if c in blocks.columns]
    some = blocks.where(F.coalesce(*(F.col(c).cast("string") for c in known)).isNotNull())
    return some.groupBy("doc_id").agg(F.min_by(F.struct("block_seq", *known), "block_seq").alias("b")).select("doc_id", "b.*")

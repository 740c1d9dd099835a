"""HTML main-text extraction with nearest-URL page differencing (operator 4).

A page is read as blocks of text, each with the containers it lies in.  Navigation, headers,
footers, sidebars, notices, adverts, forms, scripts and comments go by their element or class.
Of a page with an article or main element, or one named as content, what remains in it is the text; it is
not compared, since neighbouring articles may well share paragraphs.  A page without one is compared with
another page of its host, never with a copy of its own, whose URL path is nearest: the lines of both are
aligned by longest common subsequence, and shared lines are deleted as template.
"""

from __future__ import annotations

import html
import re
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import core

TAG = re.compile(r"<(?:!--.*?(?:--!?>|\Z)|(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|[!?/][^>]*(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
RAW = {"script", "style", "textarea", "title", "iframe", "template", "xmp", "svg"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set("p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr caption blockquote pre section article header footer main aside nav figure figcaption hr address details summary form fieldset body html head center dialog menu".split())
SKIP = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu"}
BOILER = re.compile(r"(?:^|[\s_-])(?:ads?[0-9]*|ad(?:box|slot|unit|wrap)\w*|adsbygoogle|advert(?:s|isements?|ising)?|banner|sponsor(?:ed)?|promo(?:tion)?s?|nav(?:bar|igation)?|menus?|breadcrumbs?|side-?bar|foot(?:er)?|masthead|site-?header|page-?header|top-?bar|cookies?\w*|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscribe|subscription|sign-?up|login|search|share|sharing|social|related|recommend(?:ed|ations)?|widgets?|comments?(?:-?(?:list|section|area|box|s))?|discussion|respond|disqus|pagination|pager|toolbar|toc|skip-?link|paywall)(?:$|[\s_-])", re.I)
#: Names that count inside an article too: nothing but menus, sidebars, footers, notices, adverts and reader comments.
INNER = re.compile(r"(?:^|[\s_-])(?:ads?[0-9]*|ad(?:box|slot|unit|wrap)\w*|adsbygoogle|advert(?:s|isements?|ising)?|sponsor(?:ed)?|nav(?:bar|igation)?|menus?|breadcrumbs?|side-?bar|foot(?:er)?|cookies?\w*|consent|notices?|comments?(?:-?(?:list|section|area|box|s))?|disqus)(?:$|[\s_-])", re.I)
CONTENT = re.compile(r"(?:^|\s)(?:(?:main|page|article|post|entry|story)[_-]?)?(?:content|article|body|text)(?:$|\s)|(?:^|\s)(?:post|entry|story|main)(?:$|\s)", re.I)
SPACES = re.compile(r"\s+")


ARTICLE, MAIN, NAMED = 1, 2, 4


def blocks(page: str) -> list[tuple[int, str]]:
    """(containers, text) of each block of text outside boilerplate; containers: sum of ARTICLE, MAIN and NAMED."""
    out: list[tuple[int, str]] = []
    piece: list[str] = []
    article = main = depth = 0
    content, inner = "", 0
    skipped, at, end = "", 0, len(page)
    where = 0

    def flush() -> None:
        text = SPACES.sub(" ", "".join(piece)).strip()
        piece.clear()
        if text:
            out.append((where, text))

    while at < end:
        m = TAG.search(page, at)
        if not skipped:
            text = page[at : m.start() if m else end]
            if text:
                piece.append(html.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing = bool(m[1] or m[4])
        if skipped:
            if skipped in ("p", "li") and name in BLOCK and (name != skipped if closing else skipped == "p" or name == "li"):
                skipped = ""  # such an element ends with the next block, or with its parent
            else:
                if name == skipped:
                    depth += -1 if closing else 1
                    skipped = skipped if depth else ""
                continue
        if name in RAW and not closing:
            if page[m.end() - 2 : m.end()] == "/>" and name in ("svg", "template"):
                continue
            close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            at = (page.find(">", close.end()) + 1 or end) if close else end
            continue
        if name in BLOCK:
            flush()
        elif name in ("br", "td", "th"):
            piece.append(" ")
        if closing:
            if name == "article" and article:
                article -= 1
            elif name == "main" and main:
                main -= 1
            elif name == content:
                inner -= 1
                content = content if inner else ""
        elif name not in VOID:
            names = INNER if article or main else BOILER
            if name == "article" and not _boiler(m[3] or "", name, names):
                article += 1
            elif name == "main":
                main += 1
            elif name in SKIP or (name == "header" and not (article or main)) or _boiler(m[3] or "", name, names):
                flush()
                skipped, depth = name, 1
            elif name == content:
                inner += 1
            elif not content and name in ("div", "section") and _names(m[3] or "", CONTENT):
                content, inner = name, 1
        where = ARTICLE * (article > 0) + MAIN * (main > 0) + NAMED * (content != "")
    flush()
    return out


def _names(attributes: str, what: re.Pattern) -> bool:
    return any(k.lower() in ("class", "id") and what.search(v.strip("\"'")) for k, v in ATTRIBUTE.findall(attributes))


def _boiler(attributes: str, name: str, names: re.Pattern) -> bool:
    if not attributes or name in ("html", "body"):
        return False
    for k, v in ATTRIBUTE.findall(attributes):
        k, v = k.lower(), v.strip("\"'").lower()
        if k == "hidden" or (k == "aria-hidden" and v == "true") or (k in ("class", "id") and names.search(v)) or (k == "role" and v in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "form")):
            return True
    return False


def chosen(found: list[tuple[int, str]]) -> tuple[bool, list[str]]:
    """Whether the page has a main container, and its lines (all lines of one without).

    Articles are the container unless most of a main element is beside them (teasers); then that is.
    """
    size = {part: sum(len(t) for p, t in found if p & part) for part in (ARTICLE, MAIN, NAMED)}
    part = ARTICLE if size[ARTICLE] and 2 * size[ARTICLE] >= size[MAIN] else MAIN if size[MAIN] else NAMED
    if size[part]:
        return True, [t for p, t in found if p & part]
    return False, [t for _, t in found]


def shared_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in a of a longest common subsequence of a and b, by bit-parallel dynamic programming."""
    n, m = len(a), len(b)
    lo = 0
    while lo < min(n, m) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(n, m) - lo and a[n - 1 - hi] == b[m - 1 - hi]:
        hi += 1
    inner_b = set(b[lo : m - hi])
    x = [i for i in range(lo, n - hi) if a[i] in inner_b]
    inner_a = {a[i] for i in x}
    y = [t for t in b[lo : m - hi] if t in inner_a]
    got: list[int] = []
    if x:
        masks: dict[int, int] = {}
        for j, t in enumerate(y):
            masks[t] = masks.get(t, 0) | 1 << j
        full = (1 << len(y)) - 1
        row, rows = full, [full]
        for i in x:
            u = row & masks[a[i]]
            row = ((row + u) | (row - u)) & full
            rows.append(row)
        j = len(y)
        for i in range(len(x), 0, -1):
            # zeros below j in a row are the length of the best alignment with y[:j]
            while j and (rows[i] >> (j - 1)) & 1:
                j -= 1
            if not j:
                break
            if (rows[i - 1] >> (j - 1)) & 1 or y[j - 1] == a[x[i - 1]] and _zeros(rows[i - 1], j) < _zeros(rows[i], j):
                got.append(x[i - 1])
                j -= 1
    return [*range(lo), *reversed(got), *range(n - hi, n)]


def _zeros(row: int, below: int) -> int:
    return below - (row & ((1 << below) - 1)).bit_count()


_PARSED = T.StructType([T.StructField("row", T.LongType()), T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("whole", T.BooleanType()), T.StructField("lines", T.ArrayType(T.StringType())), T.StructField("ids", T.ArrayType(T.LongType()))])


def _place(url: str | None) -> tuple[str, str]:
    try:
        u = urlsplit(url or "")
        return (u.netloc or "").lower(), f"{u.path}?{u.query}" if u.query else u.path
    except ValueError:
        return "", url or ""


def _parse(schema: pa.Schema):
    import xxhash

    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("host", "path", "whole", "lines", "ids")}
            for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
                whole, lines = chosen(blocks(page or ""))
                host, path = _place(url)
                for k, v in (("host", host), ("path", path), ("whole", whole or not lines), ("lines", lines), ("ids", [xxhash.xxh64_intdigest(x) - (1 << 63) for x in lines])):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) if f.name in ("page_id", "url") else pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return run


#: Neighbouring pages that a task compares at once.
GROUP = 64


def _number(batches):
    from pyspark import TaskContext

    pid, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        m = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([pid] * m, pa.int32()), pa.array(np.arange(n, n + m))], names=[*batch.schema.names, "pid", "n"])
        n += m


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _compare(batches):
    """Rows sorted by (block, at), each block with a row of its neighbours: lines that go, for own pages without a container."""

    def settle(rows):
        k0, k1, gone = [], [], []
        for i, r in enumerate(rows):
            if not r["own"] or r["whole"]:
                continue
            near = [s for s in rows[max(0, i - 1) : i] + rows[i + 1 : i + 2] if s["host"] == r["host"] and abs(s["at"] - r["at"]) == 1]
            if near:
                best = max(near, key=lambda s: (_common(s["path"], r["path"]), -s["at"]))
                k0.append(r["k0"])
                k1.append(r["k1"])
                gone.append(shared_lines(r["ids"], best["ids"]))
        return pa.RecordBatch.from_arrays([pa.array(k0, pa.int64()), pa.array(k1, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], names=["k0", "k1", "gone"])

    held: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if held and held[-1]["block"] != r["block"]:
                yield settle(held)
                held = []
            held.append(r)
    if held:
        yield settle(held)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of the main text of every page.

    Blocks are joined by a line feed in page order; white space within one is a space; character
    references are decoded.  Null html has the empty text; so has a page with nothing but
    boilerplate.  A null or malformed URL counts as host "".  Pages of a host with the same lines
    are copies, repeated rows among them: they are handled alike, as the one with the least path, and never
    compared with each other.  Of two pages whose paths agree as far with a page's own the one before it in
    URL order is the nearest.  Other columns are ignored.

    Pages of a host are paired in URL order across task borders: rows are numbered in range
    partitions, so that a host with a third of all pages is spread like any other.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = pages.sparkSession
    parts = core.partitions(spark)
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    schema = T.StructType([*source.schema.fields[:2], *_PARSED.fields[1:]])
    parsed = core.materialise(source.mapInArrow(_parse(to_arrow_schema(schema)), schema))
    parsed = parsed.withColumns({"k0": F.xxhash64("host", "ids"), "k1": F.xxhash64("ids", F.lit(7))})
    plain = parsed.where("whole").select("page_id", "url", "lines")
    open_ = parsed.where("not whole")
    if open_.isEmpty():
        kept = plain
    else:
        # one row for the copies of a page, so that no page meets its own
        small = parsed.select("host", "path", "k0", "k1", "whole", "ids").groupBy("k0", "k1", "host").agg(F.min("path").alias("path"), F.min("whole").alias("whole"), F.first("ids").alias("ids"))
        small = small.select("host", "path", "k0", "k1", "whole", "ids").repartitionByRange(parts, "host", "path", "k0", "k1").sortWithinPartitions("host", "path", "k0", "k1")
        numbered = core.materialise(small.mapInArrow(_number, T.StructType([*small.schema.fields, T.StructField("pid", T.IntegerType()), T.StructField("n", T.LongType())])))
        base = numbered.groupBy("pid").agg(F.count("*").alias("m"))  # one row per partition
        base = base.select("pid", F.coalesce(F.sum("m").over(W.orderBy("pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
        at = numbered.join(base, "pid").withColumn("at", F.col("base") + F.col("n")).drop("pid", "n", "base")
        block = F.floor(F.col("at") / GROUP)
        edge = F.array(block, F.when(F.col("at") % GROUP == 0, block - 1), F.when(F.col("at") % GROUP == GROUP - 1, block + 1))
        spread = at.withColumn("block", F.explode(F.filter(edge, lambda x: x.isNotNull()))).withColumn("own", F.col("block") == block)
        gone = spread.repartition("block").sortWithinPartitions("block", "at").mapInArrow(_compare, "k0 long, k1 long, gone array<int>").groupBy("k0", "k1").agg(F.first("gone").alias("gone"))
        left = open_.join(gone, ["k0", "k1"], "left")
        rest = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone")), lambda i: F.col("lines")[i]))
        kept = plain.unionByName(left.select("page_id", "url", rest.alias("lines")))
    text = F.array_join("lines", "\n")
    return kept.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))

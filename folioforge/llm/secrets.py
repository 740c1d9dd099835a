"""Secret scans (operator 6).

An Aho-Corasick automaton finds keywords in one pass over the bytes; regular expressions are
only tried where a keyword was hit, anchored there; token formats with an embedded checksum
are then validated by it.  Runs of hex digits, which have no keyword, come from one array pass.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import core

#: Kinds in the order that breaks ties of the start; the first three are the base.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt")
BASE = 3
NOT_HEX = np.ones(256, bool)
NOT_HEX[list(b"0123456789abcdef")] = False
ASSIGN = re.compile(rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
GITHUB = re.compile(rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
RUN = re.compile(rb"[A-Za-z0-9_-]+")
JWT = re.compile(rb"eyJ[A-Za-z0-9_-]*\.eyJ[A-Za-z0-9_-]*\.[A-Za-z0-9_-]+")
KEYWORDS = {"password": 0, "passwd": 0, "secret": 0, "token": 0, "apikey": 0, "api_key": 0, "akia": 1, "ghp_": 3, "gho_": 3, "ghu_": 3, "ghs_": 3, "ghr_": 3, "npm_": 4, "eyj": 5}
DIGITS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62(n: int, width: int = 6) -> bytes:
    out = b""
    while n:
        n, r = divmod(n, 62)
        out = DIGITS[r : r + 1] + out
    return out.rjust(width, b"0")


def _checksum(m: re.Match) -> bool:
    """The last six characters are the CRC-32 of the others."""
    return base62(zlib.crc32(m[1])) == m[2]


def _jwt(m: re.Match) -> bool:
    """Header and claims are JSON objects, and the header names an algorithm; JSON nested too deeply to read is none."""
    try:
        head, claims = (json.loads(base64.urlsafe_b64decode(x + b"=" * (-len(x) % 4))) for x in m[0].split(b".")[:2])
    except (ValueError, binascii.Error, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(claims, dict) and "alg" in head


#: By kind: expression, and what its match must fulfil to be reported.
RULES = {0: (ASSIGN, lambda m: len(m[1]) >= 12), 1: (ACCESS, lambda m: len(m[0]) >= 18), 3: (GITHUB, _checksum), 4: (NPM, _checksum), 5: (JWT, _jwt)}


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for k, v in KEYWORDS.items():
        a.add_word(k, (v, len(k)))
    a.make_automaton()
    return a


def find(buf: np.ndarray, offsets: np.ndarray, automaton) -> dict[int, list[tuple[int, int, int]]]:
    """(kind, start, end) in bytes from its document's start, for the documents of a block that have any."""
    lo = int(offsets[0])
    raw = buf[lo : offsets[-1]].tobytes()
    rel = offsets - lo
    out: dict[int, list] = {}
    s, e, _ = core.words(buf[lo : offsets[-1]], rel, NOT_HEX)
    long_ = np.flatnonzero(e - s >= 16)
    for i, d in zip(long_, np.searchsorted(rel, s[long_], "right") - 1):
        out.setdefault(int(d), []).append((2, int(s[i] - rel[d]), int(e[i] - rel[d])))
    hits = sorted((end + 1 - n, kind) for end, (kind, n) in automaton.iter(raw.lower().decode("latin-1")))
    if hits:
        docs = np.searchsorted(rel, [h[0] for h in hits], "right") - 1
        done: dict[tuple[int, int], int] = {}
        for (start, kind), d in zip(hits, docs.tolist()):
            if start < done.get((d, kind), 0):
                continue
            expression, holds = RULES[kind]
            m = expression.match(raw, start, int(rel[d + 1]))
            if m:
                done[d, kind] = m.end()
                if holds(m):
                    out.setdefault(d, []).append((kind, start - int(rel[d]), m.end() - int(rel[d])))
            elif kind == 5 and raw[start : start + 3] == b"eyJ":  # what follows this run isn't a token's rest for later keywords in it either
                done[d, kind] = RUN.match(raw, start, int(rel[d + 1])).end()
    return {d: sorted(x, key=lambda t: (t[1], t[0])) for d, x in out.items()}


def _scan(schema: pa.Schema):
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        cache = core.worker_cache()
        if "secrets" not in cache:
            cache["secrets"] = _automaton()
        for batch in batches:
            buf, off = core.text_buffer(batch.column("text"))
            spans = []
            for i, j in core.runs(off):
                found = find(buf, off[i : j + 1], cache["secrets"])
                for k in range(j - i):
                    own = found.get(k)
                    if own:
                        text = buf[off[i + k] : off[i + k + 1]]
                        before = np.r_[0, np.cumsum((text & 0xC0) != 0x80)]
                        own = [{"kind": KINDS[a], "start": int(before[s]), "end": int(before[e])} for a, s, e in own]
                    spans.append(own or [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(schema[0].type), pa.array(spans, span)], names=["doc_id", "spans"])

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans, an array of (kind, start, end) in code points, end exclusive, by start and kind.

    Kinds: assign, access and hex as their expressions say, leftmost and non-overlapping within
    a kind; github and npm tokens whose embedded CRC-32 is right; jwt whose parts decode.

    Null and empty texts have no spans; null ids and repeated rows are kept.  A token with JSON
    nested too deeply to read is not reported.  Each byte is looked at a bounded number of times, so very long
    runs of keywords cost in proportion to their length.  Nothing is shuffled.  Other columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(_scan(to_arrow_schema(schema)), schema)


def digest(found: DataFrame) -> DataFrame:
    """The query's columns."""
    said = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda x: x["kind"].isin(*KINDS[:BASE]))
    return found.select("doc_id", *(count(k) for k in KINDS[:BASE]), F.sha2(F.array_join(F.transform(base, said), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", said), ",").alias("spans"))

"""Near-duplicate lines by a segment-partition edit join (operator 2).

Two lines within ``threshold`` edits agree in one of ``threshold`` + 1 segments of the shorter: an
edit spoils one segment at most.  Every distinct line indexes its segments by (its length,
segment number, content) and probes, for each length it may pair with, only the substrings
whose start the edits left and right of the segment allow.  Candidates are verified by
banded bit-parallel edit distance on their UTF-8 bytes, a lane for each pair.  A bucket's lines are
compared with one of them; where that leaves them apart, the bucket is split by further segments.
Lines too short for edits are grouped by equality.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import components, core
from .core import U64

NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True
#: Lines (of about 15 entries of 17 bytes) that a task gathers before it sends them on.
GATHER = 200_000


def within(a: list[bytes], b: list[bytes], threshold: int) -> np.ndarray:
    """Whether each pair's edit distance is at most ``threshold``, for all pairs in step.

    One word of 2 threshold + 1 bits holds a pair's band of vertical differences; the distance
    is followed down the diagonal and then along the last row.
    """
    out = np.zeros(len(a), bool)
    longer = [x if len(x) >= len(y) else y for x, y in zip(a, b)]
    shorter = [y if len(x) >= len(y) else x for x, y in zip(a, b)]
    n1, n2 = np.array([len(x) for x in longer], np.int64), np.array([len(x) for x in shorter], np.int64)
    fit = n1 - n2 <= threshold
    small = fit & (n1 <= threshold)
    out[small] = True  # at most that many substitutions and insertions
    lanes = np.flatnonzero(fit & ~small)
    lanes = lanes[np.argsort(-n2[lanes], kind="stable")]
    if not len(lanes):
        return out
    n1, n2, k = n1[lanes], n2[lanes], threshold
    pad = 2 * k + 2  # a gap between lanes that no byte equals
    def flat(rows, sizes):
        at = np.cumsum(sizes + pad) - sizes
        buf = np.full(int((sizes + pad).sum()) + pad, 256, np.int16)
        buf[core.ranges(at, sizes)] = np.frombuffer(b"".join(rows), np.uint8)
        return buf, at

    s1, at1 = flat([longer[i] for i in lanes], n1)
    s2, at2 = flat([shorter[i] for i in lanes], n2)
    m = len(lanes)
    band = U64((1 << (2 * k + 1)) - 1)
    top, below = U64(1 << (2 * k)), U64(1 << (2 * k - 1)) if k else U64(0)
    vp = np.full(m, ((1 << (k + 1)) - 1) << k, U64)
    vn = np.zeros(m, U64)
    dist = np.full(m, k, np.int64)
    last = np.full(m, below, U64)
    steps = int(n2[0])
    for i in range(steps):
        live = int(np.searchsorted(-n2, -i, "left"))  # lanes with n2 > i
        if not live:
            break
        c = s2[at2[:live] + i]
        x = np.zeros(live, U64)
        for j in range(2 * k + 1):
            x |= (s1[at1[:live] + (i + k - j)] == c).astype(U64) << U64(2 * k - j)
        p, q = vp[:live], vn[:live]
        d0 = ((((x & p) + p) ^ p) | x | q) & band
        hp = (q | ~(d0 | p)) & band
        hn = d0 & p
        down = i < n1[:live] - k
        dist[:live] += np.where(down, (d0 & top) == 0, ((hp & last[:live]) != 0).astype(np.int64) - ((hn & last[:live]) != 0))
        last[:live] = np.where(down, last[:live], last[:live] >> U64(1))
        d1 = d0 >> U64(1)
        vp[:live] = (hn | ~(d1 | hp)) & band
        vn[:live] = d1 & hp
    out[lanes] = dist <= k
    return out


def lines_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines (empty ones too) of a block, and the first line of each document; off is relative."""
    feed = np.flatnonzero(buf[: off[-1]] == 0x0A)
    doc = np.searchsorted(off, feed, "right") - 1
    starts = np.sort(np.r_[off[:-1], feed + 1])  # the line after a feed, even an empty one at the end
    count = np.bincount(doc, minlength=len(off) - 1) + 1
    ends = np.empty_like(starts)
    first = np.cumsum(count) - count
    ends[:-1] = starts[1:] - 1
    ends[first + count - 1] = off[1:]
    return starts, ends, first


def _occurrences(least: int, with_text: bool):
    """A row for every line but short blank ones; with text, one for each distinct line of a batch of at least ``least`` bytes."""

    def run(batches):
        for batch in batches:
            buf, off = core.text_buffer(batch.column("text"))
            for i, j in core.runs(off, 4 * core.BLOCK):
                own = buf[off[i] : off[j]]
                rel = off[i : j + 1] - off[i]
                s, e, first = lines_of(own, rel)
                kept = e - s >= least
                if not with_text:  # shorter lines are compared for equality, by their ids alone
                    ink = np.r_[0, np.cumsum(~core.SPACE[own])]
                    kept |= ink[e] > ink[s]
                keep = np.flatnonzero(kept)
                if not len(keep):
                    continue
                h = core.span_ids(own, s[keep], e[keep]).view(np.int64)
                if with_text:
                    _, one = np.unique(h, return_index=True)
                    raw = own.tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array(h[one]), pa.array([raw[a:b] for a, b in zip(s[keep[one]], e[keep[one]])], pa.binary())], names=["h", "line"])
                else:
                    doc = np.searchsorted(first, keep, "right") - 1
                    take = pa.array(doc + i)
                    yield pa.RecordBatch.from_arrays([pa.array(h), *(batch.column(c).take(take) for c in ("doc_id", "k0", "k1")), pa.array((keep - first[doc]).astype(np.int32))], names=["h", "doc_id", "k0", "k1", "line"])

    return run


def segments(s: np.ndarray, e: np.ndarray, threshold: int):
    """(row, start, length, key's size and number, role) of all segments that the strings [s, e) index or probe."""
    k = threshold
    length = e - s
    for delta in range(k + 1):
        size = length - delta  # of the indexed string
        base, extra = size // (k + 1), size % (k + 1)
        for i in range(k + 1):  # the last segments are longer by one where it doesn't divide
            long_before = np.maximum(0, i - (k + 1 - extra))
            at = i * base + long_before
            seg = base + (i >= k + 1 - extra)
            lo = np.maximum(at - i, at + delta - (k - i))
            hi = np.minimum(at + i, at + delta + (k - i))
            for shift in range(int((hi - lo).max()) + 1 if len(lo) else 0):
                start = lo + shift
                ok = (start <= hi) & (start >= 0) & (start + seg <= length) & (seg > 0)
                yield np.flatnonzero(ok), (s + start)[ok], seg[ok], (size[ok].astype(U64) << U64(8)) + U64(i), ((start == at) & (delta == 0))[ok].astype(np.uint8)


def entries(ids, s: np.ndarray, e: np.ndarray, h: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, line, role) of distinct lines, ids as of core.span_ids_of; role 1: a segment of the line itself, 0: a probe only."""
    keys, nodes, roles = [], [], []
    for row, at, seg, which, role in segments(s, e, threshold):
        keys.append(core.pair(ids(at, at + seg), which))
        nodes.append(h[row])
        roles.append(role)
    return np.concatenate(keys), np.concatenate(nodes), np.concatenate(roles)


def _side_by_side(col) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """A binary column as one buffer, with starts and ends."""
    buf, off = core.text_buffer(col)
    own = buf[off[0] : off[-1]]
    return own.tobytes(), own, off[:-1] - off[0], off[1:] - off[0]


def _rests(threshold: int):
    """(band, node, line) -> (band, node, rest): the line without the segment that brought it into the bucket, for every place it has there."""

    def run(batches):
        for batch in batches:
            raw, buf, s, e = _side_by_side(batch.column("line"))
            band = batch.column("band").to_numpy(zero_copy_only=False)
            rows, rest = [], []
            for row, at, seg, which, _ in segments(s, e, threshold):
                hit = core.pair(core.span_ids(buf, at, at + seg), which).view(np.int64) == band[row]
                for r, a, n in zip(row[hit].tolist(), at[hit].tolist(), seg[hit].tolist()):
                    rows.append(r)
                    rest.append(raw[s[r] : a] + raw[a + n : e[r]])
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("band").take(take), batch.column("node").take(take), pa.array(rest, pa.binary())], names=["band", "node", "rest"])

    return run


def _refine(threshold: int):
    """Entries of a bucket's members by what is left of them: their segments again, or where little is left what deletions make of it."""
    import xxhash

    short = 3 * (threshold + 1)

    def run(batches):
        for batch in batches:
            raw, buf, s, e = _side_by_side(batch.column("rest"))
            band = batch.column("band").to_numpy(zero_copy_only=False)
            rows, key, roles, kinds, rest = [], [], [], [], []
            big = np.flatnonzero(e - s > short)
            for row, at, seg, which, role in segments(s[big], e[big], threshold):
                x = core.pair(band[big[row]].view(U64), core.pair(core.span_ids(buf, at, at + seg), which)).view(np.int64)
                for r, a, n, k, p in zip(big[row].tolist(), at.tolist(), seg.tolist(), x.tolist(), role.tolist()):
                    rows.append(r)
                    key.append(k)
                    roles.append(p)
                    kinds.append(0)
                    rest.append(raw[s[r] : a] + raw[a + n : e[r]])
            for r in np.flatnonzero(e - s <= short + threshold).tolist():
                own = raw[s[r] : e[r]]
                made = {own}
                for _ in range(threshold):
                    made |= {x[:i] + x[i + 1 :] for x in made for i in range(len(x))}
                for x in made:
                    rows.append(r)
                    key.append(xxhash.xxh64_intdigest(x, int(band[r]) & (1 << 64) - 1) - (1 << 63))
                    roles.append(1)
                    kinds.append(1)
                    rest.append(b"")
            for i in range(0, max(1, len(rows)), 50_000):
                c = slice(i, i + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(key[c], pa.int64()), batch.column("node").take(pa.array(rows[c], pa.int64())), pa.array(roles[c], pa.int32()), pa.array(kinds[c], pa.int32()), pa.array(rest[c], pa.binary())], names=["band", "node", "role", "kind", "rest"])

    return run


def _refine_lines(threshold: int):
    """_refine of what _rests makes, in one worker: two operators in a row take two workers a task."""
    rests, refine = _rests(threshold), _refine(threshold)

    def run(batches):
        yield from refine(b.slice(i, 10_000) for b in rests(batches) for i in range(0, b.num_rows, 10_000))

    return run


#: Members up to which a bucket's pairs are simply all compared (at most 15.5 pairs a member).
SMALL = 32


_BUCKET = "band long, u long, v long, ru int, rv int"


def _stars(key, node, role):
    """Of each bucket its pivot (least line that is indexed in it, else the least), and the other members beside it."""
    order = np.argsort(key)
    key, node, role = key[order], node[order], role[order]
    same = np.zeros(len(key), bool)
    same[1:] = key[1:] == key[:-1]
    same[:-1] |= same[1:]
    many = np.flatnonzero(same)  # most entries are alone in their bucket: the others are put in order
    order = many[np.lexsort((node[many], 1 - role[many], key[many]))]
    node[many], role[many] = node[order], role[order]
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    key, node, role = key[keep], node[keep], role[keep]
    at, group = core.groups(key)
    rest = np.ones(len(key), bool)
    rest[at] = False
    pivot = at[group][rest]
    return at, key, node, role, rest, pivot


def _send(least: int, threshold: int, parts: int):
    names = ["part", "band", "u", "v", "ru", "rv", "payload"]

    def pairs(key, node, role, rest, pivot):
        # probes alone have nothing to be compared with here, but other tasks may
        u, v = node[rest], node[pivot]
        for i in range(0, len(u), 200_000):
            c = slice(i, i + 200_000)
            m = len(u[c])
            yield pa.RecordBatch.from_arrays([pa.array(core.part_of(u[c].view(U64) * core.K1, parts)), pa.array(key[rest][c].view(np.int64)), pa.array(u[c]), pa.array(v[c]), pa.array(role[rest][c].astype(np.int32)), pa.array(role[pivot][c].astype(np.int32)), pa.nulls(m, pa.binary())], names=names)

    def settle(found):
        key, node, role = (np.concatenate(c) for c in zip(*found))
        at, key, node, role, rest, pivot = _stars(key, node, role)
        yield from pairs(key, node, role, rest, pivot)
        for p, payload in core.by_part(key[at], [node[at], role[at].astype(np.uint8)], parts):
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *(pa.nulls(1, pa.int64()) for _ in range(3)), *(pa.nulls(1, pa.int32()) for _ in range(2)), pa.array([payload], pa.binary())], names=names)

    def run(batches):
        found, seen, held = [], np.zeros(0, np.int64), 0
        for batch in batches:
            buf, off = core.text_buffer(batch.column("text"))
            for i, j in core.runs(off):
                own = buf[off[i] : off[j]]
                s, e, _ = lines_of(own, off[i : j + 1] - off[i])
                keep = e - s >= least
                s, e = s[keep], e[keep]
                if not len(s):
                    continue
                ids = core.span_ids_of(own)
                h = ids(s, e).view(np.int64)
                own_h, one = np.unique(h, return_index=True)
                at = np.searchsorted(seen, own_h)
                new = np.ones(len(own_h), bool)
                inner = at < len(seen)
                new[inner] = seen[at[inner]] != own_h[inner]
                seen = np.insert(seen, at[new], own_h[new])  # stays in order
                one = np.sort(one[new])
                if not len(one):
                    continue
                found.append(entries(ids, s[one], e[one], h[one], threshold))
                held += len(one)
            if held > GATHER:
                yield from settle(found)
                found, seen, held = [], np.zeros(0, np.int64), 0
        if found:
            yield from settle(found)

    return run


def _meet():
    def run(batches):
        held = []
        for batch in batches:
            packed = batch.column("payload").is_valid()
            own = batch.filter(pc.invert(packed))
            if own.num_rows:
                yield own.select(["band", "u", "v", "ru", "rv"])
            held += batch.column("payload").filter(packed).to_pylist()
        key, node, role = core.merged(held, ["u8", "i8", "u1"])
        if len(key):
            at, key, node, role, rest, pivot = _stars(key, node, role)
            u, v, ru, rv = node[rest], node[pivot], role[rest], role[pivot]
            for i in range(0, len(u), 200_000):
                c = slice(i, i + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(key[rest][c].view(np.int64)), pa.array(u[c]), pa.array(v[c]), pa.array(ru[c].astype(np.int32)), pa.array(rv[c].astype(np.int32))], names=["band", "u", "v", "ru", "rv"])

    return run


def _verify(threshold: int):
    def run(batches):
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            for i in range(0, len(a), 2000):
                ok = within(a[i : i + 2000], b[i : i + 2000], threshold)
                yield batch.slice(i, len(ok)).filter(pa.array(ok)).select(["u", "v"])

    return run


def line_texts(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, line) of the wanted lines.  The join is the same at every size: its plan doesn't hang on how many are wanted."""
    return core.materialise(lines.join(wanted.hint("merge"), "h").groupBy("h").agg(F.first("line").alias("line")))


def confirmed(pairs: DataFrame, text: DataFrame, threshold: int) -> DataFrame:
    """Those of pairs (u, v) whose lines are within the threshold; a frequent v is split by the skew join."""
    rows = pairs.join(text.select(F.col("h").alias("u"), F.col("line").alias("a")), "u").join(text.select(F.col("h").alias("v"), F.col("line").alias("b")), "v")
    return rows.select("u", "v", "a", "b").mapInArrow(core.lean(_verify(threshold)), "u long, v long")


def near_lines(docs: DataFrame, threshold: int = 2, least: int = 40) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs (of core.keyed) -> links (u, v) between distinct lines, their components, and occurrences (h, doc_id, k0, k1, line).

    Only lines of at least ``least`` bytes have links; occurrences are those of all lines but short blank ones.
    """
    spark = docs.sparkSession
    parts = core.partitions(spark)
    text = docs.select("text")
    kind = docs.schema["doc_id"].dataType
    occurrence = T.StructType([T.StructField("h", T.LongType()), T.StructField("doc_id", kind), T.StructField("k0", T.LongType()), T.StructField("k1", T.IntegerType()), T.StructField("line", T.IntegerType())])
    occurrences = core.materialise(docs.select("doc_id", "k0", "k1", "text").mapInArrow(core.lean(_occurrences(least, False)), occurrence))
    sent = text.mapInArrow(core.lean(_send(least, threshold, parts)), "part int, " + _BUCKET + ", payload binary")
    stars = core.materialise(sent.repartitionById(parts, F.col("part")).mapInArrow(core.lean(_meet()), _BUCKET))
    lines = text.mapInArrow(core.lean(_occurrences(least, True)), "h long, line binary")
    indexed = F.col("ru") + F.col("rv") > 0
    pair = [F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")]
    # buckets of probes alone have nothing to compare
    stars = core.materialise(stars.join(stars.where(indexed).select("band").distinct(), "band", "left_semi"))
    wanted = stars.select(F.col("u").alias("h")).unionByName(stars.select(F.col("v").alias("h"))).distinct()
    own = line_texts(lines, wanted)
    tried = core.materialise(stars.where(indexed).select(*pair).distinct())
    first = core.materialise(confirmed(tried, own, threshold))
    member = stars.select("band", F.col("u").alias("node"), F.col("ru").alias("role")).unionByName(stars.select("band", F.col("v").alias("node"), F.col("rv").alias("role"))).groupBy("band", "node").agg(F.max("role").alias("role"))
    label = components.connected(first)
    links = [first]
    for found in _across(member.withColumns({"kind": F.lit(0), "rest": F.lit(None).cast("binary")}), label, tried, own, threshold):
        links.append(found[0])
        label = found[1]
    return functools.reduce(DataFrame.unionByName, links), label, occurrences


def _across(member: DataFrame, label: DataFrame, tried: DataFrame, text: DataFrame, threshold: int):
    """Links between members of a bucket that its pivot did not join, and the components with them, table by table.

    Buckets of few members are compared pair by pair.  In larger ones two lines within the threshold also
    agree in a segment of what is left of them beside the shared one: buckets are split by
    these segments, again with pivots, until every bucket is of one component or small; so what
    a frequent segment costs is in proportion to its lines.  Where at most 3 (threshold + 1) bytes
    are left, two lines share what deletions make of them.
    """
    first = True
    across = (F.col("component") != F.col("component2")) & (F.col("role") + F.col("role2") > 0)
    new = lambda pairs: core.materialise(pairs.select(F.greatest("node", "node2").alias("u"), F.least("node", "node2").alias("v")).distinct().join(tried, ["u", "v"], "left_anti"))
    size = F.count("*").alias("n")
    mixed = [F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("role").alias("some"), size]
    while True:
        named = member.join(label, "node", "left").withColumn("component", F.coalesce("component", "node")).drop("n")
        open_ = core.materialise(named.join(named.groupBy("band").agg(*mixed).where("lo <> hi and some = 1 and n > 2").select("band", "n"), "band"))
        near = open_.where((F.col("n") <= SMALL) | (F.col("kind") == 1))
        other = near.select("band", F.col("node").alias("node2"), F.col("role").alias("role2"), F.col("component").alias("component2"))
        pairs = new(near.join(other, "band").where((F.col("node") > F.col("node2")) & across))
        links = core.materialise(confirmed(pairs, text, threshold))
        label = components.extended(label, links)
        yield links, label
        large = open_.where((F.col("n") > SMALL) & (F.col("kind") == 0))
        if large.isEmpty():
            return
        if first:
            lines = text.withColumnRenamed("h", "node")
            large = large.select("band", "node").join(lines, "node").select("band", "node", "line")
        sub = large.select("band", "node", "line" if first else "rest").mapInArrow(core.lean(_refine_lines(threshold) if first else _refine(threshold)), "band long, node long, role int, kind int, rest binary").distinct()
        first = False
        sub = sub.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
        sub = core.materialise(sub.join(sub.groupBy("band").agg(*mixed).where("lo <> hi and some = 1").select("band"), "band"))
        pivot = sub.groupBy("band").agg(F.min(F.struct((1 - F.col("role")).alias("r"), "node", "component")).alias("p")).select("band", F.col("p.node").alias("node2"), (1 - F.col("p.r")).alias("role2"), F.col("p.component").alias("component2"))
        pairs = new(sub.join(pivot, "band").where(across))
        links = core.materialise(confirmed(pairs, text, threshold))
        label = components.extended(label, links)
        yield links, label
        tried = tried.unionByName(pairs)
        member = sub.drop("component")


def removals(docs: DataFrame, threshold: int = 2, least: int = 40) -> DataFrame:
    """(k0, k1, gone): the lines to remove of each document that has any, with their class's first line.

    Of a class the line of the least (doc_id, row key, line number) stays.
    """
    _, label, occurrences = near_lines(docs, threshold, least)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k0", "k1", "line")
    heads = core.materialise(occurrences.groupBy("h").agg(F.min(place).alias("head"), F.count("*").alias("n")).join(label, F.col("h") == F.col("node"), "left").select("h", "n", "component", "head").where("n > 1 or component is not null"))
    classes = heads.groupBy(F.coalesce("component", "h").alias("class")).agg(F.min("head").alias("first"))
    member = heads.select("h", F.coalesce("component", "h").alias("class")).join(classes, "class").select("h", "first")
    gone = occurrences.join(member, "h").where(~place.eqNullSafe(F.col("first")))
    return gone.groupBy("k0", "k1").agg(F.array_sort(F.collect_set(F.struct("line", F.col("first.doc_id").alias("first_doc"), F.col("first.line").alias("first_line")))).alias("gone"))


def _drop_lines(schema: pa.Schema):
    def run(batches):
        for batch in batches:
            out = []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
                if gone:
                    drop = set(gone)
                    text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop)
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, f.type) if f.name == "text" else batch.column(f.name).cast(f.type) for f in schema], schema=schema)

    return run


def without_lines(rows: DataFrame) -> DataFrame:
    """rows without the lines of ``text`` whose numbers are in ``gone`` (null: none)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return rows.mapInArrow(core.lean(_drop_lines(to_arrow_schema(rows.schema))), rows.schema)


def dedup_lines(docs: DataFrame, threshold: int = 2, least: int = 40, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_removed, removed, and with ``with_text`` the text that stays.

    Lines are separated by line feeds.  Equal lines of any length are a class.  Lines of at least
    ``least`` bytes are linked within ``threshold`` edits of bytes too (two edits make another word
    of a shorter one), and linked lines are a class.  A class's first line in order of doc_id and
    line number stays and its others go.  Blank lines of less than ``least`` bytes stay: they
    separate paragraphs.  removed names each line that goes and where its class's first line
    is: "line>doc_id:line", comma-joined.

    Null counts as empty: one empty line, which stays.  Lines of rows without an id come last in
    the order.  Repeated rows (same id and text) have the same lines, none of which is removed for
    the other's sake.  An empty table gives no rows.  Other columns are ignored.
    """
    if least <= threshold or threshold < 1:
        raise ValueError("lines that are linked by edits must be longer than the threshold, which is 1 at least")
    keyed = core.keyed(docs, id_col, text_col)
    gone = removals(keyed, threshold, least)
    said = F.transform("gone", lambda g: F.concat(g["line"].cast("string"), F.lit(">"), F.coalesce(g["first_doc"].cast("string"), F.lit("")), F.lit(":"), g["first_line"].cast("string")))
    count = (F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines")
    columns = ["doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join(said, ","), F.lit("")).alias("removed")]
    if not with_text:
        return keyed.select("doc_id", "k0", "k1", count).join(gone, ["k0", "k1"], "left").select(*columns)
    rows = keyed.select("doc_id", "k0", "k1", "text", count).join(gone, ["k0", "k1"], "left").select(*columns, "text", F.transform("gone", lambda g: g["line"]).alias("gone"))
    return without_lines(rows).drop("gone")

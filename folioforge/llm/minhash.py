"""MinHash near-dedup (operator 5).

Circulant MinHash: one permutation (sigma) scatters the shingles over D places; the other
(pi) is read from the place onwards, so coordinate k of the signature is the least
pi[(sigma(x) + k) mod D] of the set: two permutations make all coordinates.  Coordinates
are cut into bands; documents with an equal band are candidates; candidates are
confirmed by exact Jaccard similarity of the full sets.

Documents of equal sets are one class from the start.  What buckets connect is a block, whether it is
similar or not: variants of one text, most of them.  A block's sets meet in one task, once each, where all its
pairs are compared together by products of incidence matrices; a block too large for one task is
cut into parts, and each two parts meet.  So a group of variants that grows with the table takes no exchange
of pairs, and some 50 ns a pair.

In blocks of over PARTS parts buckets are looked at one by one: the members are
compared with one pivot.  Where members stay in different components afterwards, a small
bucket's remaining pairs across components are compared.  In a larger one only those are that share one of
the rarest shingles (prefix filter: two sets of this similarity always do), so that documents which
have a long notice in common, and little else, cost in proportion to their number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components, core
from .core import U64

D = 1 << 20
BANDS, ROWS = 48, 6


def _pi(width: int) -> np.ndarray:
    c = core.worker_cache()
    if "pi" not in c:
        pi = np.random.default_rng(911).permutation(D).astype(np.uint32)
        c["pi"] = np.lib.stride_tricks.sliding_window_view(np.r_[pi, pi[:width]], width)
    return c["pi"]


def signature(shingles: np.ndarray, width: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash signature of one set of 64-bit identifiers."""
    view = _pi(width)
    at = (core.mix(shingles) >> U64(44)).astype(np.int64)
    out = view[at[:512]].min(axis=0)
    for i in range(512, len(at), 512):
        np.minimum(out, view[at[i : i + 512]].min(axis=0), out=out)
    return out


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """64-bit identifiers of the bands; the band's number is part of it."""
    s = sig.astype(U64).reshape(-1, rows)
    x = np.arange(len(s), dtype=U64) * core.K3
    for k in range(rows):
        x = core.pair(x, s[:, k])
    return x


def shingle_sets(buf: np.ndarray, off: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle identifiers of each document; off has absolute offsets."""
    low = core.LOWER[buf[off[0] : off[-1]]]
    rel = off - off[0]
    s, e, n = core.words(low, rel)
    w = core.span_ids(low, s, e)
    at = np.r_[0, np.cumsum(n)]
    x = w
    for _ in range(size - 1):
        x = core.pair(x[:-1], w[len(w) - len(x) + 1 :]) if len(x) else x
    for k in range(len(n)):
        a, b = at[k], at[k + 1]
        if b - a >= size:
            yield np.unique(x[a : b - size + 1])
        elif b > a:
            short = w[a : a + 1]
            for t in range(a + 1, b):
                short = core.pair(short, w[t : t + 1])
            yield core.mix(short ^ U64(b - a))
        else:
            yield w[:0]


def _sign(size: int, width: int, rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("h0", pa.int64()), ("h1", pa.int64()), ("n", pa.int64()), ("bands", pa.binary())])

    def run(batches):
        known: dict[bytes, bytes] = {}
        for batch in batches:
            buf, off = core.text_buffer(batch.column("text"))
            h, n, sent = [], [], []
            for i, j in core.runs(off):
                for x in shingle_sets(buf, off[i : j + 1], size):
                    d = hashlib.blake2b(x.tobytes(), digest_size=16).digest()
                    h.append(d)
                    n.append(len(x))
                    if not len(x):
                        sent.append(None)
                        continue
                    if d not in known:
                        if len(known) > 20_000:
                            known.clear()
                        known[d] = bands(signature(x, width), rows).tobytes()
                    sent.append(known[d])
            h2 = np.frombuffer(b"".join(h), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("k1"), pa.array(h2[:, 0]), pa.array(h2[:, 1]), pa.array(n, pa.int64()), pa.array(sent, pa.binary())], schema=schema)

    return run


EDGE = "band long, u long, v long, n_u int, n_v int"


def _edges(band, u, v, nu, nv) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(u), 200_000):
        k = slice(i, i + 200_000)
        yield pa.RecordBatch.from_arrays([pa.array(band[k].view(np.int64)), pa.array(u[k]), pa.array(v[k]), pa.array(nu[k].astype(np.int32)), pa.array(nv[k].astype(np.int32))], names=["band", "u", "v", "n_u", "n_v"])


def _stars(key: np.ndarray, node: np.ndarray, n: np.ndarray):
    """Least node of each bucket, and (member, pivot) pairs for its other members."""
    order = np.lexsort((node, key))
    key, node, n = key[order], node[order], n[order]
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    key, node, n = key[keep], node[keep], n[keep]
    at, group = core.groups(key)
    rest = np.ones(len(key), bool)
    rest[at] = False
    pivot = at[group][rest]
    return (key[at], node[at], n[at]), (key[rest], node[rest], node[pivot], n[rest], n[pivot])


def _local_buckets(parts: int):
    """Buckets of one task: its pairs, and one entry per bucket for the other tasks."""
    schema = ["part", "band", "u", "v", "n_u", "n_v", "payload"]

    def settle(key, node, n):
        one, (k, u, v, nu, nv) = _stars(np.concatenate(key), np.concatenate(node), np.concatenate(n))
        for i in range(0, len(u), 200_000):
            c = slice(i, i + 200_000)
            m = len(u[c])
            yield pa.RecordBatch.from_arrays([pa.array(core.part_of(u[c].view(U64) * core.K1, parts)), pa.array(k[c].view(np.int64)), pa.array(u[c]), pa.array(v[c]), pa.array(nu[c].astype(np.int32)), pa.array(nv[c].astype(np.int32)), pa.nulls(m, pa.binary())], names=schema)
        for p, payload in core.by_part(one[0], [one[1], one[2].astype("u4")], parts):
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32()), pa.array([payload], pa.binary())], names=schema)

    def run(batches):
        key, node, n, held = [], [], [], 0
        for batch in batches:
            own, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "n"))
            got = [np.frombuffer(x, U64) for x in batch.column("bands").to_pylist()]
            if got:
                key.append(np.concatenate(got))
                times = [len(x) for x in got]
                node.append(np.repeat(own, times))
                n.append(np.repeat(size, times))
                held += len(key[-1])
            if held > 3_000_000:
                yield from settle(key, node, n)
                key, node, n, held = [], [], [], 0
        if key:
            yield from settle(key, node, n)

    return run


def _join_buckets():
    def run(batches):
        held = []
        for batch in batches:
            packed = batch.column("payload").is_valid()
            own = batch.filter(pc.invert(packed))
            if own.num_rows:
                yield own.select(["band", "u", "v", "n_u", "n_v"])
            held += batch.column("payload").filter(packed).to_pylist()
        key, node, n = core.merged(held, ["u8", "i8", "u4"])
        if len(key):
            _, (k, u, v, nu, nv) = _stars(key, node, n)
            yield from _edges(k, u, v, nu, nv)

    return run


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _sets(size: int):
    """Replaces the text by its set; equal neighbours are computed once."""

    def run(batches):
        last, mine = None, b""
        for batch in batches:
            buf, off = core.text_buffer(batch.column("text"))
            u = batch.column("u").to_numpy(zero_copy_only=False)
            out = []
            for k in range(batch.num_rows):
                now = (u[k], buf[off[k] : off[k + 1]].tobytes())  # an id may have several texts
                if now != last:
                    last, mine = now, next(shingle_sets(buf, off[k : k + 2], size)).tobytes()
                out.append(mine)
            names = ["u", "v", "salt"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out, pa.binary())], names=[*names, "items"])

    return run


def _confirm(percent: int):
    """Rows sorted by (pivot, salt), the pivot's own sets first (several, if its id has several texts): emits the pairs that hold."""

    def run(batches):
        at, mine = None, []
        for batch in batches:
            u, v, salt = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v", "salt"))
            sets = batch.column("items")
            hu, hv = [], []
            for k in range(batch.num_rows):
                x = np.frombuffer(sets[k].as_buffer(), U64)
                if (v[k], salt[k]) != at:
                    at, mine = (v[k], salt[k]), []
                if u[k] == v[k]:
                    mine.append(x.copy())
                elif any(_similar(x, y, percent) for y in mine):
                    hu.append(int(u[k]))
                    hv.append(int(v[k]))
            if hu:
                yield pa.RecordBatch.from_arrays([pa.array(hu, pa.int64()), pa.array(hv, pa.int64())], names=["u", "v"])

    return run


#: Sets, and shingles of them, in one part of a block, and parts up to which all of a block's pairs are compared.
PART_SETS, PART_ITEMS, PARTS = 4096, 1 << 19, 32
#: Cells that one step of a comparison works on: its arrays have 2 MB each.
STEP = 1 << 18


def _common(sets: list[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(i, j, sizes of the intersections of sets i to j - 1 with all sets), for all of them in steps."""
    m = len(sets)
    sizes = np.array([len(x) for x in sets])
    own = np.repeat(np.arange(m, dtype=np.int32), sizes)
    items = np.concatenate(sets)
    order = np.argsort(items)
    at, group = core.groups(items[order])
    holder, kind = own[order], np.empty(len(items), np.int32)
    kind[order] = group
    times = np.diff(np.r_[at, len(items)])
    # shingles that an eighth of the sets have: a dense matrix; others but for single ones: lists of holders
    hot = (times > 1) & (8 * times >= m)
    listed = np.where((times > 1) & ~hot, times, 0)
    dense = np.zeros((m, int(hot.sum())), np.float32)
    k = hot[kind]
    dense[own[k], (np.cumsum(hot) - 1)[kind[k]]] = 1
    first = np.r_[0, np.cumsum(sizes)]
    cost = np.r_[0, np.cumsum(listed[kind])][first] + m * np.arange(m + 1)
    for i, j in core.runs(cost, STEP):
        both = (dense[i:j] @ dense.T).astype(np.int64)
        mine = kind[first[i] : first[j]]
        n = listed[mine]
        if n.any():
            cell = np.repeat((own[first[i] : first[j]] - i).astype(np.int64) * m, n) + holder[core.ranges(at[mine], n)]
            both += np.bincount(cell, minlength=(j - i) * m).reshape(j - i, m)
        yield i, j, both


def _joined(node: np.ndarray, part: np.ndarray, sets: list[np.ndarray], percent: int, across: bool) -> pa.RecordBatch:
    """(u, least node reachable, number of similar sets) of the sets that have such; nodes ascend.  across: pairs of two parts only."""
    n = np.array([len(x) for x in sets])
    label, links = np.searchsorted(node, node), np.zeros(len(node), np.int64)
    for i, j, both in _common(sets):
        near = 100 * both >= percent * (n[i:j, None] + n - both)
        near[np.arange(j - i), np.arange(i, j)] = False
        if across:
            near &= part[i:j, None] != part
        links[i:j] = near.sum(axis=1)
        for k in np.flatnonzero(links[i:j]):
            met = label[near[k]]
            if (met != label[i + k]).any():
                met = np.unique(np.append(met, label[i + k]))
                label[np.isin(label, met[1:])] = met[0]
    some = links > 0
    return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[label[some]]), pa.array(links[some])], names=["u", "v", "links"])


def _blocks(size: int, percent: int):
    """Rows sorted by block, two parts of it, and id: the links of each such group."""

    def run(batches):
        at, node, part, sets, last = None, [], [], [], None

        def settle():
            if len(sets) > 1:
                yield _joined(np.array(node), np.array(part), sets, percent, at[1] != at[2])

        for batch in batches:
            buf, off = core.text_buffer(batch.column("text"))
            block, i, j, u, k1, own = (batch.column(c).to_pylist() for c in ("block", "i", "j", "u", "k1", "own"))
            for x, y in core.runs(off):
                for k, items in enumerate(shingle_sets(buf, off[x : y + 1], size), x):
                    if at != (block[k], i[k], j[k]):
                        yield from settle()
                        at, node, part, sets, last = (block[k], i[k], j[k]), [], [], [], None
                    if last != (u[k], k1[k]):  # else a repeated row
                        last = (u[k], k1[k])
                        node.append(u[k])
                        part.append(own[k])
                        sets.append(items)
        yield from settle()

    return run


def _within(pairs: DataFrame, docs: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame:
    """Links within the blocks of pairs (u, v, block, parts): each set and the least one of its part or two that it reaches."""
    node = pairs.select(F.col("u").alias("doc_id"), "block", "parts").unionByName(pairs.select(F.col("v").alias("doc_id"), "block", "parts")).distinct()
    rows = docs.join(reps.join(node, "doc_id"), ["doc_id", "k1"])
    rows = rows.withColumn("own", F.pmod(F.xxhash64("doc_id", "k1"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = rows.select("block", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("doc_id").alias("u"), "k1", "own", "text")
    rows = rows.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j", "u", "k1")
    return rows.mapInArrow(core.lean(_blocks(size, percent)), "u long, v long, links long")


def confirmed(pairs: DataFrame, docs: DataFrame, reps: DataFrame, size: int, percent: int, per_task: int = 512) -> DataFrame:
    """Those of pairs (u, v) whose full sets are similar; of pairs (u, v, block, parts), all similar ones of their blocks, see _within.

    A pivot v's members are split into salted groups of about ``per_task``; its set goes to each
    of them, so that no task gets an unbounded group.
    """
    if "block" in pairs.columns:
        return _within(pairs, docs, reps, size, percent)
    many = pairs.groupBy("v").agg(F.count("*").alias("members"))
    salted = pairs.join(many, "v").select("u", "v", F.pmod(F.xxhash64("u"), F.ceil(F.col("members") / per_task)).alias("salt"))
    asked = salted.unionByName(salted.select(F.col("v").alias("u"), "v", "salt").distinct())
    asked = asked.join(reps.withColumnRenamed("doc_id", "u"), "u").select(F.col("u").alias("doc_id"), "k1", "v", "salt")
    rows = docs.join(asked, ["doc_id", "k1"]).select(F.col("doc_id").alias("u"), "v", "salt", "text").mapInArrow(core.lean(_sets(size)), "u long, v long, salt long, items binary")
    rows = rows.repartition("v", "salt").sortWithinPartitions("v", "salt", F.col("u") != F.col("v"))
    return rows.mapInArrow(core.lean(_confirm(percent)), "u long, v long").distinct().withColumn("links", F.lit(None).cast("long"))


#: Members up to which a bucket's pairs are simply all compared (at most 15.5 pairs a member).
SMALL = 32
#: Cells of the sketch of shingle frequencies.
CELLS = 1 << 16


def _cell(items: np.ndarray) -> np.ndarray:
    return (core.mix(items) >> U64(48)).astype(np.int64)


def _counts(size: int):
    """Documents' shingles by cell, a row of a task and cell."""

    def run(batches):
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            buf, off = core.text_buffer(batch.column("text"))
            for i, j in core.runs(off):
                for x in shingle_sets(buf, off[i : j + 1], size):
                    total += np.bincount(_cell(x), minlength=CELLS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "times"])

    return run


def _prefixes(shared, size: int, percent: int):
    """(token, node, n, at): of each set its first n - ceil(percent n) + 1 shingles in order of rarity."""

    def run(batches):
        order = shared.value
        for batch in batches:
            buf, off = core.text_buffer(batch.column("text"))
            node = batch.column("node").to_numpy(zero_copy_only=False)
            for i, j in core.runs(off):
                tokens, nodes, sizes, places = [], [], [], []
                for k, x in enumerate(shingle_sets(buf, off[i : j + 1], size)):
                    m = len(x) - -(-percent * len(x) // 100) + 1
                    first = np.lexsort((x, order[_cell(x)]))[:m]
                    tokens.append(x[first])
                    nodes.append(np.full(len(first), node[i + k]))
                    sizes.append(np.full(len(first), len(x)))
                    places.append(np.arange(len(first)))
                t, v, n, at = (np.concatenate(c) for c in (tokens, nodes, sizes, places))
                yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(v), pa.array(n), pa.array(at)], names=["band", "node", "n", "at"])

    return run


def _split(nodes: DataFrame, docs: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame:
    """(band, node, n, at) of the rarest shingles of the nodes' sets; ``band`` is the shingle."""
    spark = docs.sparkSession
    own = nodes.select("node").distinct().join(reps.withColumnRenamed("doc_id", "node"), "node")
    texts = core.materialise(docs.join(own.select(F.col("node").alias("doc_id"), "k1"), ["doc_id", "k1"]).select(F.col("doc_id").alias("node"), "k1", "text").dropDuplicates(["node", "k1"]))
    cells = texts.select("text").mapInArrow(core.lean(_counts(size)), "cell int, times long").groupBy("cell").agg(F.sum("times").alias("times")).collect()  # CELLS rows at most
    order = np.zeros(CELLS, np.int64)
    for r in cells:
        order[r["cell"]] = r["times"]
    return texts.select("node", "text").mapInArrow(core.lean(_prefixes(spark.sparkContext.broadcast(order), size, percent)), "band long, node long, n long, at long")


def _by_buckets(stars: DataFrame, label: DataFrame, docs: DataFrame, reps: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links found bucket by bucket, and label extended by them."""
    fit = 100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v")
    first = core.materialise(confirmed(stars.where(fit).select("u", "v").distinct(), docs, reps, size, percent))
    # buckets whose members are in different components by now
    member = stars.select("band", F.col("u").alias("node"), F.col("n_u").alias("n")).unionByName(stars.select("band", F.col("v").alias("node"), F.col("n_v").alias("n"))).distinct()
    tried = stars.where(fit).select("u", "v").distinct()
    confirm = lambda pairs: core.materialise(confirmed(pairs, docs, reps, size, percent))

    def open_of(member: DataFrame, label: DataFrame) -> DataFrame:
        named = member.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
        some = named.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members"), F.min("node").alias("node2")).where("lo <> hi")
        return core.materialise(named.join(some.select("band", "members", "node2"), "band"))

    def across(left: DataFrame, right: DataFrame) -> DataFrame:
        """Pairs of different components in a bucket whose sizes, and shingles left beside the shared one, suffice."""
        other = right.select("band", F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("component").alias("component2"), *([F.col("at").alias("at2")] if "at" in right.columns else []))
        pairs = left.drop("node2").join(other, "band").where((F.col("node") != F.col("node2")) & (F.col("component") != F.col("component2")) & (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")))
        if "at" in left.columns:
            pairs = pairs.where(F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2")) * (100 + percent) >= percent * (F.col("n") + F.col("n2")))
        return core.materialise(pairs.select(F.greatest("node", "node2").alias("u"), F.least("node", "node2").alias("v")).distinct().join(tried, ["u", "v"], "left_anti"))

    label = components.extended(label, first)
    open_ = open_of(member, label)
    few = open_.where(F.col("members") <= SMALL)
    found = confirm(across(few, few))
    links, label = first.unionByName(found), components.extended(label, found)
    large = open_.where(F.col("members") > SMALL)
    if not large.isEmpty():
        prefixes = core.materialise(_split(large, docs, reps, size, percent))
        # pivots first, then what they leave apart
        open_ = open_of(prefixes, label)
        found = confirm(across(open_, open_.where(F.col("node") == F.col("node2"))))
        links, label = links.unionByName(found), components.extended(label, found)
        open_ = open_of(prefixes, label)
        found = confirm(across(open_, open_))
        links, label = links.unionByName(found), components.extended(label, found)
    return links, label


def near_duplicates(docs: DataFrame, size: int = 2, percent: int = 80, n_bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents linked by shingle similarity of at least ``percent`` per cent.

    Returns per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable),
    kept (doc_id = component_id), links (sets of its block that are similar to its own; in blocks of over PARTS
    parts, candidate links that were confirmed; 0 for alone).

    With 48 bands of 6 coordinates a pair at the very threshold of 0.8 is missed with a
    probability of 5e-7, one at 0.85 with 5e-11; what is found is confirmed on full sets.

    Ids are integers.  Null and empty texts, or texts of white space, have no shingles and link with nothing,
    not even each other.  Rows without an id take part in no group: component_id null, kept
    true.  Rows that share an id are one node.  Other columns of docs are ignored.
    """
    spark = docs.sparkSession
    parts = core.partitions(spark)
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), t.alias("text")).select("doc_id", F.xxhash64("text").alias("k1"), "text")
    signed = core.materialise(docs.mapInArrow(core.lean(_sign(size, n_bands * rows, rows)), "doc_id long, k1 long, h0 long, h1 long, n long, bands binary"))
    named = signed.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = core.materialise(named.groupBy("h0", "h1").agg(F.min(F.struct("doc_id", "k1")).alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")).select("h0", "h1", F.col("rep.doc_id").alias("node"), F.col("rep.k1").alias("k1"), "n", "bands"))
    sent = classes.select("node", "n", "bands").mapInArrow(core.lean(_local_buckets(parts)), "part int, " + EDGE + ", payload binary")
    stars = core.materialise(sent.repartitionById(parts, F.col("part")).mapInArrow(core.lean(_join_buckets()), EDGE))
    reps = classes.select(F.col("node").alias("doc_id"), "k1")
    pairs = core.materialise(stars.select("u", "v").distinct())
    block = core.materialise(components.connected(pairs).withColumnRenamed("component", "block"))
    parts_of = block.join(classes.select("node", "n"), "node").groupBy("block").agg(F.greatest(F.ceil(F.count("*") / PART_SETS), F.ceil(F.sum("n") / PART_ITEMS)).alias("parts"))
    block = core.materialise(block.join(parts_of, "block"))
    whole = block.where(F.col("parts") <= PARTS)
    links = core.materialise(confirmed(pairs.join(whole.withColumnRenamed("node", "u"), "u"), docs, reps, size, percent))
    label = components.connected(links)
    rest = block.where(F.col("parts") > PARTS).select("node")
    if not rest.isEmpty():
        more, label = _by_buckets(stars.join(rest.withColumnRenamed("node", "u"), "u"), label, docs, reps, size, percent)
        links = links.unionByName(more)
    # rows of one id with different texts are one node, though of several classes
    twice = named.groupBy("doc_id").agg(F.min("h0").alias("lo"), F.max("h0").alias("hi")).where("lo <> hi").select("doc_id")
    same = named.join(twice, "doc_id").join(classes.select("h0", "h1", "node"), ["h0", "h1"]).select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    label = components.extended(label, same)
    degree = links.select(F.col("u").alias("node"), F.coalesce("links", F.lit(1)).alias("links")).unionByName(links.where("links IS NULL").select(F.col("v").alias("node"), F.lit(1).alias("links"))).groupBy("node").agg(F.sum("links").alias("links"))
    kind = classes.select("h0", "h1", "node").join(degree, "node", "left").select("h0", "h1", "node", "links").join(label, "node", "left").select("h0", "h1", F.coalesce("component", "node").alias("group"), "links")
    out = signed.select("doc_id", "h0", "h1", "n").join(kind, ["h0", "h1"], "left")
    group = F.when(F.col("doc_id").isNotNull(), F.coalesce("group", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), group.alias("component_id"), F.coalesce(F.col("doc_id") == group, F.lit(True)).alias("kept"), F.coalesce("links", F.lit(0)).alias("links"))

"""Exact search for repeated windows of W units (words or bytes), the core of two operators.

Levels double the length, up to W (bytes: 50, 100, 200; words: 9, 18, 35).  At each level there is a
distributed table of buckets: an entry is a place and its bucket, the pair of the bucket
identifiers of half the length, at the place itself and at the later offset where the second
half begins.  Entries are sorted on both; what is alone in its bucket goes, and with it every window that
holds it; only what survives is refined at the next level, whose identifiers are made
from this one's.

Not every place has an entry.  Of the identifiers of a level within a window the least one
(leftmost on ties) is the window's anchor, and anchors alone enter a table below the last level: equal
windows have equal anchors at equal distances, so

1. a window whose anchor is alone at any level is no repeat;
2. anchors that survive to the last but one level are extended to the whole stretch of windows that
   they anchor (up to 2 W units); a stretch that occurs twice has only repeated windows;
3. what is left, the ends of matches, is decided at every place, on W units.

A task sends one entry per bucket and keeps its own further occurrences to itself, so
a passage that a third of all rows share costs one entry per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import core
from .core import U64

#: Marks of stretches: all windows repeated; to be looked at window by window; candidates of the next level.
FULL, DETAIL, MAYBE = 1, 2, 4
#: Anchors (of some 40 bytes) that a task gathers before it sends them on.
GATHER = 2_000_000
PASS1 = "part int, kind int, k0 long, k1 int, payload binary"
_ENTRY = ["u8", "u8", "u8", "i8", "u2", "u4", "u4"]
_MAYBE_ENTRY = ["u8", "u8", "i8", "u2", "u4", "u2", "u1"]
_SIXTEEN = ["u8", "i8", "u2", "i4", "u2", "u2"]
_STRETCH = ["u4", "u4", "u2", "u1"]


def level_lengths(window: int, start: int = 1) -> list[int]:
    """Lengths of the levels, ascending, each at most twice the one before; the first is at most ``start``."""
    out = [window]
    while out[-1] > start:
        out.append((out[-1] + 1) // 2)
    return out[::-1]


def identifiers(x: np.ndarray, lengths: list[int], wanted: set[int], exact: bool) -> dict[int, np.ndarray]:
    """Identifiers of the windows of each wanted length; x has those of single units.

    exact: units are bytes; up to 8 of them make an identifier without hashing.
    """
    got = {}
    at = 1
    for n in lengths:
        while at < n:
            to = min(2 * at, n)
            step = to - at
            a, b = x[: max(0, len(x) - step)], x[step:]
            x = a | (b << U64(8 * step)) if exact and to <= 8 else core.pair(a, b)
            at = to
        if n in wanted:
            got[n] = x
    return got


def least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    at = 1
    while at < width:
        step = min(at, width - at)
        x = np.minimum(x[:-step], x[step:]) if len(x) > step else x[:0]
        at += step
    return x


class Finder:
    """What both operators need to know of units and windows."""

    def __init__(self, window: int, by: str):
        self.window, self.by, self.exact = window, by, by == "byte"
        self.lengths = level_lengths(window, 8 if self.exact else 1)
        #: lengths whose anchors have tables; the window itself where it has no halves
        self.levels = self.lengths[-3:-1] or [window]
        if not 0 < window < 1 << 15:
            raise ValueError("a window has 1 to 32767 units")

    def units(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers of a block's units, and where each document's begin and end."""
        if self.exact:
            return buf[offsets[0] : offsets[-1]], offsets - offsets[0]
        s, e, n = core.words(buf, offsets)
        return core.span_ids(buf, s, e), np.r_[0, np.cumsum(n)]

    def pieces(self, x: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
        """Parts of a block that numpy takes at once, their place in it and in their document; a very long document goes in overlapping ones."""
        if len(x) <= 4 * core.BLOCK:
            yield x, bounds, 0, 0
        else:
            for d in range(len(bounds) - 1):
                for base in range(int(bounds[d]), int(bounds[d + 1]), 2 * core.BLOCK):
                    end = min(int(bounds[d + 1]), base + 2 * core.BLOCK + self.window - 1)
                    own = np.full(len(bounds), 0, np.int64)
                    own[d + 1 :] = end - base
                    yield x[base:end], own, base, base - int(bounds[d])

    def _half(self, q: int) -> int:
        """Length of which two make q, overlapping where q is odd; 0 for the least length."""
        k = self.lengths.index(q)
        return self.lengths[k - 1] if k else 0

    def ids(self, x: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Identifiers of length q, their two bucket identifiers, and those of whole windows."""
        half = self._half(q)
        got = identifiers(x.astype(U64) if self.exact else x, self.lengths, {half, q, self.window}, self.exact)
        iq = got[q]
        first = got[half][: len(iq)] if half else iq
        later = got[half][q - half :] if half else np.zeros(len(iq), U64)
        return iq, first, later, got[self.window]

    def anchors(self, x: np.ndarray, bounds: np.ndarray, q: int, maybe: np.ndarray | None):
        """Per stretch of (candidate) windows with one anchor: document, first window, windows, the anchor's distance, its two bucket identifiers, stretch id."""
        W = self.window
        n = np.diff(bounds) - W + 1
        if len(x) < W or not (n > 0).any() or (maybe is not None and not maybe.any()):
            return None
        iq, b0, b1, iw = self.ids(x, q)
        mask = U64((1 << len(iq).bit_length()) - 1)
        key = core.mix(iq) if self.exact and q <= 8 else iq.copy()
        key &= ~mask
        key |= np.arange(len(iq), dtype=U64)
        key = least(key, W - q + 1)
        p = core.ranges(bounds[:-1], np.maximum(n, 0))
        if maybe is not None:
            p = p[maybe[p]]
            if not len(p):
                return None
        a = (key[p] & mask).astype(np.int64)
        doc = np.searchsorted(bounds, p, "right") - 1
        new = np.ones(len(p), bool)
        new[1:] = (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.r_[first, len(p)])
        p0, doc, a = p[first], doc[first], a[first]
        s = core.pair(core.pair(iw[p0], iw[p0 + count - 1]), count.astype(U64))
        return doc, p0 - bounds[doc], count, a - p0, b0[a], b1[a], s


def _lists(own: np.ndarray, p0, n, rel, flag) -> tuple[np.ndarray, list[bytes]]:
    """Packed stretches of each owner (a row number), adjoining FULL ones as one; and where owners start."""
    order = np.lexsort((p0, own))
    own, p0, n, rel, flag = (x[order] for x in (own, p0.astype(np.int64), n.astype(np.int64), rel, flag))
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (p0[1:] != p0[:-1] + n[:-1]) | (flag[1:] != FULL) | (flag[:-1] != FULL)
    at = np.flatnonzero(new)
    n = np.add.reduceat(n, at)
    own, p0, rel, flag = own[at], p0[at].astype("u4"), rel[at].astype("u2"), flag[at].astype("u1")
    n = n.astype("u4")
    first, _ = core.groups(own)
    return own[first], [core.pack(p0[i:j], n[i:j], rel[i:j], flag[i:j]) for i, j in zip(first, np.r_[first[1:], len(own)])]


def _doc_rows(k0, k1, doc, p0, n, rel, flag, parts) -> Iterator[pa.RecordBatch]:
    """One row for each document with its marked stretches."""
    if not len(doc):
        return
    own, payload = _lists(doc, p0, n, rel, flag)
    m = len(own)
    yield from core.rows_of({"part": (pa.int32(), core.part_of(k0[own].view(U64), parts)), "kind": (pa.int32(), np.zeros(m, np.int32)), "k0": (pa.int64(), k0[own]), "k1": (pa.int32(), k1[own]), "payload": (pa.binary(), payload)})


def _entry_rows(rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    if rows:
        p, payload = zip(*rows)
        m = len(p)
        yield from core.rows_of({"part": (pa.int32(), list(p)), "kind": (pa.int32(), [1] * m), "k0": (pa.int64(), [None] * m), "k1": (pa.int32(), [None] * m), "payload": (pa.binary(), list(payload))}, 50)


def _maybe(marks, bounds: np.ndarray) -> np.ndarray:
    """Which places of a block begin a candidate window; marks: each document's lists."""
    edge = np.zeros(int(bounds[-1]) + 1, np.int64)
    for d, own in enumerate(marks):
        if own.is_valid:
            p0, n, _, _ = core.merged([x.as_py() for x in own.values], _STRETCH)
            np.add.at(edge, bounds[d] + p0.astype(np.int64), 1)
            np.add.at(edge, bounds[d] + p0.astype(np.int64) + n.astype(np.int64), -1)
    return np.cumsum(edge[:-1]) > 0


def _gather(finder: Finder, q: int, parts: int):
    """The table of level q: anchors of a task's documents; repeats within the task are settled here.

    Below the last but one level a bucket of several is a candidate.  At that level
    stretches are compared too.
    """
    last = q == finder.levels[-1]

    def candidates(k0, k1, doc, p0, n, rel, b0, b1):
        order = np.lexsort((b1, b0))
        doc, p0, n, rel, b0, b1 = (x[order] for x in (doc, p0, n, rel, b0, b1))
        at, group = core.groups2(b0, b1)
        many = np.diff(np.r_[at, len(b0)])[group] > 1
        zero = np.zeros(int(many.sum()), np.int64)
        yield from _doc_rows(k0, k1, doc[many], p0[many], n[many], zero, zero + MAYBE, parts)
        yield from _entry_rows(list(core.by_part(core.pair(b0[at], b1[at]), [b0[at], b1[at], k0[doc[at]], k1[doc[at]].astype("u2"), p0[at].astype("u4"), n[at].astype("u2"), many[at].astype("u1")], parts, False)))

    def settle(k0, k1, found):
        doc, p0, n, rel, b0, b1, s = (np.concatenate(c) for c in zip(*found))
        if not last:
            yield from candidates(k0, k1, doc, p0, n, rel, b0, b1)
            return
        order = np.lexsort((s, b1, b0))
        doc, p0, n, rel, b0, b1, s = (x[order] for x in (doc, p0, n, rel, b0, b1, s))
        bat, bgroup = core.groups2(b0, b1)
        new = np.ones(len(s), bool)
        new[1:] = (bgroup[1:] != bgroup[:-1]) | (s[1:] != s[:-1])
        sat = np.flatnonzero(new)
        sgroup = np.cumsum(new) - 1
        times = np.diff(np.r_[sat, len(s)])
        kinds = np.bincount(bgroup[sat], minlength=len(bat))
        flag = np.where(times[sgroup] > 1, FULL, 0)
        many = kinds[bgroup] > 1
        flag[sat] |= np.where(many[sat], DETAIL, 0)
        mark = flag > 0
        yield from _doc_rows(k0, k1, doc[mark], p0[mark], n[mark], rel[mark], flag[mark], parts)
        one = (flag[bat] & FULL) | np.where(many[bat], DETAIL, 0)
        packed = (rel[bat].astype("u4") << 17) | (n[bat].astype("u4") << 2) | one.astype("u4")
        yield from _entry_rows(list(core.by_part(core.pair(b0[bat], b1[bat]), [b0[bat], b1[bat], s[bat], k0[doc[bat]], k1[doc[bat]].astype("u2"), p0[bat].astype("u4"), packed], parts, False)))

    def run(batches):
        k0s, k1s, found, held, base = [], [], [], 0, 0
        for batch in batches:
            buf, off = core.text_buffer(batch.column("text"))
            marks = batch.column("marks") if "marks" in batch.schema.names else None
            k0s.append(batch.column("k0").to_numpy(zero_copy_only=False))
            k1s.append(batch.column("k1").to_numpy(zero_copy_only=False))
            for i, j in core.runs(off):
                x, bounds = finder.units(buf, off[i : j + 1])
                maybe = None if marks is None else _maybe([marks[k] for k in range(i, j)], bounds)
                for part, own, at, shift in finder.pieces(x, bounds):
                    here = None if maybe is None else maybe[at : at + len(part)].copy()
                    if here is not None and len(part) < len(x):
                        here[2 * core.BLOCK :] = False  # the next part's
                    got = finder.anchors(part, own, q, here)
                    if got:
                        doc, p0, n, rel, b0, b1, s = got
                        found.append(((doc + i + base).astype(np.int32), (p0 + shift).astype(np.int32), n.astype(np.int32), rel.astype(np.int32), b0, b1, s))
                        held += len(s)
            base += batch.num_rows
            if held > GATHER:
                yield from settle(np.concatenate(k0s), np.concatenate(k1s), found)
                k0s, k1s, found, held, base = [], [], [], 0, 0
        if found:
            yield from settle(np.concatenate(k0s), np.concatenate(k1s), found)

    return run


MARKS = "k0 long, k1 int, payload binary"


def _marks(k0, k1, p0, n, rel, flag) -> Iterator[pa.RecordBatch]:
    if len(k0):
        order = np.lexsort((k1, k0))
        k0, k1, p0, n, rel, flag = (c[order] for c in (k0, k1, p0, n, rel, flag))
        new = np.ones(len(k0), bool)
        new[1:] = (k0[1:] != k0[:-1]) | (k1[1:] != k1[:-1])
        at = np.flatnonzero(new)
        own, payload = _lists(np.cumsum(new) - 1, p0, n, rel, flag)
        yield from core.rows_of({"k0": (pa.int64(), k0[at][own]), "k1": (pa.int32(), k1[at][own].astype(np.int32)), "payload": (pa.binary(), payload)})


def _split_rows(batches):
    """Rows of a part: its documents' marks are passed on, the packed entries returned in the end."""
    held = []
    for batch in batches:
        kind = batch.column("kind").to_numpy(zero_copy_only=False)
        own = batch.filter(pa.array(kind == 0))
        if own.num_rows:
            yield own.select(["k0", "k1", "payload"])
        held += batch.column("payload").filter(pa.array(kind == 1)).to_pylist()
    return held


def _compare_anchors(last: bool):
    """All tasks' entries of a bucket side by side."""

    def candidates(held):
        b0, b1, k0, k1, p0, n, had = core.merged(held, _MAYBE_ENTRY)
        if not len(b0):
            return
        order = np.lexsort((b1, b0))
        at, group = core.groups2(b0[order], b1[order])
        shared = np.empty(len(b0), bool)
        shared[order] = (np.diff(np.r_[at, len(b0)]) > 1)[group]
        mark = shared & (had == 0)
        zero = np.zeros(int(mark.sum()), np.int64)
        yield from _marks(k0[mark], k1[mark].astype(np.int32), p0[mark], n[mark], zero, zero + MAYBE)

    def run(batches):
        held = yield from _split_rows(batches)
        if not last:
            yield from candidates(held)
            return
        b0, b1, s, k0, k1, p0, nf = core.merged(held, _ENTRY)
        if not len(b0):
            return
        order = np.lexsort((s, b1, b0))
        at, group = core.groups2(b0[order], b1[order])
        shared = np.diff(np.r_[at, len(b0)])[group] > 1
        order = order[shared]
        if not len(order):
            return
        b0, b1, s, k0, k1, p0, nf = (c[order] for c in (b0, b1, s, k0, k1, p0, nf))
        rel, n, had, many = nf >> 17, (nf >> 2) & 0x7FFF, (nf & FULL) > 0, (nf & DETAIL) > 0
        at, group = core.groups2(b0, b1)
        new = np.ones(len(s), bool)
        new[1:] = (group[1:] != group[:-1]) | (s[1:] != s[:-1])
        sat, sgroup = np.flatnonzero(new), np.cumsum(new) - 1
        times = np.diff(np.r_[sat, len(s)])[sgroup]
        mixed = (np.bincount(group[sat], minlength=len(at)) > 1) | (np.maximum.reduceat(many.astype(np.int8), at) > 0)
        flag = np.where((times > 1) & ~had, FULL, 0)
        # in a mixed bucket one representative of each stretch is looked at window by window;
        # tasks with several stretches in it have sent theirs already
        first = np.full(len(sat), len(s))
        np.minimum.at(first, sgroup, np.where(many, len(s), np.arange(len(s))))
        first = first[first < len(s)]
        flag[first] |= np.where(mixed[group[first]], DETAIL, 0)
        mark = flag > 0
        yield from _marks(k0[mark], k1[mark].astype(np.int32), p0[mark], n[mark], rel[mark], flag[mark])

    return run


def _explode(finder: Finder, parts: int):
    """The table of the last level: windows of open stretches; repeats within the task are settled here.

    Equal windows have equal anchors at equal distances, so windows travel in sixteens of
    neighbours, in the bucket of their anchor and distance, with one reference to their document.
    """
    W, q = finder.window, finder.levels[-1]

    def settle(k0, k1, found):
        doc, p, w, key, bit = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((w, key))
        at, group = core.groups2(key[order], w[order])
        twice = np.empty(len(w), bool)
        twice[order] = (np.diff(np.r_[at, len(w)]) > 1)[group]
        n = int(twice.sum())
        zero = np.zeros(n, np.int64)
        yield from _doc_rows(k0, k1, doc[twice], p[twice], zero + 1, zero, zero + FULL, parts)
        one = np.zeros(len(w), bool)
        one[order[at]] = True
        doc, p, w, key, bit, twice = (x[one] for x in (doc, p, w, key, bit, twice))
        base = p - bit
        new = np.ones(len(w), bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (base[1:] != base[:-1])
        at = np.flatnonzero(new)
        count = np.diff(np.r_[at, len(w)])
        mask = np.add.reduceat(1 << bit, at)
        done = np.add.reduceat(twice << bit, at)
        part = core.part_of(key[at], parts)
        order = np.argsort(part, kind="stable")
        cut = np.flatnonzero(np.diff(part[order])) + 1
        rows = []
        for x in np.split(order, cut):
            own = core.pack(key[at[x]], k0[doc[at[x]]], k1[doc[at[x]]].astype("u2"), base[at[x]].astype("i4"), mask[x].astype("u2"), done[x].astype("u2"))
            rows.append((int(part[x[0]]), own + core.pack(w[core.ranges(at[x], count[x])])))
        yield from _entry_rows(rows)

    def run(batches):
        k0s, k1s, found, held, base = [], [], [], 0, 0
        for batch in batches:
            buf, off = core.text_buffer(batch.column("text"))
            k0s.append(batch.column("k0").to_numpy(zero_copy_only=False))
            k1s.append(batch.column("k1").to_numpy(zero_copy_only=False))
            marks = batch.column("marks")
            for i in range(batch.num_rows):
                p0, n, rel, flag = core.merged([x.as_py() for x in marks[i].values], _STRETCH)
                take = (flag & DETAIL) > 0
                if not take.any():
                    continue
                p0, n, rel = p0[take].astype(np.int64), n[take].astype(np.int64), rel[take].astype(np.int64)
                p, first = np.unique(core.ranges(p0, n), return_index=True)
                r = np.repeat(p0 + rel, n)[first] - p
                x, bounds = finder.units(buf, off[i : i + 2])
                for part, own, _, shift in finder.pieces(x, bounds):
                    here = (p >= shift) & (p + W <= shift + len(part))
                    if len(x) > len(part):
                        here &= p < shift + 2 * core.BLOCK
                    if here.any():
                        _, b0, b1, iw = finder.ids(part, q)
                        ph, rh = p[here], r[here]
                        a = ph + rh - shift
                        key = core.pair(core.pair(b0[a], b1[a]), (rh >> 4).astype(U64))
                        found.append((np.full(len(ph), i + base, np.int32), ph, iw[ph - shift], key, 15 - (rh & 15)))
                        held += len(ph)
            base += batch.num_rows
            if held > GATHER:
                yield from settle(np.concatenate(k0s), np.concatenate(k1s), found)
                k0s, k1s, found, held, base = [], [], [], 0, 0
        if found:
            yield from settle(np.concatenate(k0s), np.concatenate(k1s), found)

    return run


def _compare_windows():
    def run(batches):
        held = yield from _split_rows(batches)
        if not held:
            return
        heads = [core.unpack(x, _SIXTEEN) for x in held]
        size = sum(np.dtype(k).itemsize for k in _SIXTEEN)
        w = np.concatenate([core.unpack(memoryview(x)[8 + size * len(h[0]) :], ["u8"])[0] for x, h in zip(held, heads)])
        key, k0, k1, base, mask, done = (np.concatenate(c) for c in zip(*heads))
        row, bit = np.nonzero((mask[:, None] >> np.arange(16, dtype="u2")) & 1)
        bucket = key[row]
        order = np.lexsort((w, bucket))
        at, group = core.groups2(bucket[order], w[order])
        often = np.empty(len(w), bool)
        often[order] = (np.diff(np.r_[at, len(w)]) > 1)[group]
        often &= ((done[row] >> bit.astype("u2")) & 1) == 0
        row, bit = row[often], bit[often]
        zero = np.zeros(len(row), np.int64)
        yield from _marks(k0[row], k1[row].astype(np.int32), base[row] + bit, zero + 1, zero, zero + FULL)

    return run


def repeated(docs: DataFrame, finder: Finder) -> DataFrame:
    """docs (of core.keyed) with a column ``marks``: packed (first window, windows, flag) lists, FULL ones repeated."""
    parts = core.parts_for(docs)
    rows = docs.select("k0", "k1", "text")
    # the same columns in all joins: the texts are shuffled once, and that exchange is used again
    for q in finder.levels:
        sent = rows.mapInArrow(_gather(finder, q, parts), PASS1)
        found = sent.repartitionById(parts, F.col("part")).mapInArrow(_compare_anchors(q == finder.levels[-1]), MARKS)
        if q == finder.levels[0] or q == finder.levels[-1]:
            found = core.materialise(found)
        rows = docs.join(found.groupBy("k0", "k1").agg(F.collect_list("payload").alias("marks")), ["k0", "k1"])
    sent = rows.mapInArrow(_explode(finder, parts), PASS1)
    second = sent.repartitionById(parts, F.col("part")).mapInArrow(_compare_windows(), MARKS)
    both = found.unionByName(second).groupBy("k0", "k1").agg(F.collect_list("payload").alias("marks"))
    return docs.join(both, ["k0", "k1"], "left")


def removed(marks, n: int, window: int) -> np.ndarray:
    """Mask of the units of one document that repeated windows cover."""
    edge = np.zeros(n + 1, np.int64)
    if marks is not None:
        p0, count, _, flag = core.merged([x.as_py() for x in marks], _STRETCH)
        full = (flag & FULL) > 0
        p0, count = p0[full].astype(np.int64), count[full].astype(np.int64)
        np.add.at(edge, p0, 1)
        np.add.at(edge, np.minimum(p0 + count - 1 + window, n), -1)
    return np.cumsum(edge[:-1]) > 0

import random
import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from folioforge.llm import core, decontam, linededup, minhash, registry, substring

from ..conftest import DATA
from .common import corpus, frame, key


def edits(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_banded_distance(k):
    a, b = [], []
    for seed in range(800):
        r = random.Random(seed * 7 + k)
        x = bytes(r.choice(b"ab" if seed % 2 else b"abcdef") for _ in range(r.randint(0, 30)))
        y = bytearray(x)
        for _ in range(r.randint(0, k + 2)):
            how, i = r.randrange(3), r.randrange(len(y) + 1)
            if how == 0:
                y.insert(i, r.choice(b"abc"))
            elif y and how == 1:
                del y[min(i, len(y) - 1)]
            elif y:
                y[min(i, len(y) - 1)] = r.choice(b"abc")
        a.append(x)
        b.append(bytes(y))
    assert linededup.within(a, b, k).tolist() == [edits(x, y) <= k for x, y in zip(a, b)]


def brute(rows, k, least):
    """Equal lines are a class if they are long or not blank; long ones within k edits too."""
    counts = lambda x: len(x.encode()) >= least or x.strip(" \t\n\x0b\x0c\r") != ""
    lines = [(d is None, d, t or "", n, x) for d, t in rows for n, x in enumerate((t or "").split("\n")) if counts(x)]
    texts = sorted({x for *_, x in lines if len(x.encode()) >= least})
    up = {x: x for *_, x in lines}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, x in enumerate(texts):
        for y in texts[:i]:
            if abs(len(x.encode()) - len(y.encode())) <= k and edits(x.encode(), y.encode()) <= k:
                up[root(x)] = root(y)
    first = {}
    for none, d, t, n, x in lines:
        c = root(x)
        if c not in first or (none, d or 0, n) < first[c]:
            first[c] = (none, d or 0, n)
    out = []
    for d, t in rows:
        gone = []
        for n, x in enumerate((t or "").split("\n")):
            if counts(x):
                f = first[root(x)]
                if f != (d is None, d or 0, n):
                    gone.append((n, f))
        out.append((d, len((t or "").split("\n")), len(gone), ",".join(f"{n}>{'' if f[0] else f[1]}:{f[2]}" for n, f in gone), "\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in {g[0] for g in gone})))
    return sorted(out, key=key)


@pytest.mark.parametrize("k", [1, 2])
def test_against_brute_force(spark, k):
    r = random.Random(k)
    bases = ["".join(r.choice("abcdé ") for _ in range(24)) for _ in range(6)]
    rows = []
    for i in range(60):
        own = []
        for _ in range(r.randint(0, 5)):
            x = list(r.choice(bases))
            for _ in range(r.choice([0, 1, 2, 3, 4])):
                p = r.randrange(len(x))
                x[p : p + r.randint(0, 1)] = r.choice(["", "x", "y"])
            own.append("".join(x))
        rows.append((i, "\n".join(own)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (3, rows[3][1]), (103, rows[4][1] + "\n" + rows[4][1])]
    got = linededup.dedup_lines(frame(spark, rows).repartition(5), k, 12)
    assert sorted(map(tuple, got.collect()), key=key) == brute(rows, k, 12)


def test_edges(spark):
    assert linededup.dedup_lines(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        linededup.dedup_lines(frame(spark, []), 2, 2)
    rows = corpus(7) + [(None, "the same line of a text without an id, long enough"), (200, "the same line of a text without an id, long enough!")]
    got = {r["doc_id"]: r for r in linededup.dedup_lines(frame(spark, rows)).collect() if r["text"].startswith("the same") or r["n_removed"]}
    assert got[None]["n_removed"] == 1 and got[200]["n_removed"] == 0


def test_short_lines_are_compared_for_equality(spark):
    long = "a line that is long enough to be compared by edits, this one"
    rows = [(1, "Les.\n\nab\n" + long), (2, "Les.\n\nLes.\nac\n  \n  "), (3, "ab \nab\nLez.\n" + long + "!"), (4, "Les.\n\nab\n" + long), (None, "ac\n\t\n")]
    got = {r["doc_id"]: (r["n_removed"], r["removed"], r["text"]) for r in linededup.dedup_lines(frame(spark, rows).repartition(3)).collect()}
    assert got == {
        1: (0, "", rows[0][1]),
        2: (2, "0>1:0,2>1:0", "\nac\n  \n  "),
        3: (2, "1>1:2,3>1:3", "ab \nLez."),
        4: (3, "0>1:0,2>1:2,3>1:3", ""),
        None: (1, "0>2:3", "\t\n"),
    }


def test_query_equals_its_sql(spark):
    folder = f"{DATA}/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.execute("SELECT doc_id, n_lines, n_removed, removed FROM (" + registry.SQL["op2_line_dedup"] + ")").fetchall()
    assert sorted(want) == sorted(map(tuple, registry.op2_line_dedup(spark, folder).collect()))


def hot_lines(n, seed=1):
    """Lines that all begin alike and end apart, some with a copy by one edit and some alike at both ends."""
    r = random.Random(seed)
    lines = []
    for i in range(n):
        own = "".join(r.choice("abcdefghij") for _ in range(26))
        lines.append("2024-01-01T00:00:00 host app " + own)
        if i % 10 == 0:
            lines.append(lines[-1][:40] + "#" + lines[-1][41:])
        if i % 10 == 1:
            lines.append("2024-01-01T00:00:00 host app " + own[:14] + " and the same end of the line")
    return lines


@pytest.mark.parametrize("k", [1, 2])
def test_hot_segments_against_brute_force(spark, k):
    rows = [(i, x) for i, x in enumerate(hot_lines(60))]
    r = random.Random(9)
    rows += [(1000 + i, "prefix of a line " + "".join(r.choice("ab") for _ in range(r.randint(1, 9)))) for i in range(60)]
    got = linededup.dedup_lines(frame(spark, rows).repartition(5), k, 12)
    assert sorted(map(tuple, got.collect()), key=key) == brute(rows, k, 12)


def test_hot_segments_cost_in_proportion(spark, monkeypatch):
    tried = []
    real = linededup.confirmed
    monkeypatch.setattr(linededup, "confirmed", lambda pairs, *a: tried.append(pairs.count()) or real(pairs, *a))
    totals = []
    for n in (2500, 10_000):
        tried.clear()
        got = linededup.dedup_lines(frame(spark, list(enumerate(hot_lines(n)))), with_text=False)
        assert got.where("n_removed > 0").count() == n // 10
        totals.append(sum(tried))
    assert totals[1] < 6 * totals[0] and totals[1] < 120_000, totals


def test_a_task_has_one_worker(spark, monkeypatch):
    """No Python operator reads another's rows within a task: each of them would have a worker of its own."""
    plans, real = [], core.materialise
    monkeypatch.setattr(core, "materialise", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df))
    linededup.dedup_lines(frame(spark, list(enumerate(hot_lines(60)))), with_text=False)
    assert any("role" in x and "MapInArrow" in x for x in plans)
    assert not [x for x in plans if re.search(r"MapInArrow.*\n(?:[\s:+-]*(?:Project|Filter).*\n)*[\s:+-]*MapInArrow", x)]


def test_lean_gives_freed_memory_back():
    def used():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4 // 1024

    held = []

    def run(batches):
        blocks = [np.ones(100_000, np.uint8) for _ in range(2000)]  # below what malloc maps by itself
        held.append(np.ones(100_000, np.uint8))  # nothing before it leaves the heap by its end
        yield used()
        del blocks

    before = used()
    top, *_ = core.lean(run)(iter(()))
    assert top > before + 150
    assert used() < before + 100


def test_pipeline_drops_copies_of_short_lines(spark):
    rows = [(1, "Les.\n\nab\n\ncd"), (2, "Les.\n\nab\n\ncd"), (3, ""), (4, " \n "), (5, "ef\nLes.")]
    got = corpus_pipeline.drop_lines(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(map(tuple, got)) == [rows[0], *rows[2:4], (5, "ef")]


def test_ids_beside_a_long_string():
    """An id depends on its string alone, whatever its neighbours are."""
    r = random.Random(3)
    strings = [bytes(r.choice(b"abc") for _ in range(n)) for n in (5, 60, 0, 7)]
    strings += [b"x" * core.BLOCK, b"y" * (core.BLOCK + 1), b"z" * 300_000, strings[1], b"q" * 600_000, strings[0], b"y" * (core.BLOCK + 1), b"z" * 300_000, b"x" * core.BLOCK, strings[3]]
    size = np.array([len(x) for x in strings])
    end = np.cumsum(size + 1) - 1
    got = core.span_ids(np.frombuffer(b"\n".join(strings), np.uint8), end - size, end)
    alone = [int(core.span_ids(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))[0]) for x in strings]
    assert got.tolist() == alone
    assert len(set(alone)) == len(set(strings))


def test_lines_before_a_very_long_one(spark):
    """Lines, words and benchmark passages beside a text of one line of over 512 KB."""
    r = random.Random(4)
    line = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(12))
    own = [line() for _ in range(4)]
    rows = [(1, "\n".join(own)), (2, "o" * 600_000), (3, own[0] + "\n" + own[1][:-1] + "!"), (4, "o" * 600_000), (5, own[2] + "x\nend")]
    docs = frame(spark, rows).coalesce(1)
    got = {x["doc_id"]: x["removed"] for x in linededup.dedup_lines(docs, with_text=False).collect()}
    assert got == {1: "", 2: "", 3: "0>1:0,1>1:1", 4: "0>2:0", 5: "0>1:2"}
    rows = [(1, own[0] + " " + own[1]), (2, "o" * 600_000), (3, own[0] + " " + own[1]), (4, own[2])]
    docs = frame(spark, rows).coalesce(1)
    bench = spark.createDataFrame([(1, own[0]), (2, own[2])], "item_id long, text string")
    assert {x["doc_id"]: x["contaminated"] for x in decontam.digest(decontam.contamination(docs, bench)).collect()} == {1: True, 2: False, 3: True, 4: True}
    assert {x["doc_id"]: x["kept"] for x in minhash.near_duplicates(docs).collect()} == {1: True, 2: True, 3: False, 4: True}
    assert {x["doc_id"]: x["n_removed"] for x in substring.dedup_word_windows(docs, 12, with_text=False).collect()} == {1: 24, 2: 0, 3: 24, 4: 0}


def test_ids_of_one_buffer():
    """span_ids_of gives the identifiers of span_ids, within and above the size of its prefix sums."""
    r = np.random.default_rng(5)
    for n in (1, 50, 300_000, 2 * core.BLOCK, 2 * core.BLOCK + 1):
        buf = r.integers(97, 100, n).astype(np.uint8)
        s = np.sort(np.r_[0, n, r.integers(0, n + 1, 200)])
        e = np.minimum(n, s + r.integers(0, 90, len(s)))
        ids = core.span_ids_of(buf)
        assert ids(s, e).tolist() == core.span_ids(buf, s, e).tolist()
        e[:3] = n  # over BLOCK bytes in the larger buffers
        assert ids(s, e).tolist() == core.span_ids(buf, s, e).tolist()
        assert ids(s[:0], e[:0]).tolist() == []


def test_a_bucket_has_one_pivot():
    """_stars against a slow version: rows in any order, repeated ones too."""
    r = random.Random(6)
    rows = [(r.randrange(40), r.randrange(12), r.randrange(2)) for _ in range(300)] + [(100 + i, i % 7, i % 2) for i in range(50)]
    r.shuffle(rows)
    key, node, role = (np.array(c) for c in zip(*rows))
    at, key, node, role, rest, pivot = linededup._stars(key.astype(np.uint64), node, role)
    heads = {k: min((1 - c, b) for a, b, c in rows if a == k) for k in {a for a, _, _ in rows}}
    assert {int(key[i]): (1 - int(role[i]), int(node[i])) for i in at} == heads and len(at) == len(heads)
    assert {(int(a), int(b)) for a, b in zip(key, node)} == {(a, b) for a, b, _ in rows}
    assert node[pivot].tolist() == [heads[int(k)][1] for k in key[rest]]


def test_a_task_hashes_its_text_once(monkeypatch):
    """All segments of a block of text come from one pass over its bytes, and a line met again sends nothing."""

    class Counted:
        def __init__(self, table):
            self.table, self.bytes = table, 0

        def __getitem__(self, at):
            self.bytes += len(at)
            return self.table[at]

    r = random.Random(8)
    texts = ["\n".join("".join(r.choice("abcdefgh ") for _ in range(60)) for _ in range(40)) for _ in range(250)]
    some = [linededup.pa.RecordBatch.from_arrays([linededup.pa.array(x)], names=["text"]) for x in (texts, texts[::-1])]
    send = lambda batches: sorted((b["part"][0].as_py(), len(b["payload"][0].as_py())) for b in linededup._send(40, 2, 4)(iter(batches)) if b["payload"][0].is_valid)
    counted = Counted(core._tables()["table"])
    monkeypatch.setitem(core._tables(), "table", counted)
    once = send(some[:1])
    assert once and counted.bytes <= sum(len(x) for x in texts)
    assert send(some) == once

"""Toxicity scores (operator 9).

A linear classifier over character n-grams, whose features log(1 + count) are scaled by naive Bayes
log-count ratios before logistic regression learns their weights.  Features are hashed into
a table of fixed size, so the model is small whatever the corpus.  Texts are scored whole, a part of bounded size at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import core
from .core import U64

BITS = 19
#: Characters of the n-grams.
ORDERS = (3, 5, 7)
#: Most labelled rows that a fit uses; of more, those with the least hashes.
FIT_ROWS = 6_000
#: Most n-grams that get a weight.
MOST = 20_000
#: Characters that grams works on at once.
STEP = 1 << 17


def grams(text: str, orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed ids of a text's character n-grams and their counts, in lower case, ASCII white space as one blank at either end."""
    text = f" {text.lower()} "
    ids, counts = np.zeros(0, np.int32), np.zeros(0, np.int64)
    for first in range(0, len(text), STEP):
        x = np.frombuffer(text[first : first + STEP + max(orders) - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
        x[(x >= U64(0x09)) & (x <= U64(0x0D))] = 0x20
        at, n, got = core.mix(x + U64(1)), 1, []
        for order in orders:
            while n < order:
                to = min(2 * n, order)
                step = to - n
                at = core.pair(at[:-step], at[step:]) if len(at) > step else at[:0]
                n = to
            got.append((core.mix(at[:STEP] ^ U64(order)) >> U64(64 - bits)).astype(np.int32))
        own, times = np.unique(np.concatenate(got), return_counts=True)
        if first:
            own, at = np.unique(np.concatenate((ids, own)), return_inverse=True)
            times = np.bincount(at, np.concatenate((counts, times))).astype(np.int64)
        ids, counts = own, times
    return ids, counts


@dataclass
class Model:
    """weights: of every n-gram id, log-count ratio included."""

    weights: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        ids, counts = grams(text)
        z = self.bias + float((self.weights[ids] * np.log1p(counts)).sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit(features: list, labels: np.ndarray, chosen: np.ndarray, ratio: np.ndarray, bits: int = BITS, penalty: float = 1.0, rounds: int = 400) -> Model:
    """Logistic regression on log(1 + count) x log-count ratio of the chosen n-grams, by accelerated gradient descent.

    features: ids and counts of each row's chosen n-grams.  Without both labels the score is the smoothed share of label 1.
    """
    y = np.asarray(labels, np.float64)
    zero = np.zeros(1 << bits, np.float32)
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    if not len(y) or y.min() == y.max() or not len(chosen):
        return Model(zero, float(np.log(share / (1 - share))))
    place = np.full(1 << bits, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    flat, row = np.concatenate([place[f] for f, _ in features]), np.repeat(np.arange(len(y)), [len(f) for f, _ in features])
    value = ratio[flat] * np.log1p(np.concatenate([k for _, k in features]))
    m = len(chosen)
    # rows of the rarer label weigh more, by the root of how much rarer it is
    rare = np.sqrt((len(y) - y.sum()) / y.sum())
    weight = np.where(y == 1, max(rare, 1.0), max(1 / rare, 1.0))
    times = lambda w: np.bincount(row, weights=w[flat] * value, minlength=len(y)) + w[m]
    back = lambda e: np.r_[np.bincount(flat, weights=e[row] * value, minlength=m), e.sum()]
    x = np.ones(m + 1)
    for _ in range(12):  # the greatest eigenvalue bounds the step
        x = back(weight * times(x))
        top = np.linalg.norm(x)
        x /= top
    shrink = np.r_[np.full(m, penalty), 0.0]
    step = 1 / (0.3 * top + penalty)
    w = np.zeros(m + 1)
    w[m] = np.log(share / (1 - share))
    v, t = w.copy(), 1.0
    for _ in range(rounds):
        e = weight * (1 / (1 + np.exp(-np.clip(times(v), -40, 40))) - y)
        new = v - step * (back(e) + shrink * v)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    zero[chosen] = w[:m] * ratio
    return Model(zero, float(w[m]))


def _count(batches):
    """Rows of either label with each n-gram, by task."""
    table = np.zeros((2, 1 << BITS), np.int32)
    for batch in batches:
        for k, y in enumerate(batch.column("y").to_pylist()):
            table[y][grams(batch.column("text")[k].as_py())[0]] += 1
    ids = np.flatnonzero(table.any(axis=0))
    for i in range(0, len(ids), 50_000):
        c = ids[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(table[1][c]), pa.array(table[0][c])], names=["gram", "p", "q"])


def _restrict(shared):
    def run(batches):
        keep = np.zeros(1 << BITS, bool)
        keep[shared.value] = True
        for batch in batches:
            out = []
            for x in batch.column("text"):
                ids, counts = grams(x.as_py())
                out.append(core.pack(ids[keep[ids]].astype(np.int32), counts[keep[ids]]))
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(out, pa.binary())], names=["y", "ids"])

    return run


def learn(texts: DataFrame, rows: int = FIT_ROWS, smooth: float = 0.5) -> Model:
    """Fits texts (key, text, y with y 0 or 1), one row a key; of more than ``rows`` those with the least key hashes are used.

    Counts and the choice of n-grams are aggregates over the sample; the driver gets at most
    MOST counts and the chosen n-grams of the sample's rows.
    """
    spark = texts.sparkSession
    sample = core.materialise(texts.orderBy(F.xxhash64("key"), "key").limit(rows))
    total = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = total.get(1, 0), total.get(0, 0)
    counts = sample.select("text", "y").mapInArrow(core.lean(_count), "gram int, p int, q int").groupBy("gram").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    chosen, ratio = np.zeros(0, np.int64), np.zeros(0)
    if n1 and n0:
        both = (F.col("p") + F.col("q")) / (n1 + n0)
        z = (F.col("p") / n1 - F.col("q") / n0) / F.sqrt(F.greatest(both * (1 - both), F.lit(1e-9)) * (1 / n1 + 1 / n0))
        best = counts.where(F.col("p") + F.col("q") >= 3).withColumn("z", F.abs(z)).where("z >= 4").orderBy(F.desc("z"), "gram").limit(MOST).collect()
        best.sort(key=lambda r: r["gram"])
        chosen = np.array([r["gram"] for r in best], np.int64)
        p, q = (np.array([r[c] for r in best], np.float64) for c in "pq")
        ratio = np.log((p + smooth) / (n1 + 2 * smooth) / ((q + smooth) / (n0 + 2 * smooth)))
    got = sample.select("text", "y").mapInArrow(core.lean(_restrict(spark.sparkContext.broadcast(chosen))), "y int, ids binary").collect() if len(chosen) else []
    if not got:
        got = [{"y": y, "ids": core.pack(np.zeros(0, np.int32), np.zeros(0, np.int64))} for y, n in total.items() for _ in range(n)]
    got.sort(key=lambda r: (bytes(r["ids"]), r["y"]))  # the order of rows doesn't change the model
    return fit([core.unpack(r["ids"], ["i4", "i8"]) for r in got], np.array([r["y"] for r in got]), chosen, ratio)


def held_out(key):
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Model of the labelled documents that aren't held out.

    Of several labels of an id the greatest counts, of several texts the one of the least hash, so
    that at most ``rows`` rows are fitted whatever repeats.
    """
    y = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("key")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    # ids without a document take no place; both tables' ids are joined before the bound is applied
    known = docs.select(F.col(id_col).alias("key")).where("key is not null")
    sample = known.join(y, "key").groupBy("key").agg(F.max("y").alias("y")).orderBy(F.xxhash64("key"), "key").limit(rows)  # its size is bounded: it is broadcast
    text = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    chosen = text.join(F.broadcast(core.materialise(sample)), "key").withColumn("nth", F.row_number().over(W.partitionBy("key").orderBy(F.xxhash64("text"), "text")))
    return learn(chosen.where("nth = 1").select("key", "text", "y"), rows)


def _score(shared, schema: pa.Schema):
    def run(batches):
        model = shared.value
        for batch in batches:
            score = [model.score(x.as_py() or "") for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(score, pa.float64()) if f.name == "score" else batch.column(f.name).cast(f.type) for f in schema], schema=schema)

    return run


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with ``score`` (0 to 1, of the whole text); all columns stay, one named score is replaced.

    Null and empty texts get the score of a text without known n-grams.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    docs = docs.drop("score")
    if text_col != "text":
        docs = docs.drop("text").withColumnRenamed(text_col, "text")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    out = docs.mapInArrow(core.lean(_score(spark.sparkContext.broadcast(model), to_arrow_schema(schema))), schema)
    return out if text_col == "text" else out.withColumnRenamed("text", text_col)


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Null texts count as empty; a null id isn't held out; repeated rows are scored alike.  With no
    labelled rows, or one label only, all scores are its smoothed share.  Other columns are ignored.
    """
    model = train(docs, labels, rows, id_col, text_col)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = scored(source, model)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

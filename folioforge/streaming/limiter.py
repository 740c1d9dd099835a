"""Fixed-window rate limiting, anchored at a key's first request, as a batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Budget:
    """State of one key: when its window ends and how many requests it has let through."""

    def __init__(self, limit: int, micros: int, reset: int = -(1 << 62), used: int = 0):
        self.limit, self.micros, self.reset, self.used = limit, micros, reset, used

    def allow(self, at: int) -> bool:
        if at >= self.reset:
            self.reset, self.used = at + self.micros, 1
            return True
        if self.used >= self.limit:
            return False
        self.used += 1
        return True


def limited(requests: DataFrame, key: str, limit: int = 60, seconds: int = 60, order: str = "event_id", ts: str = "ts") -> DataFrame:
    """requests' (key, order, allowed), decided in time order.

    Rows are spread by key and sorted, and each key's state is three numbers carried along the
    sorted partition: however many requests a key has, they are streamed, never gathered.
    """
    names = (key, order)
    rows = requests.select(key, order, F.unix_micros(F.col(ts).cast("timestamp")).alias("_at"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine, state = object(), None
        for pdf in frames:
            out = []
            for k, at in zip(pdf[key], pdf["_at"]):
                if state is None or k != mine:
                    mine, state = k, Budget(limit, seconds * 1_000_000)
                out.append(state.allow(int(at)))
            yield pdf.assign(allowed=out)[[*names, "allowed"]]

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names) + ", allowed boolean"
    return rows.repartition(key).sortWithinPartitions(key, "_at", order).mapInPandas(run, schema)


def limited_stream(requests: DataFrame, key: str, limit: int = 60, seconds: int = 60, order: str = "event_id", ts: str = "ts") -> DataFrame:
    """The same decisions over a stream; a key's state lives in the state store between batches.

    Requests are decided in time order within a batch; one that comes late is decided when it comes.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    kind = requests.schema[key].dataType.simpleString()
    rows = requests.select(key, order, F.unix_micros(F.col(ts).cast("timestamp")).alias("_at"))

    def step(k, frames, state):
        b = Budget(limit, seconds * 1_000_000, *(state.get if state.exists else ()))
        pdf = pd.concat(list(frames)).sort_values(["_at", order])
        allowed = [b.allow(int(at)) for at in pdf["_at"]]
        state.update((b.reset, b.used))
        yield pd.DataFrame({key: k[0], order: pdf[order].to_numpy(), "allowed": allowed})

    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {order} {rows.schema[order].dataType.simpleString()}, allowed boolean", "reset long, used long", "append", GroupStateTimeout.NoTimeout)

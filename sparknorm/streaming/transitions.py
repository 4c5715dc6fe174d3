"""Changes from each window's graph to the next, on a stream.

The state of a key is the last weight of each of its edges and the windows that
the watermark has not passed. A timer at each window's end takes it in order,
so late rows within the watermark still count and the result is that of
``graph.changes`` on the whole table, whatever the micro-batches and restarts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sparknorm.functions.contract import EPS


class Transitions(StatefulProcessor):
    def __init__(self, names: Sequence[str], order: str):
        self.names, self.order = list(names), order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getMapState("last", "a long, b long", "w double")
        self.waiting = handle.getListState("waiting", "at long, a long, b long, w double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            at = pdf[self.order].astype("datetime64[us]").astype("int64")
            # a timer has whole milliseconds: rounded up, so that it never comes before its window
            for t in np.unique(-(-at // 1000)).tolist():
                self.handle.registerTimer(t)
            self.waiting.appendList(list(zip(at.tolist(), pdf["a"].tolist(), pdf["b"].tolist(), pdf["w"].tolist(), strict=True)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        held = list(self.waiting.get())
        due = sorted(r for r in held if r[0] <= now)
        if not due:
            return
        left = [tuple(r) for r in held if r[0] > now]
        out = []
        for at in sorted({r[0] for r in due}):
            step = power = 0.0
            met = False
            for _, a, b, w in (r for r in due if r[0] == at):
                if self.last.containsKey((a, b)):
                    (before,) = self.last.getValue((a, b))
                    step, power, met = step + (w - before) ** 2, power + before * before, True
                self.last.updateValue((a, b), (w,))
            if met:
                out.append((*key, pd.Timestamp(at, unit="us"), step**0.5 / (power**0.5 + EPS / 2**0.5)))
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        if out:
            yield pd.DataFrame(out, columns=[*self.names, self.order, "delta"])

    def close(self) -> None:
        pass


def changes(edges: DataFrame, keys: Sequence[str], order: str, late: str = "10 minutes") -> DataFrame:
    """keys, order, delta of a stream of edges (keys, order, a, b, w), as ``graph.changes`` gives them.

    ``order`` is a timestamp; an edge stands once a window. Rows later than the
    watermark are dropped, null weights and orders as well. Needs the RocksDB
    state store (spark.sql.streaming.stateStore.providerClass).
    """
    rows = edges.select(*keys, order, edges["a"].cast("long").alias("a"), edges["b"].cast("long").alias("b"), edges["w"].cast("double").alias("w"))
    rows = rows.where(f"w is not null and {order} is not null").withWatermark(order, late)
    types = ", ".join(f"`{k}` {edges.schema[k].dataType.simpleString()}" for k in keys)
    return rows.groupBy(*keys).transformWithStateInPandas(Transitions(keys, order), f"{types}, `{order}` timestamp, delta double", "Append", "EventTime")

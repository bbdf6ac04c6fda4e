"""Events of tasks as a stream: numbered as they come, held within a bound, replayed to readers, forgotten after the end.

One stateful operator does it by task, with Spark's own state and timers: a number for each event, the last events as
a list in the state, and for a reader that has seen some of them the rest, with a mark where what it missed is gone.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from steelyard.streaming.events import HISTORY, TERMINAL

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How long an ended task is kept for readers that come back, and how late rows may be.
KEPT_MS, LATE = 24 * 3600 * 1000, "1 day"
OUT = "task string, reader string, seq long, type string, kind string"
COLUMNS = ["task", "reader", "seq", "type", "kind"]


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The store of states that lists and timers need, for streams that are started inside."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


class Channel(StatefulProcessor):
    """A task's events. The list in the state is cut when it is twice as long as what is held for readers."""

    def __init__(self, history: int, terminal: tuple[str, ...], kept_ms: int):
        self.history, self.terminal, self.kept_ms = history, terminal, kept_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "seq long, listed long")
        self.held = handle.getListState("held", "seq long, type string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        came = pd.concat(list(rows))
        seq, listed = self.at.get() if self.at.exists() else (0, 0)
        events = came[came["reader"].isna()].sort_values(["ts", "n"], kind="stable")
        if len(events):
            types = events["type"].tolist()
            new = list(zip(range(seq + 1, seq + len(types) + 1), types, strict=True))
            seq, listed = seq + len(new), listed + len(new)
            if listed > 2 * self.history:
                old = list(self.held.get()) if len(new) < self.history else []
                kept = [*map(tuple, old), *new][-self.history :]
                self.held.put(kept)
                listed = len(kept)
            else:
                self.held.appendList(new)
            self.at.update((seq, listed))
            ended = events.loc[events["type"].isin(self.terminal), "ts"]
            if self.kept_ms and len(ended):
                self.handle.registerTimer(int(ended.max().timestamp() * 1000) + self.kept_ms)
            yield pd.DataFrame({"task": key[0], "reader": None, "seq": [s for s, _ in new], "type": types, "kind": "published"})[COLUMNS]
        readers = came[came["reader"].notna()]
        if not len(readers) or not seq:
            return
        gone = max(0, seq - self.history)
        held = [(s, t) for s, t in map(tuple, self.held.get()) if s > gone]
        for reader, after in zip(readers["reader"], readers["after"].fillna(0), strict=True):
            rest = [x for x in held if x[0] > after]
            out = ([(gone, None, "truncated")] if after < gone else []) + [(s, t, "event") for s, t in rest]
            if out:
                s, t, k = zip(*out, strict=True)
                yield pd.DataFrame({"task": key[0], "reader": reader, "seq": s, "type": t, "kind": k})[COLUMNS]

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.at.clear()
        self.held.clear()
        yield pd.DataFrame({c: pd.Series(dtype="int64" if c == "seq" else "object") for c in COLUMNS})

    def close(self) -> None:
        pass


def channel(rows: DataFrame, *, history: int = HISTORY, terminal: tuple[str, ...] = TERMINAL, kept_ms: int = KEPT_MS, late: str = LATE) -> DataFrame:
    """``task, reader, seq, type, kind`` of a stream of events and readers.

    ``rows`` has ``task, ts, n, type`` of events, and ``task, ts, reader, after`` of readers, each with nulls for the
    others' columns; ``ts`` is event time, and rows later than ``late`` go. Events get the next numbers of their task in the order of ``ts, n`` and come out as
    ``published``. A reader gets what the task has after the number that it has seen, null for none: ``event`` rows,
    and before them one that is ``truncated``, with the last number that is gone, where it missed some. Events of a
    micro-batch come before its readers. Of a task the last ``history`` events are held; a task that has ended is
    forgotten by a timer once the stream is ``kept_ms`` past the end, and would begin at 1 again. A task's rows of one micro-batch are put in order in memory, so the
    source bounds them. Start the stream inside :func:`state_store`.
    """
    columns = {"task": "string", "ts": "timestamp", "n": "long", "type": "string", "reader": "string", "after": "long"}
    own = rows.select(*[F.col(c).cast(t).alias(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()])
    if kept_ms:
        own = own.withWatermark("ts", late)
    return own.groupBy("task").transformWithStateInPandas(statefulProcessor=Channel(history, terminal, kept_ms), outputStructType=OUT, outputMode="Append", timeMode="EventTime" if kept_ms else "None")

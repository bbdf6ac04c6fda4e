"""Task events: replay from a position, bounded history and legal transitions, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HISTORY = 1000
#: Rows that a checked task gives out at a time.
ROWS = 10_000
TERMINAL = ("task_completed", "task_failed", "task_cancelled")

# Legal steps of tasks and of their steps, from and to.
TASK_STEPS = (("pending", "planning"), ("planning", "running"), ("planning", "failed"), ("running", "awaiting_review"), ("running", "completed"), ("running", "failed"), ("awaiting_review", "running"), ("awaiting_review", "completed"), ("failed", "running"))
STEP_STEPS = (("pending", "running"), ("running", "succeeded"), ("running", "failed"), ("running", "skipped"), ("pending", "skipped"), ("failed", "running"))


def sequenced(events: DataFrame, task: str, order: list[str]) -> DataFrame:
    """Add ``seq``, from 1 in each task."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy(task).orderBy(*order)))


def replay(events: DataFrame, positions: DataFrame, task: str, history: int = HISTORY) -> DataFrame:
    """What a reader that has seen up to ``after`` gets: ``task, seq`` and ``kind``.

    ``events`` has ``task, seq``; only the last ``history`` events of a task are held. Where events between
    the reader's position and the oldest held one are gone, a warning with the seq before the oldest held
    comes first.
    """
    last = events.groupBy(task).agg(F.max("seq").alias("_last"))
    held = events.join(last, task).where(F.col("seq") > F.col("_last") - history)
    rows = held.join(positions, task).where(F.col("seq") > F.col("after")).select(task, "seq", F.lit("event").alias("kind"))
    gone = positions.join(last, task).where(F.col("after") < F.col("_last") - history)
    return rows.unionByName(gone.select(task, (F.col("_last") - history).cast("int").alias("seq"), F.lit("truncated").alias("kind")))


def until_terminal(events: DataFrame, task: str, kind: str = "type", terminal: tuple[str, ...] = TERMINAL) -> DataFrame:
    """Events up to the first terminal one of each task, which closes the stream."""
    ends = events.where(F.col(kind).isin(*terminal)).groupBy(task).agg(F.min("seq").alias("_end"))
    return events.join(ends, task, "left").where(F.col("_end").isNull() | (F.col("seq") <= F.col("_end"))).drop("_end")


def transitions(events: DataFrame, task: str, order: list[str], state: str, legal: tuple[tuple[str, str], ...]) -> DataFrame:
    """Add ``previous`` and ``legal`` to each change of state; the first state of a task is legal."""
    w = Window.partitionBy(task).orderBy(*order)
    pairs = F.array(*[F.lit(f"{a}>{b}") for a, b in legal])
    out = events.withColumn("previous", F.lag(state).over(w))
    return out.withColumn("legal", F.col("previous").isNull() | F.array_contains(pairs, F.concat_ws(">", "previous", state)))


def transition_stream(events: DataFrame, task: str, state: str, legal: tuple[tuple[str, str], ...]) -> DataFrame:
    """The same over a stream whose events of a task come in order of ``seq`` from batch to batch: ``task, seq,
    previous, state, legal``. The last state of each task is kept as Spark state. A shuffle mixes the rows of
    one batch, so a task's seqs and codes of states, 12 bytes an event, are put in order in memory, and rows
    are given out ``ROWS`` at a time. The source's limit of files a batch bounds what that is."""
    allowed = set(legal)

    def of(key: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        names: dict[str | None, int] = {}
        seqs, codes = [], []
        for frame in frames:
            local, seen = pd.factorize(frame["state"], use_na_sentinel=False)
            seqs.append(frame["seq"].to_numpy())
            codes.append(np.array([names.setdefault(None if pd.isna(s) else s, len(names)) for s in seen], dtype=np.int32)[local])
        seq, code = np.concatenate(seqs), np.concatenate(codes)
        order = np.argsort(seq, kind="stable")
        before = kept.get[0] if kept.exists else None
        # a code for each state, the last one for none; which pairs of codes are legal
        last = names.setdefault(before, len(names)) if before is not None else len(names) + 1
        labels = np.array([*names, None, None], dtype=object)
        fits = np.zeros((len(labels), len(labels)), dtype=bool)
        fits[[k for k, s in enumerate(labels) if s is None]] = True
        for a, b in allowed:
            if a in names and b in names:
                fits[names[a], names[b]] = True
        code = code[order]
        earlier = np.concatenate([[last], code[:-1]])
        for at in range(0, len(order), ROWS):
            now, was = code[at : at + ROWS], earlier[at : at + ROWS]
            yield pd.DataFrame({"task": key[0], "seq": seq[order[at : at + ROWS]], "previous": labels[was], "state": labels[now], "legal": fits[was, now]})
        kept.update((labels[code[-1]],))

    rows = events.select(F.col(task).cast("string").alias("task"), F.col("seq").cast("long").alias("seq"), F.col(state).alias("state"))
    return rows.groupBy("task").applyInPandasWithState(of, "task string, seq long, previous string, state string, legal boolean", "state string", "append", GroupStateTimeout.NoTimeout)


def event_counts_stream(events: DataFrame, ts: str, kind: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by window and kind of a stream, with a bound on how late events may be."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")

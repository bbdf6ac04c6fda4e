"""Events of tasks as a stream: several micro-batches, a restart, bounded history, the timer."""

import datetime as dt

import pytest

from steelyard.streaming import bus

ROWS = "task string, ts timestamp, n long, type string, reader string, after long"


@pytest.fixture
def feed(spark, tmp_path):
    """Adds rows as a file and runs the stream over what is new, each time from its checkpoint."""
    state = {"k": 0}

    def run(*batches, **how):
        for rows in batches:
            state["k"] += 1
            df = spark.createDataFrame(rows, ROWS)
            df.coalesce(1).write.parquet(f"{tmp_path}/in/b{state['k']:03d}")
        source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        out = bus.channel(source, history=3, terminal=("done",), **how)
        with bus.state_store(spark):
            q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination()
        return [tuple(r) for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()]

    return run


def event(task, n, kind="step"):
    return (task, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=n), n, kind, None, None)


def reader(task, name, after, day=1):
    return (task, dt.datetime(2024, 1, day), None, None, name, after)


def test_numbers_history_and_restart(feed):
    feed([event("a", 2), event("a", 1), event("b", 1)], [event("a", 3), reader("a", "r1", 1), reader("x", "r0", None)])
    # a restart from the checkpoint goes on with the numbers
    got = feed([event("a", n) for n in range(4, 12)], [reader("a", "r2", 2), reader("a", "r3", None), reader("a", "r4", 9), reader("a", "r5", 11), reader("b", "r6", None)])
    assert sorted(r[2] for r in got if r[0] == "a" and r[4] == "published") == list(range(1, 12))
    by = lambda name: sorted((r[2], r[4]) for r in got if r[1] == name)
    assert by("r1") == [(2, "event"), (3, "event")] and by("r0") == []
    assert by("r2") == by("r3") == [(8, "truncated"), (9, "event"), (10, "event"), (11, "event")]
    assert by("r4") == [(10, "event"), (11, "event")] and by("r5") == [] and by("r6") == [(1, "event")]


def test_ended_tasks_are_forgotten(feed):
    how = {"kept_ms": 3_600_000, "late": "1 hour"}
    feed([event("a", 1), event("a", 2, "done"), event("b", 1)], [reader("a", "soon", 1), reader("b", "soon", None)], **how)
    feed([event("c", 3 * 86400)], **how)  # its last batch, without rows, runs the timer
    got = feed([reader("a", "late", None, 5), reader("b", "late", None, 5)], **how)
    # the timer has passed for the task that ended, not for the other
    assert sorted((r[0], r[1], r[2]) for r in got if r[1]) == [("a", "soon", 2), ("b", "late", 1), ("b", "soon", 1)]

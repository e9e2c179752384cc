"""Streams over several files and batches: state and stored output."""

import pytest
from pyspark.sql import functions as F

from millrace import streaming

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string"


@pytest.fixture
def arriving(spark, tmp_path):
    """A stream of the given lists of events, each a file and a batch, in the order given."""

    def stream(*batches):
        for i, rows in enumerate(batches):
            df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
            df.select("event_id", "ts", "user_id", "event_type").coalesce(1).write.parquet(f"{tmp_path}/in/b={i}")
        raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        return raw.withColumn("ts", F.col("ts").cast("timestamp"))

    return stream


def test_state_keeps_the_newest_event(spark, arriving):
    day = lambda d: f"2024-01-{d:02d} 00:00:00"
    late = [(i, day(i), 1, f"t{i}") for i in range(30, 20, -1)]
    early = [(i, day(i), 1, f"t{i}") for i in range(10, 0, -1)]
    tie = [(31, day(30), 1, "tie"), (32, day(29), 1, "older"), (33, day(31), 1, None), (5, day(1), 2, "b")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        out = streaming.drained(streaming.conversation_state(arriving(late + tie, early)), "update").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    last = {}
    for r in out:
        last[r.user_id] = max(last.get(r.user_id, (0, "")), (r.n, r.last_type))
    assert last == {1: (23, "tie"), 2: (1, "b")}


def test_output_is_stored_in_the_shared_folder(spark, arriving, tmp_path):
    day = lambda d: f"2024-01-{d:02d} 00:00:00"
    shared = spark.conf.get("spark.checkpoint.dir")
    first, second = [(1, day(1), 1, "a"), (1, day(1), 1, "a"), (2, day(1), 1, "b")], [(1, day(1), 1, "a"), (3, day(2), 1, "b")]
    events = arriving(first, second)
    out = streaming.drained(streaming.once(events, "event_id"))
    assert out.inputFiles() and all(f.startswith(f"{shared}/stream-") for f in out.inputFiles())
    assert sorted(r.event_id for r in out.collect()) == [1, 2, 3]
    state = streaming.drained(streaming.conversation_state(events), "update")
    assert state.inputFiles() and all(f.startswith(f"{shared}/stream-") for f in state.inputFiles())
    assert sorted(r.n for r in state.collect()) == [3, 5]
    assert [r.n for r in streaming.drained(streaming.conversation_state(events), "complete").collect()] == [5]
    for _ in range(2):  # goes on from the checkpoint
        again = streaming.drained(streaming.once(events, "event_id"), checkpoint=f"file://{tmp_path}/kept")
        assert again.count() == 3


def test_stream_without_events(spark, arriving):
    events = arriving([])
    assert streaming.drained(streaming.once(events, "event_id")).count() == 0
    assert streaming.drained(streaming.conversation_state(events), "update").count() == 0


def test_machine_goes_on_from_its_table(spark, arriving, tmp_path):
    day = lambda d: f"2024-01-{d:02d} 00:00:00"
    events = arriving([(2, day(2), 1, "b"), (1, day(1), 1, "a"), (3, day(3), None, "a")], [(4, day(4), 1, "a"), (5, day(5), 1, "x"), (6, day(6), 2, None)])
    steps = {"new": ["a"], "a": ["b"], "b": ["a"]}
    for _ in range(2):  # the second call finds nothing new
        out = streaming.machine(events.withColumn("to", F.col("event_type")), "user_id", ["ts", "event_id"], steps, "new", checkpoint=f"file://{tmp_path}/m")
        assert {r.user_id: (r.status, r.n_ignored) for r in out.collect()} == {1: ("a", 1), None: ("a", 0), 2: ("new", 1)}

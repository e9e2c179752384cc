"""Machines with timers and joins of streams, over several files in shuffled order and over restarts."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.plans.live import SERVICE
from millrace.plans.registry import QUERIES
from millrace.streaming import drained, joins, timers

H = 3_600_000_000
BASE = datetime(2024, 1, 1)
SF = "/root/testdata/sf0.001"


def folder_stream(spark, at, ddl):
    raw = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{at}")
    return raw.withColumns({c: F.col(c).cast("timestamp") for c in raw.columns if c.endswith(("ts", "_at"))})


def put(spark, at, name, rows, ddl):
    df = spark.createDataFrame(rows, ddl.replace("timestamp_ntz", "timestamp"))
    df.select(*(F.col(c).cast("timestamp_ntz").alias(c) if c.endswith(("ts", "_at")) else c for c in df.columns)).coalesce(1).write.parquet(f"file://{at}/{name}")


EVENTS = "user_id long, event_id long, ts timestamp_ntz, event_type string"


def played(rows, machine, until):
    """What the machine does with (key, id, microseconds, said) up to a time."""
    out = []
    for key in {r[0] for r in rows if r[0] is not None}:
        status, since = machine.start, None
        for at, _, said in [*sorted({(t, i, s) for k, i, t, s in rows if k == key and t <= until}), (until, None, None)]:
            while since is not None and status in machine.limits and since + machine.limits[status][0] <= at:
                since += machine.limits[status][0]
                status = machine.limits[status][1]
                out.append((key, since, status, "timer"))
            if machine.moves.get((status, said), status) != status:
                status, since = machine.moves[status, said], at
                out.append((key, at, status, said))
    return sorted(out)


def micros(rows):
    return sorted((r.user_id, int((r["at"] - BASE) / timedelta(microseconds=1)), r.status, r.cause) for r in rows)


def events(n, seed):
    rng = random.Random(seed)
    return [(rng.choice([1, 1, 1, 2, 3, None]), i, rng.randrange(20 * H), rng.choice(["view", "view", "click", "purchase", "error", "other"])) for i in range(n)]


def stamped(rows):
    return [(k, i, BASE + timedelta(microseconds=t), s) for k, i, t, s in rows]


LAST = (9, 10**6, 60 * H, "other")  # moves the watermark


def test_machine_in_shuffled_order_and_over_a_restart(spark, tmp_path):
    rows = events(120, 1)
    want = played([*rows, LAST], SERVICE, LAST[2] - 30 * H)
    random.Random(2).shuffle(rows)
    run = lambda: drained(timers.changes(folder_stream(spark, f"{tmp_path}/in", EVENTS), "user_id", "ts", "event_id", "event_type", SERVICE, "30 hours"), checkpoint=f"file://{tmp_path}/kept", provider=timers.PROVIDER)
    for i in range(2):
        put(spark, f"{tmp_path}/in", f"b={i}", stamped(rows[i * 40 : i * 40 + 40]), EVENTS)
    assert micros(run().collect()) == []  # nothing is past the watermark
    for i, some in enumerate((rows[80:], [LAST]), 2):  # a new process goes on from what is stored
        put(spark, f"{tmp_path}/in", f"b={i}", stamped(some), EVENTS)
        out = run()
    assert micros(out.collect()) == want and any(c == "timer" for *_, c in want)
    assert micros(run().collect()) == want  # nothing comes twice
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != timers.PROVIDER


def test_timer_fires_without_an_event_of_its_key(spark, tmp_path):
    batches = [[(1, 1, 0, "view"), (2, 2, 0, "view"), (2, 3, H, "click")], [(3, 4, 4 * H, "other")], [(1, 5, 5 * H, "click"), (1, 6, 10, "view"), (3, 7, 6 * H, "other")]]
    for i, rows in enumerate(batches):
        put(spark, f"{tmp_path}/in", f"b={i}", stamped(rows), EVENTS)
    out = drained(timers.changes(folder_stream(spark, f"{tmp_path}/in", EVENTS), "user_id", "ts", "event_id", "event_type", SERVICE, "30 minutes"), provider=timers.PROVIDER)
    assert micros(out.collect()) == [(1, 0, "waiting", "view"), (1, 2 * H, "takeover", "timer"), (1, 5 * H, "open", "click"), (2, 0, "waiting", "view"), (2, H, "open", "click")]  # event 6 came too late


def test_approvals_expire_and_are_forgotten(spark, tmp_path):
    machine = timers.Timed("none", {("none", "ask"): "pending", ("pending", "approve"): "approved", ("pending", "reject"): "rejected", ("approved", "ask"): "again"}, {"pending": (24 * H, "expired")}, over=("approved", "rejected", "expired"), keep=10 * H)
    rows = [[(1, 1, 0, "ask"), (1, 2, H, "approve"), (2, 3, 0, "ask"), (3, 4, 0, "ask"), (3, 5, H, "reject"), (3, 6, 2 * H, "approve")], [(9, 7, 50 * H, "x")], [(1, 8, 60 * H, "ask"), (9, 9, 90 * H, "x")]]
    for i, some in enumerate(rows):
        put(spark, f"{tmp_path}/in", f"b={i}", stamped(some), EVENTS)
    out = drained(timers.changes(folder_stream(spark, f"{tmp_path}/in", EVENTS), "user_id", "ts", "event_id", "event_type", machine, "1 hour"), provider=timers.PROVIDER)
    got = micros(out.collect())
    assert got == [(1, 0, "pending", "ask"), (1, H, "approved", "approve"), (1, 60 * H, "pending", "ask"), (1, 84 * H, "expired", "timer"), (2, 0, "pending", "ask"), (2, 24 * H, "expired", "timer"), (3, 0, "pending", "ask"), (3, H, "rejected", "reject")]


RUNS, CALLS, APPROVALS = "run_id long, agent_id string, started_at timestamp_ntz", "run_id long, tool_call_id long, tool_name string, called_at timestamp_ntz", "tool_call_id long, decision string, decided_at timestamp_ntz"


def test_traces_of_streams(spark, tmp_path):
    """Calls in time join, late and missing approvals leave nulls; files are dealt in shuffled order."""
    at, rng = lambda h: BASE + timedelta(hours=h), random.Random(5)
    runs = [(i, f"a{i % 3}", at(i % 24)) for i in range(30)] + [(None, "lost", at(1))]
    calls = [(i, 100 * i + j, "tool", at(i % 24 + j)) for i in range(0, 30, 2) for j in range(3)] + [(4, 999, "too late", at(20)), (77, 7700, "no run", at(2))]
    approvals = [(c[1], "approved", c[3] + timedelta(minutes=30)) for c in calls if c[1] % 3 == 0] + [(201, "late", at(90))]
    end = at(24 * 30)
    tables = {"runs": (runs, RUNS, (10**6, "end", end)), "calls": (calls, CALLS, (10**7, 10**7, "end", end)), "approvals": (approvals, APPROVALS, (10**8, "end", end))}
    for name, (rows, ddl, last) in tables.items():
        rng.shuffle(rows)
        for i in range(3):
            put(spark, f"{tmp_path}/{name}", f"b={i}", rows[i::3], ddl)
        put(spark, f"{tmp_path}/{name}", "b=3", [last], ddl)
    stream = lambda n, ts: folder_stream(spark, f"{tmp_path}/{n}", tables[n][1]).withWatermark(ts, "100 hours")
    out = drained(joins.traced(stream("runs", "started_at"), stream("calls", "called_at"), stream("approvals", "decided_at"), "5 hours", "1 hour"))
    got = sorted((str(r.run_id), str(r.tool_call_id), str(r.decision)) for r in out.collect() if r.agent_id != "end")
    want = []
    for run, _, start in runs:
        mine = [c for c in calls if run is not None and c[0] == run and start <= c[3] <= start + timedelta(hours=5)]
        for c in mine:
            told = [a[1] for a in approvals if a[0] == c[1] and c[3] <= a[2] <= c[3] + timedelta(hours=1)]
            want += [(str(run), str(c[1]), str(t)) for t in told or [None]]
        want += [] if mine else [(str(run), "None", "None")]
    assert got == sorted(want) and ("4", "999", "None") not in got


@pytest.mark.parametrize("rows", [[], [(None, 1, BASE, "view"), (1, None, BASE, "view"), (1, 2, None, "view"), (1, 3, BASE, None)]])
def test_nothing_and_nulls(spark, tmp_path, rows):
    put(spark, f"{tmp_path}/in", "b=0", rows, EVENTS)
    assert drained(timers.changes(folder_stream(spark, f"{tmp_path}/in", EVENTS), "user_id", "ts", "event_id", "event_type", SERVICE), provider=timers.PROVIDER).count() == 0


def test_run_trace_holds_no_state_in_memory(spark):
    """The joined backlog lies in tables: no state store is opened, so a class that isn't there does no harm."""
    want = sorted(map(str, QUERIES["stream_run_trace"](spark, SF).collect()))
    usual = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "none.Such")
    try:
        assert sorted(map(str, QUERIES["stream_run_trace"](spark, SF).collect())) == want and want
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", usual)


def test_followed_in_tables_as_in_the_state_store(spark, tmp_path):
    """Files in shuffled order, rows twice, nulls, a restart: the rows of the join in the state store, some batches later too."""
    at, rng = lambda h: BASE + timedelta(hours=h), random.Random(6)
    runs = [(i, f"a{i % 3}", at(rng.randrange(60))) for i in range(60)] + [(None, "no key", at(1)), (3, "twice", at(7)), (3, "twice", at(7)), (8, "no time", None)]
    calls = [(rng.randrange(70), n, "tool", at(rng.randrange(70))) for n in range(150)] + [(None, 900, "no key", at(1)), (3, 901, "edge", at(12)), (3, 902, "same time", at(7)), (3, 903, "no time", None)]
    for rows, of in ((runs, "runs"), (calls, "calls")):
        rng.shuffle(rows)
        ddl = RUNS if of == "runs" else CALLS
        for i in range(3):
            put(spark, f"{tmp_path}/{of}", f"b={i}", rows[i::3], ddl)
    stream = lambda n: folder_stream(spark, f"{tmp_path}/{n}", RUNS if n == "runs" else CALLS)
    kept = f"file://{tmp_path}/kept"
    tables = lambda: joins.followed_in_tables(stream("runs"), stream("calls"), ["run_id"], "started_at", "called_at", "5 hours", "100 hours", kept)
    assert {r.tool_call_id for r in tables().collect()} - {None}  # pairs come at once, runs alone only past the watermark
    for h in (400, 900):  # the first moves the watermark beyond all rows, the second finds only rows of the first
        put(spark, f"{tmp_path}/runs", f"b={h}", [(10**6 + h, "end", at(h))], RUNS)
        put(spark, f"{tmp_path}/calls", f"b={h}", [(10**6 + h, h, "end", at(h + 1)), (4, 5000 + h, "too late", at(2))][: 1 if h == 400 else 2], CALLS)
        got = tables()
    mark = lambda n, ts: stream(n).withWatermark(ts, "100 hours")
    want = drained(joins.followed(mark("runs", "started_at"), mark("calls", "called_at"), ["run_id"], "started_at", "called_at", "5 hours"))
    assert got.columns == want.columns
    said = sorted(map(str, got.collect()))
    assert said == sorted(map(str, want.collect())) and sum("tool_call_id=None" in s for s in said) > 10 and sum("'twice'" in s for s in said) >= 4
    waits = spark.read.option("recursiveFileLookup", True).parquet(f"{kept}/open/4")
    assert waits.count() <= 2  # nothing that is over is held
    assert sorted(map(str, tables().collect())) == said  # nothing comes twice

"""Queries over streams with timers and joins of streams, with their SQL; registered by plans.registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import streaming
from ..sources import events_stream, table_stream
from ..streaming import joins, timers
from .registry import query

_HOUR = 3_600_000_000
#: A customer's message (view) waits for a reply (click) for two hours; then a person takes over.
SERVICE = timers.Timed(
    "new",
    {("new", "view"): "waiting", ("open", "view"): "waiting", ("resolved", "view"): "waiting", ("waiting", "click"): "open", ("takeover", "click"): "open"}
    | {(s, "purchase"): "resolved" for s in ("waiting", "open", "takeover")}
    | {(s, "error"): "takeover" for s in ("waiting", "open")},
    {"waiting": (2 * _HOUR, "takeover")},
)


def _timed_sql(machine: timers.Timed, late: str) -> str:
    """A machine with one timed status as a recursion over each key's events."""
    ((status, (limit, then)),) = machine.limits.items()
    moved = "case pre || '>' || event_type " + " ".join(f"when '{a}>{said}' then '{b}'" for (a, said), b in machine.moves.items()) + " end"
    due = f"since + interval {limit // _HOUR} hour"
    fires = f"r.status = '{status}' and r.{due} <= e.ts"
    return f"""with recursive mark as (select date_trunc('milliseconds', max(ts)) - interval {late} as w from events where user_id is not null and event_id is not null),
e as (select user_id, ts, event_type, row_number() over (partition by user_id order by ts, event_id) i from events, mark where user_id is not null and event_id is not null and ts <= w),
r(user_id, i, status, since, fired, changed, cause) as (
  select distinct user_id, 0::bigint, '{machine.start}', null::timestamp, null::timestamp, null::timestamp, null::varchar from e
  union all
  select user_id, i, coalesce(moved, pre), case when coalesce(moved, pre) <> pre then ts else entered end, fired, case when coalesce(moved, pre) <> pre then ts end, event_type
  from (select *, {moved} moved from (
    select e.user_id, e.i, e.ts, e.event_type, case when {fires} then '{then}' else r.status end pre, case when {fires} then r.{due} else r.since end entered, case when {fires} then r.{due} end fired
    from r join e on e.user_id = r.user_id and e.i = r.i + 1))
)
select user_id, changed as at, status, cause from r where changed is not null
union all select user_id, fired, '{then}', 'timer' from r where fired is not null
union all select user_id, {due}, '{then}', 'timer' from (select * from r qualify row_number() over (partition by user_id order by i desc) = 1), mark where status = '{status}' and {due} <= w"""


@query(_timed_sql(SERVICE, "1 hour"))
def stream_sla_takeover(spark, d):
    """Every change of a conversation's status; one that nobody answers in time goes to a person by a timer, without a new event."""
    out = timers.changes(events_stream(spark, d), "user_id", "ts", "event_id", "event_type", SERVICE, "1 hour")
    return streaming.drained(out, provider=timers.PROVIDER).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("""with mark as (select least((select max(o_orderdate) from orders), (select max(l_shipdate) from lineitem)) - interval 25 hour as w)
select o_orderkey run_id, l_linenumber call, l_shipdate called_at, count(*) n from orders join lineitem on o_orderkey = l_orderkey and l_shipdate between o_orderdate and o_orderdate + interval 60 day group by all
union all select o_orderkey, null, null, count(*) from orders, mark where o_orderdate < w - interval 60 day
  and not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_shipdate between o_orderdate and o_orderdate + interval 60 day) group by 1""")
def stream_run_trace(spark, d):
    """Orders as runs, their lines as calls within 60 days, both as streams; a run that no call follows comes when its time is over."""
    runs = table_stream(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").cast("timestamp").alias("started_at"))
    calls = table_stream(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("call"), F.col("l_shipdate").cast("timestamp").alias("called_at"))
    out = joins.followed_in_tables(runs, calls, ["run_id"], "started_at", "called_at", "60 days", "25 hours")
    return out.groupBy("run_id", "call", F.col("called_at").cast("timestamp_ntz").alias("called_at")).agg(F.count("*").alias("n"))

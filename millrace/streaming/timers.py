"""Status machines over streams with timers: what happens when nothing happens.

State lies in Spark's state store, by key: the status, and events that are ahead of the watermark. A batch touches the keys
that it has events or due timers for, and no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that timers and maps in the state need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What a timed transition is told to be caused by, instead of an event.
TIMER = "timer"


@dataclass(frozen=True)
class Timed:
    """A machine: moves by (status, what an event says), and by time, {status: (microseconds, next status)}.

    Time in a status runs from when it was entered; events that leave it unchanged don't start it again. keep: so many
    microseconds after a key has entered a status of ``over`` it is forgotten, and begins at start again.
    """

    start: str
    moves: dict[tuple[str, str], str]
    limits: dict[str, tuple[int, str]]
    over: tuple[str, ...] = ()
    keep: int = 0

    def due(self, status: str, since: int) -> int | None:
        """When the status is left by time, None if it isn't."""
        return since + self.limits[status][0] if status in self.limits else None


class _Processor(StatefulProcessor):
    """The machine of each key. Events are held until the watermark has passed them and then taken in order of (at, id);
    a timer wakes the key for its next held event, its limit, or to be forgotten.

    Held events are a list with an entry for each batch, which holds all of the batch's, and are read only when one of them is
    due; beside the status lie the time of the first held event and the timer, so that a batch takes a few calls of the state
    store for a key, not some for each event.
    """

    def __init__(self, machine: Timed):
        self.machine = machine

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.status = handle.getValueState("status", "status string, since long, next long, timer long")
        self.held = handle.getListState("held", "at array<long>, id array<long>, said array<string>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        return self._run(key, timerValues.getCurrentWatermarkInMs(), [(r["at"], r["id"], r["said"]) for r in rows])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self._run(key, timerValues.getCurrentWatermarkInMs(), [])

    def _run(self, key: tuple, watermark_ms: int, new: list[tuple[int, int, str]]) -> Iterator[Row]:
        m, now, out = self.machine, watermark_ms * 1000, []
        before = self.status.get()
        status, since, first, timer = before = tuple(before) if before is not None else (m.start, None, None, None)
        due: list[tuple[int, int, str]] = []
        if new:
            first = min(e[0] for e in new) if first is None else min(first, min(e[0] for e in new))
        if first is not None and first <= now:
            held = [e for some in (self.held.get() if before[2] is not None else ()) for e in zip(*some, strict=True)]
            every = {e[:2]: e[2] for e in [*held, *new]}
            events = sorted((at, i, said) for (at, i), said in every.items())
            due, rest = [e for e in events if e[0] <= now], [e for e in events if e[0] > now]
            if rest:
                self.held.put([tuple(map(list, zip(*rest, strict=True)))])
            elif before[2] is not None:
                self.held.clear()
            first = rest[0][0] if rest else None
        elif new:
            self.held.appendValue(tuple(map(list, zip(*new, strict=True))))

        def timed(until: int) -> None:
            nonlocal status, since
            while since is not None and (end := m.due(status, since)) is not None and end <= until:
                status, since = m.limits[status][1], end
                out.append(Row(key=key[0], at=end, status=status, cause=TIMER))
            if m.keep and since is not None and status in m.over and since + m.keep <= until:
                status, since = m.start, None

        for at, _, said in due:
            timed(at)
            if (to := m.moves.get((status, said))) is not None and to != status:
                status, since = to, at
                out.append(Row(key=key[0], at=at, status=status, cause=said))
        timed(now)
        wake = [] if first is None else [first]
        if since is not None:
            wake += [t for t in (m.due(status, since), since + m.keep if m.keep and status in m.over else None) if t is not None]
        after = -(-min(wake) // 1000) if wake else None  # of milliseconds, the first that isn't before it
        if after != timer:
            if timer is not None and timer > watermark_ms:  # else it fires in this batch and is gone
                self.handle.deleteTimer(timer)
            if after is not None:
                self.handle.registerTimer(after)
        if since is None and first is None:
            if before != (m.start, None, None, None):
                self.status.clear()
        elif (status, since, first, after) != before:
            self.status.update((status, since, first, after))
        return iter(out)

    def close(self) -> None:
        pass


def changes(events: DataFrame, key: str, ts: str, id: str, said: str, machine: Timed, late: str = "1 hour") -> DataFrame:
    """key, at, status, cause for each change of a key's status, by an event (cause is what it says) or by time ('timer').

    events: a stream with key, ts (timestamp), id (long, which orders events of the same time) and said. Events are taken in
    order of time, in whatever order they come, once the watermark has passed them; later ones than ``late`` are dropped, as are
    events without key, time or id. An id that repeats at its time counts once. A timer fires when the watermark passes it,
    without a new event of its key. The session needs PROVIDER as its state store.
    """
    micros = F.unix_micros(F.col(ts))
    rows = events.filter(F.col(key).isNotNull() & F.col(ts).isNotNull() & F.col(id).isNotNull()).withWatermark(ts, late)
    rows = rows.select(F.col(key).alias("key"), F.col(ts).alias("_ts"), micros.alias("at"), F.col(id).cast("long").alias("id"), F.coalesce(said, F.lit("")).alias("said"))
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("at", T.LongType()), T.StructField("status", T.StringType()), T.StructField("cause", T.StringType())])
    out = rows.groupBy("key").transformWithState(statefulProcessor=_Processor(machine), outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return out.select(F.col("key").alias(key), F.timestamp_micros("at").alias("at"), "status", "cause")

"""Joins of streams with streams, bounded in time: what came in time, and what never came."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..store import scratch


def followed(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, within: str) -> DataFrame:
    """left's columns and those of right (but keys) for each row of right that has the keys of a row of left and comes at its
    time or up to ``within`` after it; a row of left that none follows comes once, with nulls, when the watermark has passed
    its bound.

    Both are streams with a watermark on their time; names of other columns differ. Rows of either side wait in the state only
    as long as a partner may still come; those with a null key or time never meet one.
    """
    other = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = reduce(and_, (F.col(k) == F.col(f"_{k}") for k in keys))
    bound = (F.col(right_ts) >= F.col(left_ts)) & (F.col(right_ts) <= F.col(left_ts) + F.expr(f"interval {within}"))
    return left.join(other, same & bound, "leftOuter").drop(*(f"_{k}" for k in keys))


def followed_in_tables(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, within: str, late: str, checkpoint: str | None = None) -> DataFrame:
    """What ``followed`` puts out over all that both streams hold, for backlogs whose open rows are too many for a state store.

    Each batch's rows and those that wait are tables in the shared folder, joined there as tables are, so that tasks sort on disk
    what the state would hold in memory. The watermark lies ``late`` behind the lesser of both sides' newest times; rows at or before
    the one of earlier batches are left out. A row waits while a partner may still come. A batch that is tried again writes
    the same tables again. checkpoint: a folder by which a later call goes on and returns the output of all calls.
    """
    spark, folder = left.sparkSession, checkpoint or scratch(left.sparkSession, "followed")
    plain = lambda df: [T.StructField(f.name, f.dataType) for f in df.schema]  # noqa: E731  # without marks of watermarks
    other, micros = right.withColumnsRenamed({k: f"_{k}" for k in keys}), lambda c: F.unix_micros(c.cast("timestamp"))
    both = left.withColumn("_right", F.lit(False)).unionByName(other.withColumn("_right", F.lit(True)), allowMissingColumns=True)
    rows = T.StructType([*plain(both), *(T.StructField(n, t) for n, t in (("_batch", T.LongType()), ("_id", T.LongType()), ("_met", T.BooleanType())))])
    marks = T.StructType([T.StructField("l", T.LongType()), T.StructField("r", T.LongType())])
    told = [c for c in (*left.columns, *other.columns) if c not in {f"_{k}" for k in keys}]
    puts = T.StructType([*(f for f in rows if f.name in told), *(f for f in rows if f.name in ("_batch", "_id")), T.StructField("_hit", T.BooleanType())])
    for name, schema in (("open", rows), ("marks", marks), ("out", puts)):
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/{name}/-1")
    kept = lambda name, schema, i: spark.read.schema(schema).parquet(f"{folder}/{name}/{i}")
    put = lambda df, name, i: df.write.mode("overwrite").parquet(f"{folder}/{name}/{i}")
    mark = lambda df: df.agg(micros(F.timestamp_micros(F.least(F.when(F.max("r").isNotNull(), F.max("l")), F.max("r"))) - F.expr(f"interval {late}"))).first()[0]
    at = F.when(F.col("_right"), micros(F.col(right_ts))).otherwise(micros(F.col(left_ts)))
    usable = at.isNotNull() & reduce(and_, (F.col(f"_{k}").isNotNull() | ~F.col("_right") for k in keys))

    def step(df: DataFrame, i: int) -> None:
        before, since = mark(kept("marks", marks, i - 1)), kept("open", rows, i - 1)
        df = df.filter(usable if before is None else usable & (at > before))
        put(df.withColumns({"_batch": F.lit(i).cast("long"), "_id": F.when(~F.col("_right"), F.monotonically_increasing_id()), "_met": F.lit(False)}), "new", i)
        new = kept("new", rows, i)  # read in the session of the caller, whose joins adapt
        put(kept("marks", marks, i - 1).unionByName(new.agg(F.max(F.when(~F.col("_right"), at)).alias("l"), F.max(F.when(F.col("_right"), at)).alias("r"))), "marks", i)
        now, every = mark(kept("marks", marks, i)), since.unionByName(new)
        runs = every.filter("not _right").select(*left.columns, "_batch", "_id", "_met")
        calls = every.filter("_right").select(*other.columns, F.col("_batch").alias("_since"))
        same = reduce(and_, (F.col(k) == F.col(f"_{k}") for k in keys))
        bound = (F.col(right_ts) >= F.col(left_ts)) & (F.col(right_ts) <= F.col(left_ts) + F.expr(f"interval {within}"))
        waits = F.lit(True) if now is None else micros(F.col(left_ts) + F.expr(f"interval {within}")) >= now
        pairs = runs.join(calls, same & bound & ((F.col("_batch") == i) | (F.col("_since") == i)), "left").withColumn("_hit", F.col("_since").isNotNull())
        put(pairs.filter(F.col("_hit") | ~(F.col("_met") | waits)).select(puts.names), "out", i)
        met = kept("out", puts, i).filter(F.col("_hit") & waits).select("_batch", "_id").distinct().withColumn("_now", F.lit(True))
        runs = runs.filter(waits).join(met, ["_batch", "_id"], "left").withColumn("_met", F.col("_met") | F.col("_now").isNotNull()).drop("_now")
        calls = every.filter("_right") if now is None else every.filter(F.col("_right") & (at > now))
        put(runs.withColumn("_right", F.lit(False)).unionByName(calls, allowMissingColumns=True).select(rows.names), "open", i)

    both.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(puts).option("recursiveFileLookup", True).parquet(f"{folder}/out").select(told)


def traced(runs: DataFrame, calls: DataFrame, approvals: DataFrame, run_for: str, approval_for: str) -> DataFrame:
    """Traces while they grow: each run with its calls that start within ``run_for`` of it, each call with its approvals within
    ``approval_for``; nulls for a run without a call and for a call without an approval once their time is over.

    Streams with watermarks on started_at, called_at and decided_at. runs: run_id, agent_id, started_at. calls: run_id,
    tool_call_id, tool_name, called_at. approvals: tool_call_id, decision, decided_at.
    """
    steps = followed(calls, approvals.select("tool_call_id", "decision", "decided_at"), ["tool_call_id"], "called_at", "decided_at", approval_for)
    steps = steps.withColumn("decided_at", F.timestamp_micros(F.unix_micros("decided_at")))  # called_at is the steps' time
    return followed(runs.select("run_id", "agent_id", "started_at"), steps, ["run_id"], "started_at", "called_at", run_for)

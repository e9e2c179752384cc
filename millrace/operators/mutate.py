"""Keyed changes, ordered migrations, status machines, validation, erasure."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import errors_message


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """current with each key's last change (by order) in place of its row; op = 'delete' removes it.

    changes: the columns of current, op, and order columns. Applying the same changes again changes nothing, null keys
    included: a null is a key like others.
    """
    last = changes.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order)))).filter("_n = 1").drop("_n")
    gone = last.select(*(F.col(k).alias(f"_key_{k}") for k in keys))
    kept = current.join(gone, reduce(and_, (F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys)), "left_anti")
    return kept.unionByName(last.filter(F.coalesce(F.col("op"), F.lit("upsert")) != "delete").select(current.columns))


def patch(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """current with the other columns of changes in place of its own for rows with a key of changes; keys must be unique there.

    Other rows and columns stay as they are; a null in changes is set as such; keys that current lacks change nothing.
    """
    new = [c for c in changes.columns if c not in keys]
    marked = changes.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in new), F.lit(True).alias("_found"))
    out = current.join(marked, keys, "left")
    return out.select(*(F.when(F.col("_found"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in current.columns))


def erase(tables: dict[str, DataFrame], column: str, ids: DataFrame) -> dict[str, DataFrame]:
    """All tables without the rows of those ids, in the tables that have the column."""
    return {n: t.join(ids.select(column).distinct(), column, "left_anti").select(t.columns) if column in t.columns else t for n, t in tables.items()}


def pending(files: DataFrame, applied: DataFrame) -> DataFrame:
    """Migration files that haven't been applied, in order of their names; other files and __init__.py don't count."""
    usable = files.filter(F.col("filename").endswith(".py") & (F.col("filename") != "__init__.py"))
    return usable.join(applied.select("filename").distinct(), "filename", "left_anti").orderBy("filename")


def run_prefix(results: DataFrame, order: str, ok: str, has_run: str) -> DataFrame:
    """status of each file: applied, failed (the first with ok = false), skipped (nothing to run), not_run (after a failure).

    A null ok counts as success. Results are as many as there are migrations, one ordered sequence.
    """
    failed = (F.col(has_run) & ~F.coalesce(F.col(ok), F.lit(True))).cast("int")
    before = F.coalesce(F.max(failed).over(Window.partitionBy().orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    status = F.when(before == 1, "not_run").when(~F.col(has_run), "skipped").when(failed == 1, "failed").otherwise("applied")
    return results.withColumn("status", status)


def migrate(names: list[str], steps: dict[str, Callable[[DataFrame], DataFrame | None]], applied: set[str], df: DataFrame, reasons: dict[str, str] | None = None) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Applies registered steps in order of their names to df, until one fails; returns df and each name's status.

    A step returns the new DataFrame, or None if it changes nothing; anything else is a failure, as is an exception. reasons:
    a dictionary that gets why a step failed.
    """
    said, stopped = [], False
    for name in sorted(n for n in names if n not in applied):
        if stopped:
            said.append((name, "not_run"))
        elif name not in steps:
            said.append((name, "skipped"))
        else:
            try:
                out = steps[name](df)
                why = f"returned {type(out).__name__}"
            except Exception as error:
                out, why = False, f"{type(error).__name__}: {error}"
            stopped = out is not None and not isinstance(out, DataFrame)
            if stopped and reasons is not None:
                reasons[name] = why
            df = df if stopped or out is None else out
            said.append((name, "failed" if stopped else "applied"))
    return df, said


def _states(transitions: dict[str, list[str]], start: str) -> list[str]:
    return sorted({start, *transitions, *(b for bs in transitions.values() for b in bs)})


def _begin(state: Column) -> Column:
    return F.struct(state.alias("status"), F.lit(0).cast("long").alias("n_ignored"))


def _follow(states: list[str]) -> Callable[[Column, Column], Column]:
    """The state and count that a map leads a state and count to; without a map they stay."""

    def step(s: Column, part: Column) -> Column:
        to = F.element_at(part["to"], F.array_position(F.array(*map(F.lit, states)), s["status"]).cast("int"))
        return F.struct(F.coalesce(to["status"], s["status"]).alias("status"), (s["n_ignored"] + F.coalesce(to["n_ignored"], F.lit(0))).alias("n_ignored"))

    return step


def _parts(events: DataFrame, key: str, order: list[str], transitions: dict[str, list[str]], start: str) -> DataFrame:
    """key, _p: for each key its maps in order, one of each range of events, from every state to the state and count it leads to."""
    allowed = F.create_map(*(F.lit(x) for a, bs in transitions.items() for b in bs for x in (f"{a}>{b}", True)))
    ranged = events.select(key, *order, "to").repartitionByRange(key, *order, "to").withColumn("_part", F.spark_partition_id())
    rows = ranged.groupBy(key, "_part").agg(F.array_sort(F.collect_list(F.struct(*order, "to"))).alias("_e"))

    def step(s: Column, e: Column) -> Column:
        ok = F.coalesce(F.element_at(allowed, F.concat(s["status"], F.lit(">"), e["to"])), F.lit(False))
        return F.struct(F.when(ok, e["to"]).otherwise(s["status"]).alias("status"), (s["n_ignored"] + F.when(ok, 0).otherwise(1)).cast("long").alias("n_ignored"))

    maps = rows.select(key, "_part", F.array(*(F.aggregate("_e", _begin(F.lit(s)), step) for s in _states(transitions, start))).alias("to"))
    return maps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_part", "to"))).alias("_p"))


def fold_status(events: DataFrame, key: str, order: list[str], transitions: dict[str, list[str]], start: str) -> DataFrame:
    """key, status, n_ignored: events (key, to, order) folded in order; transitions that aren't allowed are ignored and counted.

    Events are range-partitioned by key and order. Each range's events of a key make one map from every state to the state
    and count they lead to; a key's few maps are applied in order, so that no task needs a key's whole history.
    """
    parts = _parts(events, key, order, transitions, start)
    return parts.select(key, F.aggregate("_p", _begin(F.lit(start)), _follow(_states(transitions, start))).alias("s")).select(key, "s.status", "s.n_ignored")


def advance(current: DataFrame, events: DataFrame, key: str, order: list[str], transitions: dict[str, list[str]], start: str) -> DataFrame:
    """current (key, status, n_ignored) after further events, which come later than those it has seen; new keys begin at start."""
    parts = _parts(events, key, order, transitions, start).withColumnRenamed(key, "_key")
    both = current.join(parts, F.col(key).eqNullSafe(F.col("_key")), "full")
    known = F.struct(F.coalesce("status", F.lit(start)).alias("status"), F.coalesce("n_ignored", F.lit(0).cast("long")).alias("n_ignored"))
    none = F.array().cast(both.schema["_p"].dataType)
    s = F.aggregate(F.coalesce("_p", none), known, _follow(_states(transitions, start)))
    return both.select(F.coalesce(key, "_key").alias(key), s.alias("s")).select(key, "s.status", "s.n_ignored")


def validate(df: DataFrame, rules: list[tuple[str, Column, str]]) -> DataFrame:
    """df with errors, an array of (loc, msg) in the order of rules (field, condition, message), and their message."""
    bad = [F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.array(F.lit(field)).alias("loc"), F.lit(msg).alias("msg"))) for field, ok, msg in rules]
    return df.withColumn("errors", F.array_compact(F.array(*bad))).withColumn("message", errors_message("errors"))


def owners_missing(users: DataFrame, removed: DataFrame) -> DataFrame:
    """Workspaces that would have no Owner without the removed users."""
    left = users.join(removed.select("id").withColumn("_gone", F.lit(True)), "id", "left")
    n = F.count_if((F.col("role") == "Owner") & F.col("_gone").isNull())
    return left.groupBy("workspaceId").agg(n.alias("owners")).filter("owners = 0").select("workspaceId")


def accept_invitation(invites: DataFrame, logins: DataFrame, as_of: Column) -> DataFrame:
    """Each login (user_id, email, workspaceId, invite_id) with its route: dashboard, join (and role) or create.

    An invitation counts for its own email only, while pending and before it expires.
    """
    i = invites.filter((F.col("status") == "pending") & (F.col("expires_at") > as_of)).select(F.col("id").alias("invite_id"), F.lower("email").alias("_email"), "role", F.col("workspaceId").alias("invited_to"), "workspaceName")
    out = logins.withColumn("_email", F.lower("email")).join(i, ["invite_id", "_email"], "left").drop("_email")
    return out.withColumn("route", F.when(F.col("workspaceId").isNotNull(), "dashboard").when(F.col("invited_to").isNotNull(), "join").otherwise("create"))

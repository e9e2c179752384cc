"""Queries of mutations as history; registered by plans.registry."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import history
from ..sources import table
from .registry import query

PROFILE = T.StructType([T.StructField("joined", T.StringType()), T.StructField("spent", T.DoubleType()), T.StructField("k", T.LongType())])


def _mutations(spark, d):
    """Events as mutations of users' profiles: signups put, purchases and clicks patch, errors delete; views have no such verb."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    put = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd").alias("joined"), k.alias("k")))
    op = F.when(F.col("event_type") == "signup", history.PUT).when(F.col("event_type").isin("purchase", "click"), history.PATCH).when(F.col("event_type") == "error", history.DELETE).otherwise("view")
    payload = F.when(F.col("event_type") == "signup", put).when(F.col("event_type") == "purchase", F.to_json(F.struct(F.col("value").alias("spent")))).when(F.col("event_type") == "click", F.to_json(F.struct(k.alias("k"))))
    return e.select(F.col("user_id").alias("id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), op.alias("op"), payload.alias("payload"))


_VERSIONS = """with m as (select user_id id, ts as t, event_id seq, event_type op, value, cast(json_extract(props, '$.k') as bigint) k, last_value(case when event_type in ('signup', 'error') then event_id end ignore nulls) over (partition by user_id order by ts, event_id) reset
  from events where event_type in ('signup', 'purchase', 'click', 'error') and user_id is not null and ts is not null),
v as (select id, t, seq, op, last_value(case when op = 'signup' then strftime(t, '%Y-%m-%d') end ignore nulls) over w joined, last_value(case when op = 'purchase' then value end ignore nulls) over w spent,
  last_value(case when op in ('signup', 'click') then k end ignore nulls) over w k, lead(t) over (partition by id order by t, seq) valid_to from m window w as (partition by id, reset order by t, seq)),
h as (select id, joined, spent, k, op <> 'error' as exists_, t valid_from, valid_to from v where valid_to is null or valid_to > t)"""


@query(f'{_VERSIONS} select id, joined, spent, k, exists_ as "exists", valid_from, valid_to from h')
def mutation_history(spark, d):
    good, _ = history.typed(_mutations(spark, d), PROFILE)
    return history.versions(good, PROFILE)


@query(f"{_VERSIONS} select id, joined, spent, k from h where exists_ and valid_from <= timestamp '2024-01-15' and (valid_to is null or valid_to > timestamp '2024-01-15')")
def mutation_as_of(spark, d):
    return history.as_of(mutation_history(spark, d), F.lit("2024-01-15").cast("timestamp_ntz")).select("id", *PROFILE.names)


@query("select case when user_id is null or ts is null then 'no id or time' else 'unknown op' end reason, count(*) n from events where user_id is null or ts is null or event_type not in ('signup', 'purchase', 'click', 'error') or event_type is null group by 1")
def mutation_rejects(spark, d):
    _, bad = history.typed(_mutations(spark, d), PROFILE)
    return bad.groupBy("reason").agg(F.count("*").alias("n"))

"""Metrics over time, anomalies, contributions, conversion, facts as of a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import carried


def metric_by(df: DataFrame, keys: list[Column | str], **aggs: Column) -> DataFrame:
    """Aggregates by keys; partial sums come before the shuffle."""
    return df.groupBy(*keys).agg(*(a.alias(n) for n, a in aggs.items()))


def anomaly_z(df: DataFrame, order: str, value: str, n: int = 28, z: float = 2.0, tail: str = "low", by: list[str] = ()) -> DataFrame:
    """Adds mean_n, sd_n of the n rows before and is_anomaly: beyond z deviations on that tail.

    df holds aggregates (a row for each day or hour of a key), so that one sequence is small; the first rows have no
    deviation and are no anomaly.
    """
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-n, -1)
    df = df.withColumns({"mean_n": F.avg(value).over(w), "sd_n": F.stddev_samp(value).over(w)})
    score = (F.col(value) - F.col("mean_n")) / F.when(F.col("sd_n") > 0, F.col("sd_n"))
    return df.withColumn("is_anomaly", F.coalesce(score < -z if tail == "low" else score > z, F.lit(False)))


def contribution(df: DataFrame, dim: str, value: str, in_a: Column, in_b: Column) -> DataFrame:
    """dim, total_a, total_b, delta and share of the whole change between two periods."""
    both = df.groupBy(dim).agg(F.sum(F.when(in_a, F.col(value)).otherwise(0)).alias("total_a"), F.sum(F.when(in_b, F.col(value)).otherwise(0)).alias("total_b"))
    both = both.withColumn("delta", F.col("total_b") - F.col("total_a"))
    return both.withColumn("share", F.try_divide(F.col("delta"), F.sum("delta").over(Window.partitionBy())))


def first_seen(df: DataFrame, key: str, ts: str) -> DataFrame:
    """The first time of each key."""
    return df.groupBy(key).agg(F.min(ts).alias("first_ts"))


def not_converted(asks: DataFrame, buys: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Rows of asks that no buy of the key follows within the time: the next buy is carried back by ranges of time."""
    marked = asks.withColumns({"_buy": F.lit(None).cast("timestamp_ntz"), "_bought": F.lit(0)}).unionByName(buys.select(key, ts).withColumns({"_buy": F.col(ts), "_bought": F.lit(1)}), allowMissingColumns=True)
    out = carried(marked, key, [ts, "_bought"], {"_buy": "_next"}, "asks", newest_first=True).filter("_bought = 0")
    late = F.col("_next").isNull() | (F.col("_next") > F.col(ts) + F.make_interval(secs=F.lit(seconds)))
    return out.filter(late).select(asks.columns)


def asof(left: DataFrame, facts: DataFrame, key: str, ts: str, fact_ts: str, values: list[str]) -> DataFrame:
    """left with the values of the key's newest fact at or before ts (null if none): facts are carried on by ranges of time, no pairs.

    Of facts at the same time the one with the greatest values counts. Columns of facts other than values are left out.
    """
    fact = F.struct(F.col(fact_ts).alias("_at"), *values)
    right = facts.filter(F.col(key).isNotNull() & F.col(fact_ts).isNotNull()).select(key, F.col(fact_ts).alias(ts), fact.alias("_fact"))
    both = left.withColumn("_left", F.lit(1)).unionByName(right.withColumn("_left", F.lit(0)), allowMissingColumns=True)
    both = carried(both, key, [ts, "_left", "_fact"], {"_fact": "_newest"}, "facts").filter("_left = 1")
    known = F.col(ts).isNotNull() & F.col(key).isNotNull()  # nothing is valid at no time or for no key
    return both.select(*left.columns, *(F.when(known, F.col(f"_newest.{v}")).alias(v) for v in values))


def overdue(df: DataFrame, last_ts: str, as_of: Column, days: int) -> DataFrame:
    """Rows whose last time lies more than days before as_of, with their age in days."""
    return df.withColumn("age_days", F.datediff(as_of, F.col(last_ts)).cast("long")).filter(F.col("age_days") > days)


def top_per(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group with rank (from 1)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

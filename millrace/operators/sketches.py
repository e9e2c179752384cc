"""Mergeable states of metrics: distinct counts and percentiles, stored by hour and merged to coarser times without a rescan."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sinks import Log
from ..store import few, running_totals

#: Binary logarithm of a distinct sketch's registers: a relative standard error of 1.04 / sqrt(2**14), 0.8%; below 2000 values it is exact.
REGISTERS = 14
#: Size of a percentile sketch: a rank error of about 0.1% at 4096; exact up to so many values.
ITEMS = 4096


def sketched(df: DataFrame, by: list[Column | str], distinct: Column | str, measure: Column | str, registers: int = REGISTERS, items: int = ITEMS) -> DataFrame:
    """by, n (rows), seen (a sketch of the distinct values), measured (values of measure that aren't null) and spread (a sketch
    of these, null without any). Parts of sketches are made before rows are dealt out, so that a hot group costs its bytes only."""
    m = (F.col(measure) if isinstance(measure, str) else measure).cast("double")
    m = F.when(~F.isnan(m), m)
    out = df.withColumn("_m", m).groupBy(*by).agg(F.count("*").alias("n"), F.hll_sketch_agg(distinct, registers).alias("seen"), F.count("_m").alias("measured"), F.kll_sketch_agg_double("_m", items).alias("spread"))
    return out.withColumn("spread", F.when(F.col("measured") > 0, F.col("spread")))


def merged(sketches: DataFrame, by: list[Column | str]) -> DataFrame:
    """Sketches of coarser groups out of finer ones; those that have no values count as nothing."""
    out = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("seen").alias("seen"), F.sum("measured").alias("measured"), F.kll_merge_agg_double("spread").alias("spread"))
    return out.withColumn("spread", F.when(F.col("measured") > 0, F.col("spread")))


def told(sketches: DataFrame, ranks: dict[str, float]) -> DataFrame:
    """sketches with users (the estimated number of distinct values) and a column for each rank (null without values): the
    least value that at least that share of the values doesn't exceed."""
    users = F.hll_sketch_estimate("seen").alias("users")
    values = [F.when(F.col("measured") > 0, F.kll_sketch_get_quantile_double("spread", F.lit(r))).alias(name) for name, r in ranks.items()]
    return sketches.select("*", users, *values).drop("seen", "spread")


def counted(df: DataFrame, by: list[Column | str], distinct: Column | str, measure: Column | str) -> DataFrame:
    """by, who (distinct's value), value (measure's, null for NaN) and n (rows that have both): what exact answers are merged from."""
    who, m = (F.col(c) if isinstance(c, str) else c for c in (distinct, measure))
    m = m.cast("double")
    return df.groupBy(*by, who.alias("who"), F.when(~F.isnan(m), m).alias("value")).agg(F.count("*").alias("n"))


def exactly(counts: DataFrame, by: list[str], ranks: dict[str, float]) -> DataFrame:
    """by, n, users, measured and a column for each rank, as told() has them, but exact at any size.

    Values are counted, sorted by ranges and given running totals, so that no group's values meet in one task; of a rank, the
    first value counts by which so many of the group's values have come (null without values).
    """
    of = F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0))
    out = counts.groupBy(*by).agg(F.sum("n").alias("n"), F.count_distinct("who").alias("users"), of.alias("measured"))
    if not ranks:
        return out
    values = counts.filter(F.col("value").isNotNull()).groupBy(*by, "value").agg(F.sum("n").alias("_n"))
    values = running_totals(values, [F.col(c) for c in (*by, "value")], "_n", "_before", "values")
    key = F.struct(*by) if by else F.lit(0)
    values = values.select(key.alias("_key"), "value", "_before", (F.col("_before") + F.col("_n")).alias("_until"))
    groups = few(values.groupBy("_key").agg(F.min("_before").alias("_start"), (F.max("_until") - F.min("_before")).alias("_all")), "groups").withColumnRenamed("_key", "_of")
    least = lambda r: F.min(F.when(F.col("_until") - F.col("_start") >= F.ceil(F.col("_all").cast("decimal(19,0)") * F.lit(Decimal(str(r)))), F.col("value")))
    told = values.join(groups, F.col("_key").eqNullSafe(F.col("_of"))).groupBy("_of").agg(*(least(r).alias(name) for name, r in ranks.items()))
    return out.join(told, key.eqNullSafe(F.col("_of")), "left").drop("_of")


class Rollup:
    """A stored table of sketches by hour and further keys, to which batches of rows are added under their names.

    A batch that is tried again replaces itself; rows of an hour may come in many batches. Questions about days or weeks merge
    what is stored; no batch's rows are read again. exact: counts of values are stored in place of sketches (at most a row for
    each row that is added), and answers are exact whatever the sizes.
    """

    def __init__(self, spark: SparkSession, ts: str, keys: list[str], distinct: str, measure: str, at: str | None = None, exact: bool = False):
        self.ts, self.keys, self.distinct, self.measure, self.exact = ts, keys, distinct, measure, exact
        self.log, self.schema = Log(spark, "sketches", at=at), None

    def add(self, batch: str, rows: DataFrame) -> None:
        s = (counted if self.exact else sketched)(rows.filter(F.col(self.ts).isNotNull()), [F.date_trunc("hour", self.ts).alias("hour"), *self.keys], self.distinct, self.measure)
        self.schema = T.StructType([T.StructField(f.name, f.dataType) for f in s.schema])
        self.log.append(batch, s)

    def by(self, grain: str, keys: list[str] | None = None, **ranks: float) -> DataFrame:
        """The grain's start (hour, day, week, ..), keys (by default none), n, users, measured and the values at the given ranks."""
        if self.schema is None:
            raise ValueError("nothing has been added")
        rows = self.log.read(self.schema)
        if self.exact:
            return exactly(rows.withColumn(grain, F.date_trunc(grain, "hour")), [grain, *(keys or [])], ranks)
        return told(merged(rows, [F.date_trunc(grain, "hour").alias(grain), *(keys or [])]), ranks)

"""Tables in the folder that driver and executors share, running totals and ranks over them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rows that one task sorts or holds, on average: more rows make more tasks, not larger ones.
ROWS = 500_000


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder path below spark.checkpoint.dir, which driver and executors share.

    Only where that setting is absent (a local session, tests) a temporary folder of this machine serves.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut and lost executors cost no recomputation. options are the writer's."""
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession, rows: int) -> int | None:
    """Into how many partitions so many rows go; None if one task can hold them (then as many as the session likes)."""
    return max(-(-rows // ROWS), spark.sparkContext.defaultParallelism) if rows > ROWS else None


def dealt(df: DataFrame, n: int | None, *keys: str) -> DataFrame:
    """df in n partitions by keys; as it is for None."""
    return df.repartition(n, *keys) if n else df


def few(df: DataFrame, name: str, limit: int = 100_000) -> DataFrame:
    """df, written, with a broadcast hint if it has at most ``limit`` rows; for narrow rows."""
    df = written(df, name)
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def running_totals(df: DataFrame, order: list[Column], value: str, before: str, name: str) -> DataFrame:
    """Adds column ``before``: the sum of ``value`` over all rows that come earlier in ``order``.

    A range sort, totals within each range, and an offset for each range (one number for a partition); no row
    group meets in one task. order must determine the sequence; its rows are written once, so that ranges stay put.
    """
    parts = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("_part").agg(F.sum(value).alias("_sum"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for a partition
    offsets = sums.select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    local = parts.withColumn(before, F.coalesce(F.sum(value).over(within), F.lit(0)))
    return local.join(F.broadcast(offsets), "_part").withColumn(before, F.col(before) + F.col("_offset")).drop("_part", "_offset")


def carried(df: DataFrame, group: str, order: list[str], values: dict[str, str], name: str, newest_first: bool = False, own: bool = True) -> DataFrame:
    """Adds a column for each of values (new name by column): its last value that isn't null in the rows of group up to this
    one (with own=False before this one), by order or, with newest_first, by order backwards.

    A range sort by group and order, a pass within each range, and what comes over from earlier ranges: as ranges follow each
    other, only one group of each can have begun before it, so that what is sent to all tasks is one row for a range. No group
    meets in one task, and there are more ranges the more rows there are (``ROWS``). Rows are written as they come, so that
    looking for the ranges doesn't compute them again, and by ranges, so that these stay put; order should determine the sequence.
    """
    by = [F.col(c).desc() if newest_first else F.col(c) for c in order]
    df = written(df, f"{name}-rows")
    n = tasks(df.sparkSession, df.count())
    ranges = df.repartitionByRange(*([n] if n else []), group, *by)
    parts = written(ranges.withColumn("_part", F.spark_partition_id()), name)
    within = Window.partitionBy("_part", group).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    at, end = F.struct(*order), F.min_by if newest_first else F.max_by
    ends = dealt(parts, n, "_part", group).groupBy("_part", F.col(group).alias("_group")).agg(*(end(F.struct(c), F.when(F.col(c).isNotNull(), at)).alias(f"_last_{c}") for c in values))
    every = Window.partitionBy("_group").orderBy("_part")
    earlier = every.rowsBetween(Window.unboundedPreceding, -1)
    over = ends.select(F.col("_part").alias("_of"), "_group", F.row_number().over(every).alias("_n"), *(F.last(f"_last_{c}", True).over(earlier).alias(f"_over_{c}") for c in values)).filter("_n > 1").drop("_n")
    local = dealt(parts, n, "_part", group).withColumns({new: F.last(c, True).over(within) for c, new in values.items()})
    out = local.join(F.broadcast(over), (F.col("_part") == F.col("_of")) & F.col(group).eqNullSafe(F.col("_group")), "left")
    return out.withColumns({new: F.coalesce(new, F.col(f"_over_{c}")[c]) for c, new in values.items()}).drop("_part", "_of", "_group", *(f"_over_{c}" for c in values))


def numbered(df: DataFrame, group: str, order: str, number: str, name: str) -> DataFrame:
    """Adds ``number``, from 0, by order within each value of group; rows of the same order are numbered in any way."""
    return ranked(df, group, [order], number, f"_{number}_of", name).drop(f"_{number}_of")


def ranked(df: DataFrame, group: str, order: list[str], rank: str, size: str, name: str) -> DataFrame:
    """Adds ``rank``, from 0, by order within each value of group, and ``size``, the rows of that value; no value meets in one task.

    A range sort, ranks within each range, and an offset for each range and value. order must determine the sequence.
    """
    parts = written(df.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id()), name)
    counts = parts.groupBy("_part", F.col(group).alias("_group")).agg(F.count("*").alias("_n"))
    every = Window.partitionBy("_group")  # a value has one row for each of its ranges
    earlier = F.sum("_n").over(every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col("_part").alias("_of"), "_group", F.coalesce(earlier, F.lit(0)).alias("_offset"), F.sum("_n").over(every).alias(size))
    local = parts.withColumn(rank, F.row_number().over(Window.partitionBy("_part", group).orderBy(*order)) - 1)
    out = local.join(offsets, (F.col("_part") == F.col("_of")) & F.col(group).eqNullSafe(F.col("_group")))
    return out.withColumn(rank, F.col(rank) + F.col("_offset")).drop("_part", "_of", "_group", "_offset")

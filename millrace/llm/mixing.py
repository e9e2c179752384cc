"""Mixing sources to target weights: targets from weights, repetition rates, whole copies and one drawn copy.

Sizes are summed by source with partial aggregation; targets are a closed-form fill of capped shares over the table of
sources; documents meet their source's rate by a checked broadcast, and each is emitted floor(rate) times plus once more
where a hash of its id falls below the fraction. No document moves between tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small

#: Weights dealt to the sources in their order, repeating; the mix's size and a source's limit in relation to all sizes.
WEIGHTS, SHARE, LIMIT = (5, 2, 1), 1.5, 2.0
#: Sources up to which their table is broadcast.
MANY_SOURCES = 100_000


def sized(docs: DataFrame) -> DataFrame:
    """docs with ``size``: number of words ``[^\\x20\\x09-\\x0D]+`` of the whole text; 0 for null and empty texts."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long")))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """source, source_size, target, rate for each source of sizes (source, size); nulls are a source of their own, the last.

    Shares follow the weights until a source reaches ``limit`` times its size; what is above goes to the others by weight
    until none is above. In order of size over weight, the sources that are full come first: the first source whose limit
    is above its share of what the full ones leave ends them.
    """
    if share > limit:
        raise ValueError("the mix can't be larger than all limits together")
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # rows here are sources, not documents
    deal = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    rows = rows.withColumn("w", deal).withColumn("full", limit * F.col("source_size"))
    by_need = Window.orderBy(F.col("full") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    rows = rows.withColumn("left", share * F.sum("source_size").over(every) - F.coalesce(F.sum("full").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", F.col("left") / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    first = F.when(F.col("full") >= F.col("level") * F.col("w"), F.struct(F.row_number().over(by_need).alias("place"), "level"))
    rows = rows.withColumn("first", first).withColumn("level", F.min("first").over(every)["level"])
    target = F.round(F.least("full", F.coalesce(F.col("level") * F.col("w"), F.col("full"))), 6)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return rows.withColumn("target", target).withColumn("rate", rate).select("source", "source_size", "target", "rate")


def planned(docs: DataFrame, seed: int = 1, **params) -> DataFrame:
    """docs (doc_id, text, source, ...) with size, source_size, target, rate and copies, the times the mix takes each row.

    Repeated rows draw alike; a row without a doc_id draws by its text. Reruns agree. Columns of these names are replaced.
    """
    docs = sized(docs.drop("size", "source_size", "target", "rate", "copies", "_no_source", "_source"))
    plan = small(targets(docs.select("source", "size"), **params), MANY_SOURCES)
    key = [F.coalesce(F.col("source"), F.lit("")).alias("_source"), F.col("source").isNull().alias("_no_source")]
    both = docs.withColumns({"_source": key[0], "_no_source": key[1]}).join(plan.select(*key, "source_size", "target", "rate"), ["_source", "_no_source"])
    said = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit("")))
    draw = F.conv(F.substring(F.md5(said), 1, 8), 16, 10).cast("double") / 2.0**32
    copies = F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")
    return both.withColumn("copies", copies).drop("_source", "_no_source")


def mixed(docs: DataFrame, **params) -> DataFrame:
    """The mix: each row of docs as often as planned() says, with ``copy`` (from 1); columns of planned() are left out."""
    plan = planned(docs.drop("copy"), **params).filter("copies > 0")
    return plan.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("size", "source_size", "target", "rate", "copies")

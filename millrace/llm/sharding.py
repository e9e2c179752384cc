"""Shards of shuffled documents by a two-pass external shuffle.

First records are scattered into buckets of a size that fits into memory, by a seeded hash of their values. Then each bucket
is put into canonical order, shuffled by Fisher-Yates with its own seed, and written. Running totals of the buckets' rows
give every record its place in the whole, and places are cut into shards whose numbers of rows differ by one at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, running_totals, scratch, small, written

#: Bytes of a bucket; buckets of more than LARGE times that are dealt out further; buckets up to which their table is broadcast.
BUCKET, LARGE, MANY_BUCKETS = 32 << 20, 4, 200_000
SHARDS = 8
LAW = "rows"


def sized(docs: DataFrame) -> DataFrame:
    """docs with size, the bytes of the text as UTF-8 and one more, and text_crc32; a null text has no bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.drop("size", "text_crc32").withColumns({"size": F.octet_length(text).cast("long") + 1, "text_crc32": F.crc32(F.encode(text, "UTF-8"))})


def scattered(docs: DataFrame, seed: int, bucket: int = BUCKET) -> DataFrame:
    """docs with _draw (a seeded hash of the row), _bucket and _sub (0, but in large buckets).

    Buckets are as many as the bytes of all rows call for. A hash deals rows evenly, but for equal rows:
    rows of a bucket that has become much too large get a part by their place in the table; parts of a bucket stay
    neighbours, so that no other bucket's rows move.
    """
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    docs = docs.withColumn("_draw", F.xxhash64(F.lit(seed), *plain))
    share = F.least("size", F.lit(bucket))  # a text longer than a bucket can't be dealt further
    total = docs.agg(F.coalesce(F.sum(share), F.lit(0))).first()[0]
    docs = docs.withColumn("_bucket", F.pmod("_draw", F.lit(max(1, -(-total // bucket)))))
    sizes = docs.groupBy("_bucket").agg(F.sum(share).alias("_bytes"))
    large = small(sizes.filter(F.col("_bytes") > LARGE * bucket), MANY_BUCKETS)
    if large.isEmpty():
        return docs.withColumn("_sub", F.lit(0).cast("long"))
    parts = F.ceil(F.col("_bytes") / bucket)
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), parts)
    return docs.join(large, "_bucket", "left").withColumn("_sub", F.coalesce(part, F.lit(0).cast("long"))).drop("_bytes")


def shuffled(docs: DataFrame, seed: int = 13, bucket: int = BUCKET) -> DataFrame:
    """docs (with size) in buckets of shuffled rows, written: _bucket, _sub and _place (from 0) tell the order. _draw goes."""
    rows = scattered(docs, seed, bucket)
    tasks = max(1, min(50_000, rows.select("_bucket", "_sub").distinct().count()))
    dealt = rows.repartition(tasks, "_bucket", "_sub").sortWithinPartitions("_bucket", "_sub", "_draw")
    names = dealt.columns
    schema = extended(dealt, _place="long")

    def given(held: list[pa.RecordBatch], at: tuple[int, int], begun: int) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        order = np.random.default_rng([seed, *at, begun]).permutation(len(table))  # Fisher-Yates
        place = np.arange(begun, begun + len(table), dtype=np.int64)
        for i in range(0, len(table), 500):
            some = table.take(pa.array(order[i : i + 500])).combine_chunks()
            yield from some.append_column("_place", pa.array(place[i : i + 500])).select([*names, "_place"]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, size, begun = [], None, 0, 0
        for batch in batches:
            keys = np.stack([batch[c].to_numpy() for c in ("_bucket", "_sub")], 1)
            for some in np.split(np.arange(len(batch)), np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1):
                if not len(some):
                    continue
                key = tuple(int(v) for v in keys[some[0]])
                if held and (key != at or size > LARGE * bucket):  # rows come by their draws: what is there is a random part of the bucket
                    yield from given(held, at, begun)
                    begun, held, size = (begun + sum(map(len, held)), [], 0) if key == at else (0, [], 0)
                elif key != at:
                    begun = 0
                at = key
                piece = batch.slice(int(some[0]), len(some))
                held.append(piece)
                size += piece["size"].to_numpy().sum()
        if held:
            yield from given(held, at, begun)

    return written(dealt.mapInArrow(run, schema), "buckets").drop("_draw")


def dealt(docs: DataFrame, shards: int = SHARDS, seed: int = 13, bucket: int = BUCKET) -> DataFrame:
    """docs with size, text_crc32, law ('rows'), shard, slot (from 0, without gaps) and grown_shard (null: rows move where a
    shard is added).

    Every row gets one place, rows that repeat or have null ids included; shards' counts differ by one at most, so that with
    fewer rows than shards some are empty. Reruns agree, but for rows of buckets that equal rows have made too large. Null and
    empty texts have size 1. Columns of these names are replaced, others kept. The order is that of written tables; docs
    should be read from files, as a table that is made anew with other rows in its places would be dealt otherwise.
    """
    if shards < 1:
        raise ValueError("there must be a shard")
    docs = sized(docs.drop("law", "shard", "slot", "grown_shard", "_draw", "_bucket", "_sub", "_place"))
    rows = shuffled(docs, seed, bucket)
    counts = rows.groupBy("_bucket", "_sub").agg(F.count("*").alias("_rows"))  # a row for each bucket
    offsets = small(running_totals(counts, [F.col("_bucket"), F.col("_sub")], "_rows", "_before", "bucket-rows"), MANY_BUCKETS)
    total = counts.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    less, more = divmod(total, shards)
    long_ones = more * (less + 1)  # places of the first shards, which have one row more
    out = rows.join(offsets.select("_bucket", "_sub", "_before"), ["_bucket", "_sub"]).withColumn("_at", F.col("_before") + F.col("_place"))
    out = out.withColumn("shard", F.expr(f"int(if(_at < {long_ones}, _at div {less + 1}, {more} + (_at - {long_ones}) div {max(less, 1)}))"))
    out = out.withColumn("slot", F.col("_at") - F.col("shard") * less - F.least("shard", F.lit(more)))
    return out.withColumns({"law": F.lit(LAW), "grown_shard": F.lit(None).cast("int")}).select(*docs.columns, "law", "shard", "slot", "grown_shard")


def write(docs: DataFrame, folder: str | None = None, **params) -> DataFrame:
    """Shards as Parquet folders shard=0, shard=1, ... below folder (a new one in the shared folder), rows in the order of
    slot within a file; read back, with shard as a column. A bucket's rows go to one shard or two, so that files are as many
    as buckets and shards together."""
    out = dealt(docs, **params)
    folder = folder or scratch(docs.sparkSession, "shards")
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(folder)
    return docs.sparkSession.read.schema(out.schema).parquet(folder).select(out.columns)

"""The same operators over streams: counts, sessions, deduplication, conversation state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import mutate
from ..sources import events_stream
from ..functions import hmac_sha256
from ..store import scratch


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def drained(stream: DataFrame, mode: str = "append", checkpoint: str | None = None, every: str | None = None, provider: str | None = None) -> DataFrame:
    """Runs a stream over all that is there and returns what it has put out, read from Parquet files in the shared folder.

    Executors write the rows; none pass the driver. checkpoint: a folder for state and output, by which a later call goes
    on and returns the output of all calls; by default a new one. every: run batches at this interval until nothing is left
    (a service would let the query run on); by default as fast as they come. provider: the class of the state store, by
    default the session's.
    """
    spark = stream.sparkSession
    folder = checkpoint or scratch(spark, "stream")
    out, schema = f"{folder}/out", T.StructType([T.StructField(f.name, f.dataType) for f in stream.schema])  # without marks of watermarks
    spark.createDataFrame([], schema).write.mode("ignore").parquet(out if mode == "append" else f"{out}/none")  # a stream without events writes nothing
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state")
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", out)
    else:  # a batch that is tried again replaces its files; in complete mode each replaces the one before
        writer = writer.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/{i if mode == 'update' else 'all'}"))
    usual = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, provider or usual)
    try:
        running = writer.start()  # settings are taken over here
    finally:
        spark.conf.set(_PROVIDER, usual)
    if every:
        running.processAllAvailable()
        running.stop()
    else:
        running.awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", mode != "append").parquet(out)


def hourly_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts of each event type by hour; an hour closes when the watermark has passed it."""
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("hour"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user: events with pauses below the gap."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("start"), "n")


def once(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def signed(events: DataFrame, body: str, signature: str, key: bytes) -> DataFrame:
    """Events whose signature is the HMAC-SHA256 of their body; without body or signature none is."""
    return events.filter(hmac_sha256(F.col(body), key) == F.lower(F.col(signature)))


def machine(stream: DataFrame, key: str, order: list[str], transitions: dict[str, list[str]], start: str, checkpoint: str | None = None) -> DataFrame:
    """key, status, n_ignored after all that the stream holds: a status machine whose state is a table in the shared folder.

    Each batch's events, in their order, are folded by ranges into maps of states (see mutate.fold_status), which advance the
    table of the batch before; a batch that is tried again writes the same table again. Events later than their batch count
    when they come. checkpoint: a folder by which a later call goes on.
    """
    spark, folder, schema = stream.sparkSession, checkpoint or scratch(stream.sparkSession, "machine"), T.StructType([stream.schema[key], T.StructField("status", T.StringType()), T.StructField("n_ignored", T.LongType())])
    at = f"{folder}/states"
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{at}/batch=-1")

    def step(df: DataFrame, i: int) -> None:
        before = df.sparkSession.read.schema(schema).parquet(f"{at}/batch={i - 1}")
        mutate.advance(before, df, key, order, transitions, start).write.mode("overwrite").parquet(f"{at}/batch={i}")

    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    every = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(at)
    return every.filter(F.col("batch") == every.agg(F.max("batch")).scalar()).drop("batch")


def conversation_state(events: DataFrame) -> DataFrame:
    """user_id, last_type, n: running state of each user, put out for each batch that has events of the user.

    last_type is the type of the newest event by (ts, event_id) of all batches so far, in whatever order they come. The
    state is an aggregate with this event and the count: parts of it are made before events are dealt out by user.
    """
    newest = F.max_by("event_type", F.when(F.col("event_type").isNotNull(), F.struct("ts", "event_id")))
    return events.groupBy("user_id").agg(newest.alias("last_type"), F.count("*").alias("n"))


def stream_hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(hourly_counts(events_stream(spark, sf_dir))).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(sessions(events_stream(spark, sf_dir))).withColumn("start", F.col("start").cast("timestamp_ntz"))


def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(once(events_stream(spark, sf_dir), "event_id")).groupBy("event_type").agg(F.count("*").alias("n"))


def stream_conv_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drained(conversation_state(events_stream(spark, sf_dir)), "update")
    return out.groupBy("user_id").agg(F.max(F.struct("n", "last_type")).alias("x")).select("user_id", F.col("x.last_type").alias("last_type"), F.col("x.n").alias("n"))

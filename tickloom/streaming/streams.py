"""Structured Streaming: packet normalisation, first-seen state, windowed totals, followers. Watermarks are an addition."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.payloads import first_number, first_text


def files(spark: SparkSession, path: str, schema: T.StructType, per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files that land in a folder (or one file)."""
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    folder, _, name = path.rstrip("/").rpartition("/")
    if name.endswith(".parquet"):
        return reader.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "false").parquet(f"{folder}/{name}")
    return reader.parquet(path)


def normalize_packets(stream: DataFrame, payload: str, zone: str = "Asia/Kolkata") -> DataFrame:
    """Typed columns from a schemaless JSON packet, the raw text kept; epoch seconds or milliseconds become event times."""
    raw = F.col(payload)
    epoch = first_number(raw, ["ltt", "exchange_time", "timestamp", "ts"])
    seconds = F.when(epoch > 1e11, epoch / 1000).otherwise(epoch)
    ts = F.timestamp_seconds(seconds)
    return stream.select(
        first_text(raw, ["security_id", "SecurityId", "token"]).alias("security_id"), first_number(raw, ["ltp", "LTP", "last_price"]).alias("last_price"), first_number(raw, ["volume", "vol"]).cast("long").alias("volume"),
        first_number(raw, ["oi", "OI", "open_interest"]).cast("long").alias("open_interest"), first_number(raw, ["depth[0].bid_price", "bid"]).alias("best_bid"), first_number(raw, ["depth[0].ask_price", "ask"]).alias("best_ask"),
        ts.alias("event_time"), F.to_date(F.from_utc_timestamp(F.to_utc_timestamp(ts, F.current_timezone()), zone)).alias("trade_date"), raw.alias("payload_json"),
    )


def first_seen(stream: DataFrame, keys: list[str], ts: str, delay: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark; state is dropped once the watermark passes."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def first_seen_batch(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(ts).alias("first_seen"))


def windowed_totals(stream: DataFrame, ts: str, key: str, value: str, width: str, delay: str) -> DataFrame:
    """Count and sum per key and tumbling window; in append mode a window is final when the watermark has passed it."""
    timed = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", delay)
    g = timed.groupBy(F.window("__ts", width), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(key, F.col("window.start").cast("timestamp_ntz").alias("bucket"), "n", "total")


def run_available(spark: SparkSession, path: str, schema: T.StructType, build, mode: str = "complete") -> DataFrame:
    """Run a streaming plan over all data there is and return its result as a batch table in the shared folder."""
    root = f"{(spark.conf.get('spark.checkpoint.dir', None) or '/tmp/checkpoints').rstrip('/')}/stream-{uuid.uuid4().hex}"
    folder, _, name = path.rpartition("/")
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if not _is_file(spark, path) else f"{folder}/{name.replace('.parquet', '')}*.parquet")
    out = f"{root}/out"
    plan = build(source)

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    q = plan.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(plan.schema).parquet(out)


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def to_parquet(stream: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None, available_now: bool = True):
    """An exactly-once Parquet sink; resumes from its checkpoint."""
    w = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    if partition_by:
        w = w.partitionBy(*partition_by)
    return (w.trigger(availableNow=True) if available_now else w).start()


def follow(stream: DataFrame, checkpoint: str, handle):
    """Hand each new batch to ``handle(batch, id)`` once; a batch is repeated after a failure, so the handler must be idempotent."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Streaming readings: source, newest reading per window, and draining to a table."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline import fixtures, schemas
from ridgeline.functions import wind
from ridgeline.session import _ensure_checkpoint_dir
from ridgeline.streaming import state

WATERMARK = "20 minutes"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 64, inbox: str | None = None) -> DataFrame:
    """Event files of a folder as a stream with an event-time column; inbox: a folder for the closing row (see drain_closed)."""
    source = spark.readStream.schema(schemas.EVENT).option("maxFilesPerTrigger", files_per_trigger)
    raw = source.option("pathGlobFilter", "events*.parquet").parquet(folder)
    if inbox is not None:
        raw = raw.unionByName(spark.readStream.schema(schemas.EVENT).parquet(inbox))
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def readings(spark: SparkSession, folder: str, files_per_trigger: int = 64, inbox: str | None = None) -> DataFrame:
    """The observation projection of the event stream."""
    _, columns = fixtures.PROJECTIONS["observations"]
    return read_events(spark, folder, files_per_trigger, inbox).selectExpr(*[f"{expr} AS {name}" for expr, name in columns])


def newest_per_window(stream: DataFrame, minutes: int = 10) -> DataFrame:
    """Newest valid reading per station and tumbling window; later rows than the watermark are dropped."""
    valid = stream.where(wind.valid_reading(F.col("ws"), F.col("wd"))).withWatermark("ts", WATERMARK)
    last = F.max_by(F.struct("ws", "wd", "ts", "event_id"), F.struct("ts", "event_id")).alias("last")
    return (valid.groupBy(F.window("ts", f"{minutes} minutes").alias("win"), "station_id").agg(last)
            .select("win", "station_id", "last.*"))


def drain(stream: DataFrame, mode: str = "update", base: str | None = None) -> DataFrame:
    """Process everything available and return the emitted rows as a table.

    Each batch overwrites its own folder, so a repeated batch leaves no
    duplicate.  Rows and query state live in the shared folder.  A source
    without rows gives an empty table.  base: the folder of an earlier drain
    of the same stream, which goes on where that one ended.
    """
    spark = stream.sparkSession
    base = base or _new_base(spark)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{base}/rows/batch={batch_id}")

    schema = T.StructType([*stream.schema.fields, T.StructField("batch_id", T.LongType())])
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{base}/rows/start")
    query = (stream.writeStream.outputMode(mode).foreachBatch(write)
             .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{base}/rows")


def _new_base(spark: SparkSession) -> str:
    return f"{_ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def drain_closed(spark: SparkSession, make, mode: str = "append") -> DataFrame:
    """Drain a stream in event time to its end: make(inbox) builds it from the source and the folder of the closing row.

    The first run processes all files.  Then a row without an id and far in the future (pandas ends in 2262) is put in the inbox, and the second run, which
    goes on from the first one's state, moves the watermark past all rows that still wait.
    """
    base = _new_base(spark)
    inbox = f"{base}/inbox"
    spark.createDataFrame([], schemas.EVENT).write.parquet(inbox)
    name, provider = state.STORE
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        drain(make(inbox), mode, base)
        closing = {"ts": F.expr("TIMESTAMP '2200-01-01 00:00:00'"), "user_id": F.lit(-1)}  # a join drops null keys before the watermark sees them
        spark.range(1).select(*[closing.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], schemas.EVENT).schema]
                              ).write.mode("append").parquet(inbox)
        return drain(make(inbox), mode, base)
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def answered(requests: DataFrame, responses: DataFrame, minutes: int = 30) -> DataFrame:
    """Requests with the responses of their path within `minutes`, as a join of two streams; unanswered ones once the time is over.

    Both sides carry path_id, event_id and ts with a watermark; state behind the watermark and the time bound is dropped.
    """
    left = requests.select("path_id", F.col("event_id").alias("request_id"), F.col("ts").alias("asked"))
    right = responses.select(F.col("path_id").alias("_path"), F.col("event_id").alias("response_id"), F.col("ts").alias("replied"), "kind")
    in_time = (F.col("replied") >= F.col("asked")) & (F.col("replied") <= F.col("asked") + F.expr(f"INTERVAL {minutes} MINUTES"))
    return left.join(right, (F.col("path_id") == F.col("_path")) & in_time, "left").drop("_path")


def latest_updates(rows: DataFrame, keys) -> DataFrame:
    """Update mode may emit a key in several batches; keep its last row."""
    others = [c for c in rows.columns if c not in keys]
    return (rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch_id").alias("_r"))
            .select(*keys, "_r.*").drop("batch_id"))

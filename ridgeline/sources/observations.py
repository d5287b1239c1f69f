"""Station readings: text lines, validity and the newest reading of a window."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeline.functions import times, wind


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Whitespace-separated readings; comments, blanks and unreadable lines are skipped."""
    text = F.trim(F.regexp_replace(F.col(column), r"\s+", " "))
    fields = F.split(text, " ")
    readings = lines.where((text != "") & ~F.col(column).startswith("#")).select(
        F.try_to_timestamp(fields[0], F.lit(times.STAMP)).alias("ts"),
        F.get(fields, 1).try_cast("int").alias("station_id"),
        F.get(fields, 2).try_cast("double").alias("wd"),
        F.get(fields, 3).try_cast("double").alias("ws"))
    return readings.where(F.col("wd").isNotNull() & F.col("ws").isNotNull())


def valid(readings: DataFrame) -> DataFrame:
    return readings.where(wind.valid_reading(F.col("ws"), F.col("wd")))


def with_window(readings: DataFrame, minutes: int = 10) -> DataFrame:
    """Tumbling window of each reading."""
    return readings.withColumn("win", F.window(F.col("ts").cast("timestamp"), f"{minutes} minutes"))


def newest(readings: DataFrame, keys: list, tie: str = "event_id") -> DataFrame:
    """Newest valid reading per key; the aggregate combines before it shuffles."""
    last = F.max_by(F.struct("ws", "wd", "ts"), F.struct("ts", tie)).alias("last")
    return (valid(readings).groupBy(*keys).agg(last)
            .select(*[F.col(k) for k in keys], "last.ws", "last.wd", "last.ts"))


def as_of(readings: DataFrame, start: Column, end: Column) -> DataFrame:
    """Newest valid reading per station inside [start, end]."""
    return newest(readings.where(F.col("ts").between(start, end)), ["station_id"])


def as_of_each(requests: DataFrame, readings: DataFrame, minutes: int = 10, tie: str = "event_id") -> DataFrame:
    """Newest valid reading within ``minutes`` before each request time, for many requests.

    Requests carry request_id, station_id and at.  Requests and readings are
    put in one order per (station, time slice), where each reading is also in
    the slice after its own; a request takes the last reading before it.  No
    request meets more than one reading, however many share its slice.
    """
    slice_s = minutes * 60

    def slot(ts):
        return F.floor(F.unix_seconds(ts.cast("timestamp")) / slice_s)

    found = F.struct("ws", "wd", "ts")
    served = valid(readings).select("station_id", F.col("ts").alias("_t"), F.lit(0).alias("_asks"), F.col(tie).cast("long").alias("_tie"),
                                    found.alias("_found"), F.explode(F.array(slot(F.col("ts")), slot(F.col("ts")) + 1)).alias("slot"))
    asked = requests.select("station_id", F.col("at").alias("_t"), F.lit(1).alias("_asks"), F.struct("request_id", "at").alias("_request"),
                            slot(F.col("at")).alias("slot"))
    before = W.partitionBy("station_id", "slot").orderBy("_t", "_asks", "_tie").rowsBetween(W.unboundedPreceding, -1)
    rows = (served.unionByName(asked, allowMissingColumns=True)
            .withColumn("last", F.last("_found", ignorenulls=True).over(before)).where("_request is not null"))
    return (rows.where(F.col("last.ts") >= F.col("_request.at") - F.expr(f"INTERVAL {minutes} MINUTES"))
            .select("_request.request_id", "station_id", "_request.at", "last.ws", "last.wd", "last.ts"))


def with_station(readings: DataFrame, stations: DataFrame) -> DataFrame:
    """Attach position, elevation and name; Spark broadcasts the small dimension by its size."""
    return readings.join(stations, "station_id")

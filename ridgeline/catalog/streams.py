"""Stream queries, checked against the SQL of their batch twins."""

from pyspark.sql import functions as F

from ridgeline.catalog.decisions import approval_events  # noqa: F401  (defines the shared SQL)
from ridgeline.catalog.registry import query
from ridgeline.catalog.winds import VALID
from ridgeline.streaming import observations, state


@query("station_id:i window_start ws* wd*", f"""
SELECT station_id, strftime(time_bucket(INTERVAL 10 MINUTE, ts), '%Y-%m-%d %H:%M') AS window_start,
  arg_max(ws, (ts, event_id)) AS ws, arg_max(wd, (ts, event_id)) AS wd
FROM observations WHERE {VALID} GROUP BY station_id, time_bucket(INTERVAL 10 MINUTE, ts)""", ["observations"])
def stream_latest_obs(spark, sf):
    """Newest valid reading per station and window from the event stream."""
    rows = observations.drain(observations.newest_per_window(observations.readings(spark, sf)))
    return observations.latest_updates(rows, ["win", "station_id"]).withColumn(
        "window_start", F.date_format("win.start", "yyyy-MM-dd HH:mm"))


@query("event_id:i station_id:i wind_locked", "SELECT * FROM locks", ["locks"])
def stream_lock(spark, sf):
    """Lock state per station kept as stream state, in event time."""
    def make(inbox):
        rows = observations.readings(spark, sf, inbox=inbox).withWatermark("ts", observations.WATERMARK)
        return state.wind_lock(rows.select(F.col("station_id").cast("bigint").alias("key"), "event_id", "ts", F.col("gust").alias("wind_max")))

    return observations.drain_closed(spark, make).withColumn("station_id", F.col("key"))


def asked_and_answered(spark, sf, inbox, **how):
    """The approval events of the stream: path_id, ts (with a watermark), event_id, kind, new_risk."""
    kind = (F.when(F.col("event_type").isin("view", "signup"), "request")
            .when(F.col("event_type") == "purchase", "approve").otherwise("reject"))
    events = observations.read_events(spark, sf, inbox=inbox, **how).withWatermark("ts", observations.WATERMARK)
    return events.select(F.col("user_id").alias("path_id"), "ts", "event_id", kind.alias("kind"),
                         ((F.col("event_id") * 37 % 100) / 100.0).alias("new_risk"))


@query("event_id:i path_id:i request_id:i outcome risk_reduction*", """
SELECT *, CASE WHEN outcome = 'approved' THEN coalesce(last_value(CASE WHEN outcome = 'approved' THEN request_risk END IGNORE NULLS)
  OVER (PARTITION BY path_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) - request_risk END AS risk_reduction
FROM replies""", ["replies"])
def stream_approvals(spark, sf):
    """T5: approval workflow per path kept as stream state, in event time."""
    return observations.drain_closed(spark, lambda inbox: state.approvals(asked_and_answered(spark, sf, inbox)))


@query("request_id:i path_id:i response_id:i kind", """
SELECT q.event_id AS request_id, q.path_id, r.event_id AS response_id, r.kind FROM asks q LEFT JOIN asks r
  ON r.path_id = q.path_id AND r.kind <> 'request' AND r.ts >= q.ts AND r.ts <= q.ts + INTERVAL 30 MINUTE WHERE q.kind = 'request'""", ["asks"])
def stream_answers(spark, sf):
    """Requests joined with the responses within half an hour as two streams; unanswered requests once their time is over."""
    def make(inbox):
        requests, responses = (asked_and_answered(spark, sf, inbox) for _ in range(2))
        return observations.answered(requests.where("kind = 'request' or event_id is null"), responses.where("kind != 'request'"))

    return observations.drain_closed(spark, make).where("request_id is not null")

"""Queries over wind lock, re-routing and approvals, with their SQL."""

from pyspark.sql import functions as F

from ridgeline.catalog.registry import cte, query
from ridgeline.catalog.routes import both_risks
from ridgeline.fixtures import shape, table
from ridgeline.operators import decisions

# wind per station over time; a path flies under the station its id points to
cte("locks", """SELECT *, coalesce(last_value(state IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY ts, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS wind_locked FROM (
  SELECT *, CASE WHEN gust <= 12 THEN true WHEN gust > 13 THEN false END AS state FROM observations) AS o""", "observations")


def station_history(spark, sf):
    return shape(spark, sf, "observations").select("event_id", "ts", "station_id", F.col("gust").alias("wind_max"))


@query("event_id:i station_id:i wind_locked", "SELECT * FROM locks", ["locks"])
def wind_lock(spark, sf):
    """T3 (batch form): lock state after every reading."""
    return decisions.wind_lock(station_history(spark, sf), keys=("station_id",))


cte("last_lock", "SELECT station_id, arg_max(wind_locked, (ts, event_id)) AS wind_locked, count(*) AS n_steps FROM locks GROUP BY station_id", "locks")
cte("decided", """SELECT r.path_id, wind_locked, risk_current, risk_new,
  CASE WHEN risk_current > 0 THEN (risk_current - risk_new) / risk_current ELSE 0e0 END AS risk_drop
FROM risks r JOIN last_lock l ON l.station_id = r.path_id % 25""", "risks", "last_lock")


@query("path_id:i wind_locked risk_drop* reroute verdict", """
SELECT *, NOT wind_locked AND risk_drop >= 25e-2 AS reroute, CASE WHEN wind_locked THEN 'wind within limit: path locked'
  WHEN risk_drop >= 25e-2 THEN 'risk down' ELSE 'risk change' END AS verdict FROM decided""", ["decided"])
def reroute_decision(spark, sf):
    """T4: re-route when unlocked and the new path is a quarter safer."""
    held = decisions.wind_lock(station_history(spark, sf), keys=("station_id",))
    latest = held.groupBy("station_id").agg(F.max_by("wind_locked", F.struct("ts", "event_id")).alias("wind_locked"))
    both = both_risks(spark, sf).withColumn("station_id", (F.col("path_id") % 25).cast("int"))
    out = decisions.reroute(both.join(latest, "station_id"))
    return out.withColumn("verdict", F.when(F.col("wind_locked"), F.col("reason"))
                          .otherwise(F.regexp_extract("reason", "^(risk [a-z]+)", 1)))


cte("asks", """SELECT event_id, ts, user_id AS path_id, (event_id * 37 % 100) / 1e2 AS new_risk,
  CASE WHEN event_type IN ('view', 'signup') THEN 'request' WHEN event_type = 'purchase' THEN 'approve' ELSE 'reject' END AS kind
FROM events""")
cte("replies", """SELECT path_id, ts, event_id, CASE WHEN prev = 'request' THEN prev_id END AS request_id,
  CASE WHEN prev = 'request' THEN prev_risk END AS request_risk,
  CASE WHEN prev IS DISTINCT FROM 'request' THEN 'no pending request' WHEN kind = 'approve' THEN 'approved' ELSE 'rejected' END AS outcome
FROM (SELECT *, lag(kind) OVER w AS prev, lag(event_id) OVER w AS prev_id, lag(new_risk) OVER w AS prev_risk FROM asks
  WINDOW w AS (PARTITION BY path_id ORDER BY ts, event_id)) AS a WHERE kind <> 'request'""", "asks")


def approval_events(spark, sf):
    kind = (F.when(F.col("event_type").isin("view", "signup"), "request")
            .when(F.col("event_type") == "purchase", "approve").otherwise("reject"))
    return table(spark, sf, "events").select(
        "event_id", "ts", F.col("user_id").alias("path_id"), kind.alias("kind"),
        ((F.col("event_id") * 37 % 100) / 100.0).alias("new_risk"))


@query("event_id:i path_id:i request_id:i outcome risk_reduction*", """
SELECT *, CASE WHEN outcome = 'approved' THEN coalesce(last_value(CASE WHEN outcome = 'approved' THEN request_risk END IGNORE NULLS)
  OVER (PARTITION BY path_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) - request_risk END AS risk_reduction
FROM replies""", ["replies"])
def approvals(spark, sf):
    """T5, J10 (batch form): responses paired with the pending request."""
    return decisions.approvals(approval_events(spark, sf))


@query("path_id:i n_answered:i approved_share* recent", """
SELECT path_id, count(*) AS n_answered, avg(CASE WHEN outcome = 'approved' THEN 1e0 ELSE 0e0 END) AS approved_share,
  array_to_string(list(outcome ORDER BY rn) FILTER (rn <= 10), ',') AS recent
FROM (SELECT *, row_number() OVER (PARTITION BY path_id ORDER BY ts DESC, event_id DESC) AS rn FROM replies
  WHERE outcome <> 'no pending request') AS t GROUP BY path_id""", ["replies"])
def approval_history(spark, sf):
    """Answered requests, approved share, last ten outcomes."""
    return decisions.approval_summary(decisions.approvals(approval_events(spark, sf)))


@query("path_id:i path_length:i risk* risk_level wind_locked approval_pending current_waypoint:i", """
SELECT p.path_id, p.n AS path_length, r.risk_current AS risk, CASE WHEN r.risk_current < 3e-1 THEN 'low' WHEN r.risk_current < 6e-1 THEN 'medium' ELSE 'high' END AS risk_level,
  coalesce(l.wind_locked, false) AS wind_locked, coalesce(a.kind = 'request', false) AS approval_pending,
  least(3 * coalesce(l.n_steps, 0), p.n - 1) AS current_waypoint
FROM (SELECT path_id, count(*) AS n FROM path_points GROUP BY path_id) AS p JOIN risks r USING (path_id)
LEFT JOIN last_lock l ON l.station_id = p.path_id LEFT JOIN (SELECT path_id, arg_max(kind, (ts, event_id)) AS kind FROM asks GROUP BY path_id) AS a
ON a.path_id = p.path_id""", ["path_points", "risks", "last_lock", "asks"])
def path_status(spark, sf):
    """State summary of every path."""
    held = decisions.wind_lock(station_history(spark, sf), keys=("station_id",))
    history = held.withColumn("path_id", F.col("station_id").cast("bigint"))
    lengths = shape(spark, sf, "path_points").groupBy("path_id").agg(F.count("*").alias("path_length"))
    risk = both_risks(spark, sf).select("path_id", F.col("risk_current").alias("risk"))
    return decisions.status(history, risk, approval_events(spark, sf), lengths)

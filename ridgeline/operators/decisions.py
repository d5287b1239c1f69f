"""Decisions over time: wind lock, re-routing, approvals.

State carried along time is found per time slice first; only one row per key
and slice is put in order across slices, so a busy key is not one task.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ridgeline import params as P

KEY = ("path_id",)


def carry(df: DataFrame, value: Column, name: str, keys=KEY, order=("ts", "event_id"),
          include_current: bool = True, slice_seconds: int = 86_400) -> DataFrame:
    """Last non-null value up to each row (or strictly before it), in time order."""
    rows = df.withColumns({"_slice": F.floor(F.unix_seconds(F.col(order[0]).cast("timestamp")) / slice_seconds),
                           "_value": value})
    last = rows.where(F.col("_value").isNotNull()).groupBy(*keys, "_slice").agg(
        F.max_by("_value", F.struct(*order)).alias("_last"))
    every = rows.select(*keys, "_slice").distinct()
    slices = every.join(last, [*keys, "_slice"], "left")
    earlier = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    slices = slices.select(*keys, "_slice", F.last("_last", ignorenulls=True).over(earlier).alias("_before"))
    inside = (W.partitionBy(*keys, "_slice").orderBy(*order)
              .rowsBetween(W.unboundedPreceding, 0 if include_current else -1))
    return (rows.join(slices, [*keys, "_slice"])
            .withColumn(name, F.coalesce(F.last("_value", ignorenulls=True).over(inside), "_before"))
            .drop("_slice", "_value", "_before"))


def wind_lock(history: DataFrame, wind: str = "wind_max", limit: float = P.LOCK_WIND,
              band: float = P.LOCK_BAND, **how) -> DataFrame:
    """Locked while the wind allows it: locks at the limit, unlocks only above limit + band.

    Readings inside the band keep the state; before a decisive reading the
    path is unlocked.
    """
    decisive = F.when(F.col(wind) <= limit, True).when(F.col(wind) > limit + band, False)
    held = carry(history, decisive, "wind_locked", **how)
    return held.withColumn("wind_locked", F.coalesce("wind_locked", F.lit(False)))


def reroute(df: DataFrame, gain: float = P.REROUTE_GAIN) -> DataFrame:
    """Re-route when unlocked and the new path lowers the risk enough.

    Needs wind_locked, wind_max, threshold, risk_current, risk_new.
    """
    current, new = F.col("risk_current"), F.col("risk_new")
    rate = F.when(current > 0, (current - new) / current).otherwise(0.0)
    percent = F.format_string("%s", F.round(rate * 100, 1).cast("string"))
    return df.withColumns({
        "risk_drop": rate,
        "reroute": ~F.col("wind_locked") & (rate >= gain),
        "reason": F.when(F.col("wind_locked"), "wind within limit: path locked")
        .when(rate >= gain, F.concat(F.lit("risk down "), percent, F.lit("%")))
        .otherwise(F.concat(F.lit("risk change "), percent, F.lit("% too small")))})


def approvals(events: DataFrame, **how) -> DataFrame:
    """Pair each response with the pending request of its path.

    A newer request replaces the pending one, and a response clears it; so a
    response succeeds exactly when the event before it is a request.
    events: path_id, ts, event_id, kind (request | approve | reject), new_risk.
    """
    before = carry(events, F.struct("kind", "new_risk", F.col("event_id").alias("request_id")), "_prev",
                   include_current=False, **how)
    replies = before.where(F.col("kind") != "request")
    pending = F.col("_prev.kind") == "request"
    ok = F.coalesce(pending, F.lit(False))
    replies = replies.select(
        "path_id", "ts", "event_id", F.when(ok, F.col("_prev.request_id")).alias("request_id"),
        F.when(ok, F.col("_prev.new_risk")).alias("request_risk"),
        F.when(~ok, "no pending request").when(F.col("kind") == "approve", "approved")
        .otherwise("rejected").alias("outcome"))
    approved = F.when(F.col("outcome") == "approved", F.col("request_risk"))
    held = carry(replies, approved, "_old", include_current=False, **how)
    return held.withColumn("risk_reduction", F.when(
        F.col("outcome") == "approved", F.coalesce("_old", F.lit(0.0)) - F.col("request_risk"))).drop("_old")


def approval_summary(replies: DataFrame, last_n: int = 10) -> DataFrame:
    """Answered requests, approved share and the newest outcomes per path."""
    answered = replies.where(F.col("outcome") != "no pending request")
    totals = answered.groupBy("path_id").agg(
        F.count("*").alias("n_answered"),
        F.avg(F.when(F.col("outcome") == "approved", 1.0).otherwise(0.0)).alias("approved_share"))
    newest = W.partitionBy("path_id").orderBy(F.desc("ts"), F.desc("event_id"))
    recent = (answered.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= last_n)
              .groupBy("path_id").agg(F.array_join(F.transform(
                  F.array_sort(F.collect_list(F.struct("_rn", "outcome"))), lambda s: s["outcome"]), ",")
                  .alias("recent")))
    return totals.join(recent, "path_id")


def status(history: DataFrame, risk: DataFrame, replies: DataFrame, lengths: DataFrame) -> DataFrame:
    """Latest state per path: lock, risk and its level, pending request, length, waypoint after as many steps as readings."""
    from ridgeline.functions.paths import risk_level
    from ridgeline.operators.paths import waypoint_progress
    latest = history.groupBy("path_id").agg(
        F.max_by("wind_locked", F.struct("ts", "event_id")).alias("wind_locked"), F.count("*").alias("_steps"))
    pending = replies.groupBy("path_id").agg(
        (F.max_by("kind", F.struct("ts", "event_id")) == "request").alias("approval_pending"))
    out = (lengths.join(risk, "path_id", "left").join(latest, "path_id", "left")
           .join(pending, "path_id", "left"))
    risk_now = F.coalesce("risk", F.lit(0.0))
    return out.select("path_id", "path_length", risk_now.alias("risk"), risk_level(risk_now).alias("risk_level"),
                      F.coalesce("wind_locked", F.lit(False)).alias("wind_locked"),
                      F.coalesce("approval_pending", F.lit(False)).alias("approval_pending"),
                      waypoint_progress(F.coalesce("_steps", F.lit(0)), F.col("path_length")).alias("current_waypoint"))

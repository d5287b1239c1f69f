"""Observation time windows as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

STAMP = "yyyyMMddHHmm"


def floor_5min(ts: Column) -> Column:
    minute = F.minute(ts)
    return F.date_trunc("hour", ts) + F.make_dt_interval(mins=minute - F.pmod(minute, F.lit(5)))


def base_hour(ts: Column) -> Column:
    """The current hour from minute 40 on, else the previous one."""
    hour = F.date_trunc("hour", ts)
    return F.when(F.minute(ts) >= 40, hour).otherwise(hour - F.expr("INTERVAL 1 HOUR"))


def live_window(now: Column) -> tuple[Column, Column]:
    """Readings arrive about 15 minutes late, so ask for 20 to 10 minutes ago."""
    return now - F.expr("INTERVAL 20 MINUTES"), now - F.expr("INTERVAL 10 MINUTES")


def replay_window(stamp: Column) -> tuple[Column, Column]:
    """The ten minutes up to a given 12-digit stamp."""
    end = F.to_timestamp(stamp, STAMP)
    return end - F.expr("INTERVAL 10 MINUTES"), end

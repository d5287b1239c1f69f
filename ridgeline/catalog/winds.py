"""Queries over readings and interpolated wind, with their SQL."""

from pyspark.sql import functions as F

from ridgeline.catalog.registry import cte, mod360, query
from ridgeline.catalog.scalars import base_cells
from ridgeline.catalog.zones import RANKED, candidate_sql, greedy_sql
from ridgeline.fixtures import shape
from ridgeline.operators import evaluation, stations
from ridgeline.plans import zones
from ridgeline.session import staged
from ridgeline.sources import observations as obs

cte("net", "SELECT s.*, l.ws, l.wd, -sin(radians(l.wd)) AS u, -cos(radians(l.wd)) AS v FROM stations s JOIN latest l USING (station_id)",
    "stations", "latest")


def latest_readings(spark, sf):
    return obs.newest(shape(spark, sf, "observations"), ["station_id"])


def live_network(spark, sf):
    return staged(stations.network(shape(spark, sf, "stations"), latest_readings(spark, sf)))


VALID = "ws >= -50 AND wd >= -50 AND ws <= 100 AND wd <= 360"


@query("station_id:i window_start ws* wd*", f"""
SELECT station_id, strftime(time_bucket(INTERVAL 10 MINUTE, ts), '%Y-%m-%d %H:%M') AS window_start,
  arg_max(ws, (ts, event_id)) AS ws, arg_max(wd, (ts, event_id)) AS wd
FROM observations WHERE {VALID} GROUP BY station_id, time_bucket(INTERVAL 10 MINUTE, ts)""", ["observations"])
def latest_per_window(spark, sf):
    """T1, T2 (batch form): newest valid reading per station and ten-minute window."""
    rows = obs.newest(obs.with_window(shape(spark, sf, "observations")), ["station_id", "win"])
    return rows.withColumn("window_start", F.date_format("win.start", "yyyy-MM-dd HH:mm"))


@query("request_id:i station_id:i ws* wd*", f"""
SELECT request_id, station_id, ws, wd FROM (
  SELECT r.event_id AS request_id, r.station_id, o.ws, o.wd,
    row_number() OVER (PARTITION BY r.event_id ORDER BY o.ts DESC, o.event_id DESC) AS rn
  FROM observations r JOIN observations o ON o.station_id = r.station_id AND o.ts <= r.ts AND o.ts >= r.ts - INTERVAL 10 MINUTE
  WHERE o.ws >= -50 AND o.wd >= -50 AND o.ws <= 100 AND o.wd <= 360) AS t WHERE rn = 1""", ["observations"])
def as_of_readings(spark, sf):
    """Newest valid reading within ten minutes before each request."""
    o = shape(spark, sf, "observations")
    asked = o.select(F.col("event_id").alias("request_id"), "station_id", F.col("ts").alias("at"))
    return obs.as_of_each(asked, o)


@query("cell_id:i near_station:i wind_speed* wind_direction*", """
SELECT cell_id, station_id AS near_station, ws AS wind_speed, wd AS wind_direction FROM (
  SELECT c.cell_id, n.*, row_number() OVER (PARTITION BY c.cell_id ORDER BY
    (n.lat - c.latitude) * (n.lat - c.latitude) + (n.lon - c.longitude) * (n.lon - c.longitude), n.station_id) AS rn
  FROM terrain_cells c CROSS JOIN net n) AS t WHERE rn = 1""", ["terrain_cells", "net"])
def nearest_station(spark, sf):
    """Wind of the nearest station at every cell."""
    return stations.nearest_wind(shape(spark, sf, "terrain_cells"), live_network(spark, sf))


cte("idw", """
SELECT *, greatest(iws * pow((greatest(elevation, 0e0) + 10e0) / (greatest(ielev, 0e0) + 10e0), 27e-2), 0e0) AS wind_speed,
  """ + mod360("degrees(atan2(-wind_u, -wind_v))") + """ AS wind_direction FROM (
  SELECT cell_id, any_value(elevation) AS elevation, sum(w * ws) / sum(w) AS iws, sum(w * u) / sum(w) AS wind_u,
    sum(w * v) / sum(w) AS wind_v, sum(w * elev) / sum(w) AS ielev
  FROM (SELECT c.cell_id, c.elevation, n.ws, n.u, n.v, n.elev, 1e0 / (
      pow((n.lat - c.latitude) * pi() / 180e0 * 6371000e0, 2)
      + pow((n.lon - c.longitude) * pi() / 180e0 * 6371000e0 * cos(radians(o.lat)), 2)
      + pow((n.elev - c.elevation) * 180e0, 2)) AS w
    FROM terrain_cells c CROSS JOIN net n CROSS JOIN (SELECT avg(lat) AS lat FROM net) AS o) AS d GROUP BY cell_id) AS s""",
    "terrain_cells", "net")


@query("cell_id:i wind_speed* wind_u* wind_v* wind_direction*", "SELECT * FROM idw", ["idw"])
def idw_wind(spark, sf):
    """Terrain-aware inverse-distance wind at every cell."""
    return stations.idw_wind(shape(spark, sf, "terrain_cells"), live_network(spark, sf))


# Delaunay by brute force: a triangle counts when no fourth station lies in its circle
CIRCLE = """((a.lon - d.lon) * ((b.lat - d.lat) * (pow(c.lon - d.lon, 2) + pow(c.lat - d.lat, 2)) - (c.lat - d.lat) * (pow(b.lon - d.lon, 2) + pow(b.lat - d.lat, 2)))
 - (a.lat - d.lat) * ((b.lon - d.lon) * (pow(c.lon - d.lon, 2) + pow(c.lat - d.lat, 2)) - (c.lon - d.lon) * (pow(b.lon - d.lon, 2) + pow(b.lat - d.lat, 2)))
 + (pow(a.lon - d.lon, 2) + pow(a.lat - d.lat, 2)) * ((b.lon - d.lon) * (c.lat - d.lat) - (c.lon - d.lon) * (b.lat - d.lat)))"""
TURN = "((b.lon - a.lon) * (c.lat - a.lat) - (b.lat - a.lat) * (c.lon - a.lon))"
cte("tri", f"""
SELECT a.station_id AS i, b.station_id AS j, c.station_id AS k, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2,
  c.lat AS lat3, c.lon AS lon3, a.ws AS ws1, b.ws AS ws2, c.ws AS ws3, a.u AS u1, b.u AS u2, c.u AS u3, a.v AS v1, b.v AS v2, c.v AS v3
FROM net a JOIN net b ON a.station_id < b.station_id JOIN net c ON a.station_id < c.station_id AND b.station_id <> c.station_id
WHERE {TURN} > 0 AND NOT EXISTS (SELECT 1 FROM net d WHERE d.station_id NOT IN (a.station_id, b.station_id, c.station_id) AND {CIRCLE} > 0)""",
    "net")


@query("i:i j:i k:i", "SELECT i, j, k FROM tri", ["tri"])
def station_mesh(spark, sf):
    """Delaunay triangles of the network that has readings."""
    return stations.triangles(live_network(spark, sf))


DET = "((lat2 - lat3) * (lon1 - lon3) + (lon3 - lon2) * (lat1 - lat3))"
cte("barycentric", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY i, j, k) AS rn FROM (
  SELECT *, 1e0 - wa - wb AS wc FROM (
    SELECT c.cell_id, t.*, ((lat2 - lat3) * (c.longitude - lon3) + (lon3 - lon2) * (c.latitude - lat3)) / {DET} AS wa,
      ((lat3 - lat1) * (c.longitude - lon3) + (lon1 - lon3) * (c.latitude - lat3)) / {DET} AS wb
    FROM terrain_cells c CROSS JOIN tri t) AS x) AS y WHERE wa >= -1e-9 AND wb >= -1e-9 AND wc >= -1e-9) AS z WHERE rn = 1""",
    "terrain_cells", "tri")
cte("near_wind", """SELECT * FROM (
  SELECT c.cell_id, n.ws, n.u, n.v, row_number() OVER (PARTITION BY c.cell_id ORDER BY
    (n.lat - c.latitude) * (n.lat - c.latitude) + (n.lon - c.longitude) * (n.lon - c.longitude), n.station_id) AS rn
  FROM terrain_cells c CROSS JOIN net n) AS t WHERE rn = 1""", "terrain_cells", "net")
cte("linear", "SELECT *, " + mod360("degrees(atan2(-wind_u, -wind_v))") + """ AS wind_direction FROM (
  SELECT c.cell_id, b.cell_id IS NOT NULL AS in_hull,
    coalesce(wa * ws1 + wb * ws2 + wc * ws3, n.ws) * pow((c.elevation + 60e0) / 10e0, 27e-2) AS wind_speed,
    coalesce(wa * u1 + wb * u2 + wc * u3, n.u) AS wind_u, coalesce(wa * v1 + wb * v2 + wc * v3, n.v) AS wind_v
  FROM terrain_cells c JOIN near_wind n USING (cell_id) LEFT JOIN barycentric b USING (cell_id)) AS l""",
    "terrain_cells", "near_wind", "barycentric")


@query("cell_id:i wind_speed* wind_u* wind_v* wind_direction*", "SELECT * FROM linear", ["linear"])
def linear_wind(spark, sf):
    """Linear wind inside the hull, nearest station outside, carried to work altitude."""
    return stations.linear_wind(shape(spark, sf, "terrain_cells"), live_network(spark, sf))


cte("live_pairs", """SELECT p.*, l.wind_speed AS live_ws, l.wind_direction AS live_wd FROM pairs p JOIN linear l USING (cell_id)""",
    "pairs", "linear")
cte("live_candidates", candidate_sql("live_pairs", "live_ws", "live_wd"), "live_pairs")
LIVE = greedy_sql("live", "live_candidates", 3, 0.000455)


@query(RANKED, " UNION ALL ".join(f"SELECT * FROM {n}" for n in LIVE), LIVE)
def ranked_zones_live(spark, sf):
    """M8 with X6: ranked zones under the interpolated live wind."""
    cells = stations.linear_wind(base_cells(spark, sf), live_network(spark, sf))
    return zones.ranked_zones(shape(spark, sf, "incidents"), zones.score_cells(cells))


cte("forecast", "SELECT cell_id, latitude, longitude, round(elevation / 150e0, 3) AS ws FROM terrain_cells", "terrain_cells")
cte("residual", """SELECT station_id, lat, lon, ows - fws AS u, 0e0 AS v, ows - fws AS ws FROM (
  SELECT n.station_id, n.lat, n.lon, n.ws AS ows, f.ws AS fws, row_number() OVER (PARTITION BY n.station_id ORDER BY
    sqrt(pow(n.lat - f.latitude, 2) + pow(n.lon - f.longitude, 2)), f.cell_id) AS rn
  FROM net n CROSS JOIN forecast f) AS t WHERE rn = 1""", "net", "forecast")
cte("corrected", """SELECT f.cell_id, f.ws, coalesce(wa * r1.ws + wb * r2.ws + wc * r3.ws, 0e0) AS bias,
  f.ws + coalesce(wa * r1.ws + wb * r2.ws + wc * r3.ws, 0e0) AS ws_corrected
FROM forecast f LEFT JOIN barycentric b USING (cell_id) LEFT JOIN residual r1 ON r1.station_id = b.i
LEFT JOIN residual r2 ON r2.station_id = b.j LEFT JOIN residual r3 ON r3.station_id = b.k""", "forecast", "barycentric", "residual")


def forecast_points(spark, sf):
    return shape(spark, sf, "terrain_cells").select(
        "cell_id", "latitude", "longitude", F.round(F.col("elevation") / 150.0, 3).alias("ws"))


@query("cell_id:i ws* bias* ws_corrected*", "SELECT * FROM corrected", ["corrected"])
def bias_corrected(spark, sf):
    """Forecast corrected by the linearly spread station residuals."""
    observed = live_network(spark, sf).select("station_id", "lat", "lon", "ws")
    return stations.bias_corrected(forecast_points(spark, sf), observed)


@query("rmse_before* rmse_after* improvement_pct*", """
SELECT *, (rmse_before - rmse_after) / rmse_before * 100e0 AS improvement_pct FROM (
SELECT sqrt(avg(pow(c.ws - i.wind_speed, 2))) AS rmse_before, sqrt(avg(pow(c.ws_corrected - i.wind_speed, 2))) AS rmse_after
FROM corrected c JOIN idw i USING (cell_id)) AS r""", ["corrected", "idw"])
def correction_rmse(spark, sf):
    """Error of the forecast before and after the correction, against the inverse-distance field."""
    truth = idw_wind(spark, sf).select("cell_id", "wind_speed")
    return evaluation.rmse_change(bias_corrected(spark, sf).join(truth, "cell_id"), "ws", "ws_corrected", "wind_speed")


@query("window_start max_ws* station_name detail", f"""
SELECT strftime(win, '%Y-%m-%d %H:%M') AS window_start, max(ws) AS max_ws, arg_max(station_name, (ws, -station_id)) AS station_name,
  array_to_string(list_sort(list(station_name || '=' || CAST(round(ws, 2) AS VARCHAR))), ' ') AS detail
FROM (SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS win, station_id, station_name, arg_max(ws, (ts, event_id)) AS ws
  FROM observations JOIN stations USING (station_id) WHERE {VALID} GROUP BY ALL) AS t
GROUP BY win ORDER BY max_ws DESC, window_start DESC LIMIT 15""", ["observations", "stations"])
def strong_wind_top(spark, sf):
    """The fifteen windows with the strongest wind, every station listed."""
    return evaluation.strongest_wind(obs.with_station(shape(spark, sf, "observations"), shape(spark, sf, "stations")))


@query("stamp n_stations:i", """
SELECT strftime(day + to_hours(CAST(hour AS BIGINT)), '%Y%m%d%H%M') AS stamp, n_stations FROM (
  SELECT date_trunc('day', ts) AS day, count(DISTINCT station_id) AS n_stations FROM observations GROUP BY ALL) AS d,
  (VALUES (9), (15)) AS h(hour)""", ["observations"])
def scenario_times(spark, sf):
    """Scan times, two per observed day."""
    from ridgeline.operators.augment import scenario_times as times_of
    days = shape(spark, sf, "observations").groupBy(F.date_trunc("day", "ts").alias("day")).agg(
        F.count_distinct("station_id").alias("n_stations"))
    return times_of(days).join(days, "day")

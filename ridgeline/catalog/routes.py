"""Queries over path tables, straight routes and edge costs, with their SQL."""

from pyspark.sql import functions as F

from ridgeline import params as P
from ridgeline.catalog.rasters import corridor_max, grids, terrain_layer
from ridgeline.catalog.registry import cte, hav, query
from ridgeline.catalog.scalars import steps
from ridgeline.fixtures import shape
from ridgeline.operators import paths, routing, spatial
from ridgeline.sources import routes as route_source

cte("wlayer", """SELECT *, ((cell_id * 7919) % 230) / 1e1 AS wind_speed, NOT is_open AS is_forest,
  -sin(radians(CAST((cell_id * 37) % 360 AS DOUBLE))) AS wind_u, -cos(radians(CAST((cell_id * 37) % 360 AS DOUBLE))) AS wind_v,
  greatest(0e0, least(1e0, coalesce(density_ratio, 0e0))) AS density FROM layer""", "layer")
cte("pts", """SELECT p.path_id, p.seq, p.grid_id, p.row, p.col, l.latitude, l.longitude, l.elevation, l.slope, l.wind_speed,
  l.is_open, l.is_forest, l.is_ridge FROM path_points p LEFT JOIN wlayer l USING (grid_id, row, col)""", "path_points", "wlayer")
cte("legs", f"""SELECT *, {hav('latitude', 'longitude', 'nlat', 'nlon')} AS segment_m FROM (
  SELECT *, lead(latitude) OVER w AS nlat, lead(longitude) OVER w AS nlon, lead(slope) OVER w AS nslope,
    count(*) OVER (PARTITION BY path_id) AS n FROM pts WINDOW w AS (PARTITION BY path_id ORDER BY seq)) AS l""", "pts")

LAYERS = ["latitude", "longitude", "elevation", "slope", "wind_speed", "is_open", "is_forest", "is_ridge"]


def windy_layer(spark, sf):
    """Terrain layer with a made-up but full wind field derived from the cell id."""
    k = F.col("cell_id")
    wd = F.radians(((k * 37) % 360).cast("double"))
    return terrain_layer(spark, sf).withColumns({
        "wind_speed": ((k * 7919) % 230) / 10.0, "is_forest": ~F.col("is_open"),
        "wind_u": -F.sin(wd), "wind_v": -F.cos(wd)})


def points(spark, sf):
    return spatial.layers_at(shape(spark, sf, "path_points"), windy_layer(spark, sf), LAYERS)


@query("path_id:i seq:i slope* wind_speed* is_ridge", "SELECT * FROM pts", ["pts"])
def layer_lookup(spark, sf):
    """Grid layers at every path point."""
    return points(spark, sf)


@query("path_id:i seq:i step_m* dist_m*", f"""
SELECT path_id, seq, step_m, sum(step_m) OVER (PARTITION BY path_id ORDER BY seq) AS dist_m FROM (
  SELECT path_id, seq, coalesce({hav('plat', 'plon', 'latitude', 'longitude')}, 0e0) AS step_m FROM (
    SELECT *, lag(latitude) OVER w AS plat, lag(longitude) OVER w AS plon FROM pts
    WINDOW w AS (PARTITION BY path_id ORDER BY seq)) AS a) AS b""", ["pts"])
def path_distance(spark, sf):
    """Distance from the previous point and from the start."""
    return paths.cumulative_distance(points(spark, sf))


@query("path_id:i total_m* slope_mean* windy_share*", """
SELECT path_id, coalesce(sum(segment_m), 0e0) AS total_m, avg(slope) AS slope_mean,
  avg(CASE WHEN wind_speed > CASE path_id % 3 WHEN 0 THEN 10 WHEN 1 THEN 20 ELSE 15 END THEN 1e0 ELSE 0e0 END) AS windy_share
FROM legs GROUP BY path_id""", ["legs"])
def path_metrics(spark, sf):
    """Length, mean slope and windy share per path, limit by aircraft class."""
    k = F.col("path_id") % 3
    return paths.evaluate(points(spark, sf), F.when(k == 0, "light").when(k == 1, "heavy").otherwise("other"))


@query("path_id:i distance_km* n_points:i slope_mean* wind_max* wind_mean* elev_diff*", """
SELECT path_id, coalesce(sum(segment_m), 0e0) / 1e3 AS distance_km, count(*) AS n_points, avg(slope) AS slope_mean,
  max(wind_speed) AS wind_max, avg(wind_speed) AS wind_mean, abs(arg_max(elevation, seq) - arg_min(elevation, seq)) AS elev_diff
FROM legs GROUP BY path_id""", ["legs"])
def route_summary(spark, sf):
    """A4: briefing numbers per path."""
    return paths.summary(points(spark, sf))


PENALTY = "(pow(slope / 45e0, 15e-1) * 6e-1 + least(wind_speed, 15e0) / 15e0 * 3e-1 + CASE WHEN is_forest THEN 5e-1 ELSE 0e0 END + CASE WHEN is_ridge THEN 3e-1 ELSE 0e0 END)"
cte("penal", f"SELECT *, {PENALTY} AS penalty FROM pts", "pts")
SAY_WIND = "CASE WHEN wind_speed > 8 THEN 'wind ' || CAST(CAST(round_even(wind_speed, 0) AS INT) AS VARCHAR) || ' m/s' END"


def three(x, a, b):
    return f"CASE WHEN {x} < {a} THEN 'safe' WHEN {x} < {b} THEN 'caution' ELSE 'danger' END"


@query("path_id:i seq:i penalty* band relative_band briefing_band flight_band reason flight_reason", f"""
SELECT path_id, seq, penalty, {three('penalty', '5e-1', '8e-1')} AS band, {three('penalty / mx', '5e-1', '7e-1')} AS relative_band,
  {three('penalty', '3e-1', '6e-1')} AS briefing_band,
  CASE WHEN wind_speed > 12 THEN 'danger' WHEN wind_speed > 8 THEN 'caution' ELSE 'safe' END AS flight_band,
  CASE WHEN r = '' THEN 'good' ELSE r END AS reason, CASE WHEN fr = '' THEN 'good' ELSE fr END AS flight_reason FROM (
  SELECT *, nullif(max(penalty) OVER (PARTITION BY path_id), 0) AS mx, concat_ws(' · ',
      CASE WHEN slope > 30 THEN 'steep ' || CAST(CAST(round_even(slope, 0) AS INT) AS VARCHAR) || ' deg' END, {SAY_WIND},
      CASE WHEN is_forest THEN 'forest' END, CASE WHEN is_ridge THEN 'ridge' END) AS r,
    concat_ws(' · ', {SAY_WIND}, CASE WHEN is_ridge THEN 'ridge' END) AS fr FROM penal) AS p""", ["penal"])
def path_penalty(spark, sf):
    """Penalty, bands and reasons of every path point."""
    return paths.penalties(points(spark, sf))


@query("path_id:i seq:i alt_m* dist_m* terrain_m* wind_direction*", f"""
SELECT path_id, seq, dist_m, elevation AS terrain_m, wind_direction,
  CASE WHEN n - 1 - seq < ramp THEN lo_end + (cruise - lo_end) * (n - seq) / (ramp + 1e0)
       WHEN seq < ramp THEN lo_start + (cruise - lo_start) * (seq + 1) / (ramp + 1e0) ELSE cruise END AS alt_m
FROM (SELECT d.*, n, greatest(1, n // 7) AS ramp, top + 150e0 AS cruise, first_m + 45e0 AS lo_start, last_m + 45e0 AS lo_end
  FROM (SELECT path_id, seq, elevation, CAST((cell_id * 37) % 360 AS DOUBLE) AS wind_direction,
      sum(step_m) OVER (PARTITION BY path_id ORDER BY seq) AS dist_m FROM (
    SELECT p.path_id, p.seq, p.elevation, l.cell_id, coalesce({hav('plat', 'plon', 'p.latitude', 'p.longitude')}, 0e0) AS step_m FROM (
      SELECT *, lag(latitude) OVER w AS plat, lag(longitude) OVER w AS plon FROM pts
      WINDOW w AS (PARTITION BY path_id ORDER BY seq)) AS p JOIN wlayer l USING (grid_id, row, col)) AS a) AS d
  JOIN (SELECT path_id, count(*) AS n, max(elevation) AS top, arg_min(elevation, seq) AS first_m, arg_max(elevation, seq) AS last_m
        FROM pts GROUP BY path_id) AS t USING (path_id)) AS x""", ["pts", "wlayer"])
def flight_profile(spark, sf):
    """Level cruise with ramps along every path, with distance and wind direction."""
    from ridgeline.functions import wind
    p = spatial.layers_at(shape(spark, sf, "path_points"), windy_layer(spark, sf), [*LAYERS, "wind_u", "wind_v"])
    out = paths.flight_profile(p.withColumn("terrain_m", F.col("elevation")))
    return out.withColumn("wind_direction", wind.direction_of(F.col("wind_u"), F.col("wind_v")))


@query("path_id:i seq:i row:i col:i", """
SELECT path_id, seq, row, col FROM (
  SELECT *, lag(row) OVER w AS pr, lag(col) OVER w AS pc, lead(row) OVER w AS nr, lead(col) OVER w AS nc FROM path_points
  WINDOW w AS (PARTITION BY path_id ORDER BY seq)) AS t
WHERE pr IS NULL OR nr IS NULL OR seq <= 1 OR (nr - row) <> (row - pr) OR (nc - col) <> (col - pc)""", ["path_points"])
def smooth_waypoints(spark, sf):
    """First point, changes of direction, last point."""
    return paths.smoothed(shape(spark, sf, "path_points"))


@query("path_id:i seq:i row:i col:i", """
SELECT path_id, seq, row, col FROM (
  SELECT *, lag(row) OVER w AS pr, lag(col) OVER w AS pc, lead(row) OVER w AS nr, lead(col) OVER w AS nc FROM line
  WINDOW w AS (PARTITION BY path_id ORDER BY seq)) AS t
WHERE pr IS NULL OR nr IS NULL OR seq <= 1 OR (nr - row) <> (row - pr) OR (nc - col) <> (col - pc)""", ["line"])
def smooth_lines(spark, sf):
    """R9 on straight lines, where runs of one direction collapse."""
    return paths.smoothed(paths.straight_cells(requests(spark, sf)))


WALK_S = "segment_m / (greatest(6e0 * exp(-35e-1 * abs(tan(radians(nslope)) + 5e-2)), 3e-1) * 1000e0 / 3600e0)"


@query("path_id:i walk_min* flight_min* total_min*", f"""
SELECT path_id, w AS walk_min, f AS flight_min, w + f AS total_min FROM (
  SELECT path_id, coalesce(sum({WALK_S}), 0e0) / 60e0 AS w, coalesce(sum(segment_m), 0e0) / 42e0 / 60e0 AS f FROM legs GROUP BY path_id) AS t""",
       ["legs"])
def eta(spark, sf):
    """Walking minutes, flight minutes and their sum."""
    p = points(spark, sf)
    return paths.total_eta(paths.flight_minutes(paths.cumulative_distance(p)), paths.walk_times(p))


RISK = ("(least(wind_speed / 20e0, 1e0) * 2e-1 + least(slope / 90e0, 1e0) * 5e-1 + CASE WHEN is_open THEN 0e0 ELSE 3e-1 END * 2e-1"
        " + CASE WHEN is_ridge THEN 2e-1 ELSE 0e0 END * 1e-1)")
# the current path as given; the new path 40 rows further, so part of it leaves the grid
cte("risks", f"""
SELECT path_id, max(CASE WHEN kind = 'now' THEN risk END) AS risk_current, max(CASE WHEN kind = 'new' THEN risk END) AS risk_new,
  max(CASE WHEN kind = 'now' THEN wind_max END) AS wind_max FROM (
  SELECT kind, path_id, coalesce(sum(CASE WHEN seq < n - 1 AND wind_speed IS NOT NULL THEN {RISK} END) / nullif(max(n) - 1, 0), 0e0) AS risk,
    coalesce(max(wind_speed), 0e0) AS wind_max FROM (
    SELECT 'now' AS kind, pts.*, count(*) OVER (PARTITION BY path_id) AS n FROM pts
    UNION ALL SELECT 'new', p.path_id, p.seq, p.grid_id, p.row + 40, p.col, l.latitude, l.longitude, l.elevation, l.slope, l.wind_speed,
      l.is_open, l.is_forest, l.is_ridge, count(*) OVER (PARTITION BY p.path_id)
    FROM path_points p LEFT JOIN wlayer l ON l.grid_id = p.grid_id AND l.row = p.row + 40 AND l.col = p.col) AS u GROUP BY kind, path_id) AS v
GROUP BY path_id""", "pts", "path_points", "wlayer")


def both_risks(spark, sf):
    now = points(spark, sf)
    moved = shape(spark, sf, "path_points").withColumn("row", F.col("row") + 40)
    new = spatial.layers_at(moved, windy_layer(spark, sf), LAYERS)
    return (paths.path_risk(now, "risk_current").join(paths.path_risk(new, "risk_new"), "path_id")
            .join(paths.max_wind(now), "path_id"))


@query("path_id:i risk_current* risk_new* wind_max*", "SELECT * FROM risks", ["risks"])
def path_risk(spark, sf):
    """Mean segment risk of two paths, points outside the grid counted in the divisor."""
    return both_risks(spark, sf)


cte("requests", """SELECT s.incident_id AS path_id, s.grid_id, s.row AS r0, s.col AS c0, CAST(g.n_rows // 2 AS INT) AS r1,
  CAST(g.n_cols // 2 AS INT) AS c1, CASE s.heli_size WHEN 'small' THEN 'light' ELSE 'heavy' END AS size
FROM snapped s JOIN grids g USING (grid_id)""", "snapped", "grids")


def requests(spark, sf):
    """One route request per incident: from its cell to the centre of its grid."""
    g = grids(spark, sf)
    at = spatial.snap_to_grid(shape(spark, sf, "incidents"), g).join(g.select("grid_id", "n_rows", "n_cols"), "grid_id")
    return at.select(F.col("incident_id").alias("path_id"), "grid_id", F.col("row").alias("r0"), F.col("col").alias("c0"),
                     F.floor(F.col("n_rows") / 2).cast("int").alias("r1"), F.floor(F.col("n_cols") / 2).cast("int").alias("c1"),
                     routing.aircraft_class(F.col("heli_size")).alias("size"))


cte("line", """SELECT path_id, grid_id, seq, CAST(trunc(r0 + coalesce((r1 - r0) * seq / nullif(n - 1, 0), 0)) AS INT) AS row,
  CAST(trunc(c0 + coalesce((c1 - c0) * seq / nullif(n - 1, 0), 0)) AS INT) AS col FROM (
  SELECT *, unnest(range(n)) AS seq FROM (SELECT *, greatest(abs(r1 - r0), abs(c1 - c0)) + 1 AS n FROM requests) AS a) AS b""", "requests")
cte("line_even", """SELECT path_id, grid_id, seq, CAST(round_even(r0 + coalesce((r1 - r0) * seq / nullif(n - 1, 0), 0), 0) AS INT) AS row,
  CAST(round_even(c0 + coalesce((c1 - c0) * seq / nullif(n - 1, 0), 0), 0) AS INT) AS col FROM (
  SELECT *, unnest(range(n)) AS seq FROM (SELECT *, greatest(abs(r1 - r0), abs(c1 - c0)) + 1 AS n FROM requests) AS a) AS b""", "requests")


@query("path_id:i seq:i row:i col:i kind", """
SELECT path_id, seq, row, col, 'truncate' AS kind FROM line UNION ALL SELECT path_id, seq, row, col, 'round' FROM line_even""",
       ["line", "line_even"])
def straight_cells(spark, sf):
    """Cells on the straight line, truncated and rounded."""
    r = requests(spark, sf)
    return (paths.straight_cells(r).withColumn("kind", F.lit("truncate"))
            .unionByName(paths.straight_cells(r, "round").withColumn("kind", F.lit("round"))))


cte("way", """SELECT path_id, grid_id, seq, CAST(floor(CASE WHEN seq = 9 THEN r1 ELSE r0 + seq * ((r1 - r0) / 9e0) END) AS INT) AS row,
  CAST(floor(CASE WHEN seq = 9 THEN c1 ELSE c0 + seq * ((c1 - c0) / 9e0) END) AS INT) AS col
FROM requests, (SELECT unnest(range(10)) AS seq) AS s""", "requests")
cte("wcost", "SELECT *, pow(slope / 45e0, 15e-1) + CASE WHEN is_ridge THEN 3e-1 ELSE 0e0 END AS cost FROM wlayer", "wlayer")


@query("path_id:i seq:i row:i col:i", """
SELECT path_id, seq, row + coalesce(dr, 0) AS row, col + coalesce(dc, 0) AS col FROM (
  SELECT w.path_id, w.seq, w.row, w.col, m.dr, m.dc, row_number() OVER (PARTITION BY w.path_id, w.seq ORDER BY m.total NULLS LAST, m.dr, m.dc) AS rn
  FROM way w JOIN wcost h ON h.grid_id = w.grid_id AND h.row = w.row AND h.col = w.col
  LEFT JOIN LATERAL (SELECT dr, dc, c.cost + (abs(dr) + abs(dc)) * 15e-1 AS total
    FROM wcost c, (SELECT unnest(range(-4, 5)) AS dr) AS a, (SELECT unnest(range(-4, 5)) AS dc) AS b
    WHERE c.grid_id = w.grid_id AND c.row = w.row + dr AND c.col = w.col + dc AND h.slope > 30
      AND c.cost + (abs(dr) + abs(dc)) * 15e-1 < h.cost) AS m ON true) AS t WHERE rn = 1""", ["way", "wcost"])
def waypoint_refine(spark, sf):
    """Waypoints on the line, moved off steep ground where a cheaper cell is near."""
    return paths.refined_waypoints(requests(spark, sf), windy_layer(spark, sf))


cte("corridor", """SELECT grid_id, row, col, max(m) OVER (PARTITION BY grid_id, col ORDER BY row ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS corridor_max
FROM (SELECT *, max(elevation) OVER (PARTITION BY grid_id, row ORDER BY col ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m
FROM terrain_cells) AS t""", "terrain_cells")
cte("flights", f"""SELECT path_id, grid_id, seq, latitude, longitude,
    CAST(least(greatest(ceil(round((longitude - lon0) / lon_step, 9) - 5e-1), 0), n_rows - 1) AS INT) AS row,
    CAST(least(greatest(ceil(round((latitude - lat0) / lat_step, 9) - 5e-1), 0), n_cols - 1) AS INT) AS col FROM (
  SELECT i.incident_id AS path_id, i.grid_id, seq, 38.25e0 + (i.latitude - 38.25e0) * (seq / 39e0) AS latitude,
    128.5e0 + (i.longitude - 128.5e0) * (seq / 39e0) AS longitude, lat0, lon0, lat_step, lon_step, n_rows, n_cols
  FROM incidents i JOIN grids g USING (grid_id), (SELECT unnest(range(40)) AS seq) AS s) AS f""", "incidents", "grids")


@query("path_id:i seq:i terrain_m* alt_m* dist_m*", f"""
SELECT path_id, seq, terrain_m, sum(step) OVER (PARTITION BY path_id ORDER BY seq) AS dist_m,
  CASE WHEN 39 - seq < 5 THEN e + (top + 150e0 - e) * ((39 - seq) / 5e0) WHEN seq < 5 THEN s + (top + 150e0 - s) * (seq / 5e0) ELSE top + 150e0 END AS alt_m
FROM (SELECT f.path_id, f.seq, c.corridor_max AS terrain_m, max(c.corridor_max) OVER (PARTITION BY f.path_id) AS top,
    first_value(c.corridor_max) OVER w + 45e0 AS s,
    last_value(c.corridor_max) OVER (PARTITION BY f.path_id ORDER BY f.seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) + 45e0 AS e,
    coalesce({hav('lag(f.latitude) OVER w', 'lag(f.longitude) OVER w', 'f.latitude', 'f.longitude')}, 0e0) AS step
  FROM flights f JOIN corridor c USING (grid_id, row, col) WINDOW w AS (PARTITION BY f.path_id ORDER BY f.seq)) AS x""",
       ["flights", "corridor"])
def straight_flight(spark, sf):
    """Straight flight from the base to every incident above the corridor maximum."""
    legs = shape(spark, sf, "incidents").select(
        F.col("incident_id").alias("path_id"), "grid_id", F.lit(P.BASE_LAT).alias("lat0"), F.lit(P.BASE_LON).alias("lon0"),
        F.col("latitude").alias("lat1"), F.col("longitude").alias("lon1"))
    return paths.straight_flight(legs, corridor_max(spark, sf), grids(spark, sf))


@query("grid_id:i row:i col:i start_row:i start_col:i severity*", """
SELECT grid_id, r1 AS row, c1 AS col, r0 AS start_row, c0 AS start_col, severity FROM (
  SELECT *, row_number() OVER (PARTITION BY grid_id, r1, c1 ORDER BY severity DESC, r0, c0) AS rn FROM (
    SELECT q.grid_id, r1, c1, r0, c0, round(avg(l.slope), 9) AS severity FROM (
      SELECT *, unnest(range(greatest(abs(r1 - r0), abs(c1 - c0)) + 1)) AS seq, greatest(abs(r1 - r0), abs(c1 - c0)) AS m FROM (
        SELECT s.grid_id, s.row AS r1, s.col AS c1, s.row + dr AS r0, s.col + dc AS c0, n_rows, n_cols
        FROM (SELECT DISTINCT grid_id, row, col FROM snapped) AS s JOIN grids g USING (grid_id),
          (SELECT unnest(range(-35, 36, 5)) AS dr) AS a, (SELECT unnest(range(-35, 36, 5)) AS dc) AS b
        WHERE NOT (abs(dr) < 15 AND abs(dc) < 15)) AS o WHERE r0 >= 0 AND r0 < n_rows AND c0 >= 0 AND c0 < n_cols) AS q
    JOIN layer l ON l.grid_id = q.grid_id AND l.row = CAST(round_even(r0 + (r1 - r0) * seq / m, 0) AS INT)
      AND l.col = CAST(round_even(c0 + (c1 - c0) * seq / m, 0) AS INT) GROUP BY q.grid_id, r1, c1, r0, c0) AS v) AS t WHERE rn = 1""",
       ["snapped", "grids", "layer"])
def hardest_start(spark, sf):
    """Start whose straight line to the incident is steepest on average."""
    g = grids(spark, sf)
    return paths.hardest_start(spatial.snap_to_grid(shape(spark, sf, "incidents"), g), terrain_layer(spark, sf), g)


cte("line_legs", f"""SELECT *, {hav('latitude', 'longitude', 'nlat', 'nlon')} AS segment_m FROM (
  SELECT b.path_id, b.seq, l.latitude, l.longitude, l.slope, lead(l.latitude) OVER w AS nlat, lead(l.longitude) OVER w AS nlon,
    lead(l.slope) OVER w AS nslope FROM line_even b JOIN wlayer l USING (grid_id, row, col)
  WINDOW w AS (PARTITION BY b.path_id ORDER BY b.seq)) AS x""", "line_even", "wlayer")


@query("path_id:i distance_m* slope_mean* slope_max* cliff_cells:i nodes:i walk_min*", f"""
SELECT path_id, coalesce(sum(segment_m), 0e0) AS distance_m, avg(slope) AS slope_mean, max(slope) AS slope_max,
  count(*) FILTER (slope > 45) AS cliff_cells, count(*) AS nodes, coalesce(sum({WALK_S}), 0e0) / 60e0 AS walk_min
FROM line_legs GROUP BY path_id""", ["line_legs"])
def straight_route_stats(spark, sf):
    """Distance, slopes, cliffs and time of the straight walking route."""
    line = paths.straight_cells(requests(spark, sf), "round")
    return paths.route_stats(spatial.layers_at(line, windy_layer(spark, sf), LAYERS))


@query("path_id:i row:i col:i visits:i weighted*", """
SELECT v.path_id, v.row, v.col, visits, (pow(l.slope / 45e0, 15e-1) + 1e-1) * pow(85e-2, visits) AS weighted FROM (
  SELECT path_id, grid_id, row, col, count(*) AS visits FROM (
    SELECT *, count(*) OVER (PARTITION BY path_id) AS n, path_id % 4 AS cur FROM path_points) AS p
  WHERE cur < n - 1 AND seq >= cur AND seq < cur + 3 GROUP BY path_id, grid_id, row, col) AS v JOIN layer l USING (grid_id, row, col)""",
       ["path_points", "layer"])
def direction_discount(spark, sf):
    """Penalty of the next three waypoints, discounted per visit."""
    p = shape(spark, sf, "path_points")
    current = p.select("path_id").distinct().withColumn("at_seq", F.col("path_id") % 4)
    penalty = terrain_layer(spark, sf).select(
        "grid_id", "row", "col", (F.pow(F.col("slope") / 45.0, F.lit(1.5)) + 0.1).alias("penalty"))
    return paths.direction_discount(p, current, penalty)


@query("path_id:i waypoint:i", """
SELECT path_id, least(3 * (path_id % 9), count(*) - 1) AS waypoint FROM path_points GROUP BY path_id""", ["path_points"])
def waypoint_progress(spark, sf):
    """Three waypoints per step, capped at the end of the path."""
    n = shape(spark, sf, "path_points").groupBy("path_id").agg(F.count("*").alias("n"))
    return n.withColumn("waypoint", paths.waypoint_progress(F.col("path_id") % 9, F.col("n")))


@query("path_id:i point", """
SELECT path_id, '{"index":' || seq || ',"row":' || row || ',"col":' || col || ',"is_forest":' || CAST(is_forest AS VARCHAR) || '}' AS point FROM pts""",
       ["pts"])
def route_json(spark, sf):
    """Flattened export rows as JSON."""
    rows = points(spark, sf).select("path_id", F.col("seq").alias("index"), "row", "col", "is_forest")
    return route_source.json_rows(rows)


@query("path_id:i index:i lat* lon* height* slope* wind_speed* is_forest penalty*", """
SELECT path_id, seq AS index, latitude AS lat, longitude AS lon, elevation AS height, slope, wind_speed, is_forest, penalty FROM penal""",
       ["penal"])
def route_export(spark, sf):
    """Flattened export columns with the penalty."""
    return route_source.export_rows(paths.penalties(points(spark, sf)))


# ---------------------------------------------------------------- edge costs
OFF = "angle"
DIAG = "CASE WHEN a.row <> b.row AND a.col <> b.col THEN 1.414e0 ELSE 1e0 END"


def dir_step(size):
    mid, tail = P.STEP_WIND_DIR[size]
    return f"(CASE WHEN angle <= 45 THEN 0e0 WHEN angle < 135 THEN {mid:e} ELSE {tail:e} END)"


def walk_sql(size):
    forest = (f"(1e0 + 15e-1 * {steps('(b.density * 100e0)', P.STEP_DENSITY[size])} + "
              f"5e-1 * {steps('b.canopy', P.STEP_HEIGHT[size])})")
    return (f"CASE WHEN b.slope > 45 THEN NULL ELSE 10e0 * {DIAG} / (greatest(6e0 * exp(-35e-1 * abs(tan(radians(b.slope)) + 5e-2)), 1e-1)"
            f" * 1000e0 / 3600e0) * {forest} END")


def fly_sql(size):
    return (f"CASE WHEN ws > {P.WIND_LIMIT[size]:e} THEN NULL ELSE diag * (1e0 + 6e-1 * {dir_step(size)} + 5e-1 * "
            f"{steps('ws', P.STEP_WIND[size])}) * (1e0 + CASE WHEN ridge THEN 3e-1 ELSE 0e0 END) + abs(climb) / 1e1 * 3e-1 END")


cte("adjacent", f"""SELECT a.grid_id, a.row, a.col, b.row AS to_row, b.col AS to_col, {DIAG} AS diag, b.wind_speed AS ws, b.is_ridge AS ridge,
  b.elevation - a.elevation AS climb, b.slope AS b_slope, {walk_sql('light')} AS walk_light, {walk_sql('heavy')} AS walk_heavy,
  (b.longitude - a.longitude) * cos(radians(b.latitude)) AS east, b.latitude - a.latitude AS north, b.wind_u, b.wind_v,
  {hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} AS metres
FROM wlayer a JOIN wlayer b ON a.grid_id = b.grid_id AND b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1
  AND NOT (a.row = b.row AND a.col = b.col)""", "wlayer")
LEGACY = """CASE WHEN ws > 15 THEN 9999e0 ELSE metres * (18e-1 / greatest(1e-1, 6e-1 * exp(-35e-1 * abs(tan(radians(b_slope)) + 5e-2))))
 * (CASE WHEN ws > 10 THEN ws * 12e-1 ELSE ws * 5e-1 END / 1e1)
 * (1e0 + greatest(0e0, ((to_col - col) * wind_u + (to_row - row) * wind_v) / sqrt(pow(to_col - col, 2) + pow(to_row - row, 2))) * 15e-1)
 * CASE WHEN ridge THEN 15e-1 ELSE 1e0 END END"""


@query("grid_id:i row:i col:i to_row:i to_col:i walk_light* walk_heavy* fly_light* fly_heavy* legacy*", f"""
SELECT *, {fly_sql('light')} AS fly_light, {fly_sql('heavy')} AS fly_heavy, {LEGACY} AS legacy FROM (
  SELECT *, degrees(acos(greatest(-1e0, least(1e0, -(east * wind_u + north * wind_v)
    / (sqrt(east * east + north * north) * sqrt(wind_u * wind_u + wind_v * wind_v)))))) AS angle FROM adjacent) AS e""", ["adjacent"])
def edge_costs(spark, sf):
    """Every edge of the grid with its walking, flight and legacy costs."""
    grid = windy_layer(spark, sf)
    walk = grid.withColumns({f"unit_{s}": routing.walk_unit_cost(F.col("slope"), F.col("density"), F.col("canopy"), s)
                             for s in routing.SIZES})
    columns = [*routing.FLIGHT_COLUMNS, "slope", *[f"unit_{s}" for s in routing.SIZES]]
    costs = {**{f"walk_{s}": lambda n, s=s: F.when(n["slope"] <= P.CLIFF_SLOPE, n[f"unit_{s}"] * routing._diagonal(n))
                for s in routing.SIZES},
             **{f"fly_{s}": lambda n, s=s: routing.flight_edge_cost(n, s) for s in routing.SIZES},
             "legacy": routing.legacy_edge_cost}
    return routing.edge_list(walk, columns, costs)

"""Queries over grid layers, area statistics and relaxation tiers, with their SQL."""

from pyspark.sql import functions as F

from ridgeline.catalog.registry import cte, hav, query
from ridgeline.catalog.scalars import base_cells
from ridgeline.catalog.zones import calm_scored
from ridgeline.fixtures import shape
from ridgeline.operators import area, evaluation, paths, raster, spatial, tiers
from ridgeline.plans import zones

ROW_M, COL_M = 96.0, 100.0


def _grad(v, part, order, h):
    over = f"OVER (PARTITION BY grid_id, {part} ORDER BY {order})"
    return (f"CASE WHEN lag({v}) {over} IS NULL THEN (lead({v}) {over} - {v}) / {h} "
            f"WHEN lead({v}) {over} IS NULL THEN ({v} - lag({v}) {over}) / {h} "
            f"ELSE (lead({v}) {over} - lag({v}) {over}) / (2e0 * {h}) END")


cte("grads", f"""SELECT *, d_row / 15e0 AS c_row, d_col / 15e0 AS c_col FROM (
  SELECT *, {_grad('elevation', 'col', 'row', '1e0')} AS d_row, {_grad('elevation', 'row', 'col', '1e0')} AS d_col FROM terrain_cells) AS g""",
    "terrain_cells")
cte("layer", f"""SELECT *, curvature < -2e-2 AS is_ridge, curvature > 2e-2 AS is_valley,
  NOT coalesce(density_ratio > 5e-1, false) AS is_open, CASE WHEN density_ratio > 5e-1 THEN 1e1 ELSE 0e0 END AS canopy FROM (
  SELECT *, degrees(atan(sqrt(pow(d_row / 96e0, 2) + pow(d_col / 100e0, 2)))) AS slope,
    (degrees(atan2(-d_row, d_col)) + 360e0) % 360e0 AS aspect,
    {_grad('c_row', 'col', 'row', '15e0')} + {_grad('c_col', 'row', 'col', '15e0')} AS curvature FROM grads) AS l""", "grads")


def terrain_layer(spark, sf):
    """Grid with slope, ridges and forest: the shared input of area, path and route queries."""
    cells = raster.terrain_layer(shape(spark, sf, "terrain_cells"), F.lit(ROW_M), F.lit(COL_M))
    return raster.forest_layer(cells)


@query("cell_id:i slope* aspect*", "SELECT * FROM layer", ["layer"])
def slope_aspect(spark, sf):
    """Slope with metric spacing and aspect of every cell."""
    return terrain_layer(spark, sf)


@query("cell_id:i curvature* is_ridge is_valley", "SELECT * FROM layer", ["layer"])
def ridge_valley(spark, sf):
    """Curvature, ridges and valleys."""
    return terrain_layer(spark, sf)


@query("cell_id:i is_open density* canopy* plain_density*", """
SELECT cell_id, is_open, greatest(0e0, least(1e0, coalesce(density_ratio, 0e0))) AS density, canopy,
  CASE WHEN is_open THEN 0e0 ELSE 6e-1 END AS plain_density FROM layer""", ["layer"])
def forest_layer(spark, sf):
    """P20: forest mask, clipped density, canopy, and the density without a measured ratio."""
    c = raster.forest_layer(shape(spark, sf, "terrain_cells"))
    plain = raster.forest_layer(c.select("cell_id", "is_open"), None, ~F.col("is_open"))
    return c.join(plain.select("cell_id", F.col("density").alias("plain_density")), "cell_id")


@query("cell_id:i corridor_max*", """
SELECT cell_id, max(m) OVER (PARTITION BY grid_id, col ORDER BY row ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS corridor_max
FROM (SELECT *, max(elevation) OVER (PARTITION BY grid_id, row ORDER BY col ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m
FROM terrain_cells) AS t""", ["terrain_cells"])
def corridor_max(spark, sf):
    """Highest elevation within three cells."""
    return raster.neighbourhood(shape(spark, sf, "terrain_cells"), "elevation", 3, "max", "corridor_max")


@query("cell_id:i mean_elev*", """
SELECT a.cell_id, avg(b.elevation) AS mean_elev FROM terrain_cells a JOIN terrain_cells b ON a.grid_id = b.grid_id
AND b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY a.cell_id""", ["terrain_cells"])
def neighbourhood_mean(spark, sf):
    """3 x 3 mean elevation, clipped at the border."""
    return raster.neighbourhood(shape(spark, sf, "terrain_cells"), "elevation", 1, "mean", "mean_elev")


cte("grids", f"""SELECT *, {hav('mlat', 'mlon', 'mlat', 'mlon + lon_step')} AS row_m,
  {hav('mlat', 'mlon', 'mlat + lat_step', 'mlon')} AS col_m FROM (
  SELECT *, lat0 + lat_step * floor(n_cols / 2e0) AS mlat, lon0 + lon_step * floor(n_rows / 2e0) AS mlon FROM (
    SELECT grid_id, min(latitude) AS lat0, max(latitude) AS lat1, min(longitude) AS lon0, max(longitude) AS lon1,
      max(row) + 1 AS n_rows, max(col) + 1 AS n_cols, (max(latitude) - min(latitude)) / nullif(max(col), 0) AS lat_step,
      (max(longitude) - min(longitude)) / nullif(max(row), 0) AS lon_step FROM terrain_cells GROUP BY grid_id) AS a) AS b""",
    "terrain_cells")


def grids(spark, sf):
    return raster.geometry(shape(spark, sf, "terrain_cells"))


@query("grid_id:i lat0* lat1* lon0* lon1* n_rows:i n_cols:i row_m* col_m*", "SELECT * FROM grids", ["grids"])
def grid_geometry(spark, sf):
    """Bounds and metric spacing of each grid."""
    return grids(spark, sf)


@query("incident_id:i row:i col:i trunc_col:i", """
SELECT incident_id, row, col, trunc_col FROM (SELECT i.incident_id, c.row, c.col,
  CAST(trunc((i.latitude - g.lat0) / g.lat_step) AS INT) AS trunc_col, row_number() OVER (PARTITION BY i.incident_id ORDER BY
    round(pow(c.latitude - i.latitude, 2) + pow(c.longitude - i.longitude, 2), 15), c.row, c.col) AS rn
  FROM incidents i JOIN terrain_cells c ON c.grid_id = i.grid_id JOIN grids g ON g.grid_id = i.grid_id) AS t WHERE rn = 1""",
       ["incidents", "terrain_cells", "grids"])
def snapped_incidents(spark, sf):
    """Nearest grid cell of each incident, and the truncating variant."""
    g = grids(spark, sf)
    snapped = spatial.snap_to_grid(shape(spark, sf, "incidents"), g)
    return snapped.join(g.select("grid_id", "lat0", "lat_step"), "grid_id").withColumn(
        "trunc_col", spatial.truncated_index(F.col("latitude"), F.col("lat0"), F.col("lat_step")))


cte("near_layer", f"""SELECT * FROM (SELECT i.incident_id, i.grid_id AS home_grid, l.*,
  {hav('i.latitude', 'i.longitude', 'l.latitude', 'l.longitude')} AS distance_m
  FROM incidents i JOIN layer l ON abs(l.latitude - i.latitude) < 0.01e0 AND abs(l.longitude - i.longitude) < 0.01e0) AS p
WHERE distance_m <= 500e0""", "incidents", "layer")

AREA = ("incident_id:i n_cells:i elev_avg* elev_min* elev_max* elev_range* slope_avg* slope_max* steep_pct* "
        "density_avg* height_avg* open_pct* steep_grade open_grade wind_grade")


@query(AREA, """
SELECT *, CASE WHEN steep_pct > 50 THEN 'very dangerous' WHEN steep_pct > 30 THEN 'dangerous' ELSE 'safe' END AS steep_grade,
  CASE WHEN open_pct < 30 THEN 'dense' WHEN open_pct < 60 THEN 'partly open' ELSE 'open' END AS open_grade,
  CASE WHEN w < 8 THEN 'SAFE' WHEN w < 12 THEN 'CAUTION' ELSE 'DANGER' END AS wind_grade
FROM (SELECT incident_id, incident_id % 16 AS w, count(*) AS n_cells, avg(elevation) AS elev_avg, min(elevation) AS elev_min,
    max(elevation) AS elev_max, max(elevation) - min(elevation) AS elev_range, avg(slope) AS slope_avg, max(slope) AS slope_max,
    count(*) FILTER (slope > 45) * 100e0 / count(*) AS steep_pct, avg(density_ratio) AS density_avg, avg(canopy_m) AS height_avg,
    count(*) FILTER (density_ratio < 3e-1) * 100e0 / count(*) AS open_pct
  FROM near_layer WHERE distance_m < 500e0 GROUP BY incident_id) AS a""", ["near_layer"])
def area_analysis(spark, sf):
    """A1, A2: terrain around each incident and its grades."""
    out = area.analyse(shape(spark, sf, "incidents").drop("grid_id"), terrain_layer(spark, sf))
    return area.grade(out, F.col("incident_id") % 16)


cte("boxes", """SELECT s.incident_id, l.slope FROM (SELECT incident_id, grid_id, least(row, 25) AS r0, greatest(row, 25) AS r1,
    least(col, 50) AS c0, greatest(col, 50) AS c1 FROM snapped) AS s
  JOIN layer l ON l.grid_id = s.grid_id AND l.row BETWEEN r0 - 20 AND r1 + 20 AND l.col BETWEEN c0 - 20 AND c1 + 20""",
    "snapped", "layer")
cte("snapped", """SELECT i.incident_id, i.grid_id, i.heli_size, i.latitude, i.longitude,
  CAST(least(greatest(ceil(round((i.longitude - g.lon0) / g.lon_step, 9) - 5e-1), 0), g.n_rows - 1) AS INT) AS row,
  CAST(least(greatest(ceil(round((i.latitude - g.lat0) / g.lat_step, 9) - 5e-1), 0), g.n_cols - 1) AS INT) AS col
FROM incidents i JOIN grids g USING (grid_id)""", "incidents", "grids")


@query("incident_id:i n_cells:i slope_min* slope_median* slope_mean* slope_max* pct_over_30* pct_over_45* pct_over_60* pct_walkable*",
       """SELECT incident_id, count(*) AS n_cells, min(slope) AS slope_min, median(slope) AS slope_median, avg(slope) AS slope_mean,
  max(slope) AS slope_max, count(*) FILTER (slope > 30) * 100e0 / count(*) AS pct_over_30,
  count(*) FILTER (slope > 45) * 100e0 / count(*) AS pct_over_45, count(*) FILTER (slope > 60) * 100e0 / count(*) AS pct_over_60,
  count(*) FILTER (slope <= 45) * 100e0 / count(*) AS pct_walkable FROM boxes GROUP BY incident_id""", ["boxes"])
def box_slope_stats(spark, sf):
    """Slope distribution of the walking box between each incident and the centre of its grid."""
    at = spatial.snap_to_grid(shape(spark, sf, "incidents"), grids(spark, sf))
    requests = at.select("incident_id", "grid_id", F.col("row").alias("r0"), F.col("col").alias("c0"),
                         F.lit(25).alias("r1"), F.lit(50).alias("c1"))
    return area.box_slopes(requests, terrain_layer(spark, sf))


cte("tiered", """SELECT *, CASE WHEN NOT is_open THEN NULL WHEN slope < 40 AND w < 18 AND canopy < 12 THEN 0
  WHEN slope < 40 AND canopy < 12 THEN 1 WHEN slope < 50 AND canopy < 12 THEN 2 WHEN slope < 50 THEN 3 ELSE 4 END AS tier
FROM (SELECT *, CASE WHEN grid_id % 2 = 1 THEN 19e0 ELSE CAST(cell_id % 23 AS DOUBLE) END AS w FROM layer) AS l""", "layer")


@query("incident_id:i cell_id:i row:i col:i tier:i distance_m*", f"""
SELECT * FROM (SELECT i.incident_id, t.cell_id, t.row, t.col, t.tier, {hav('i.latitude', 'i.longitude', 't.latitude', 't.longitude')} AS distance_m,
    row_number() OVER (PARTITION BY i.incident_id ORDER BY {hav('i.latitude', 'i.longitude', 't.latitude', 't.longitude')}, t.cell_id) AS rn
  FROM incidents i JOIN tiered t ON t.grid_id = i.grid_id
  WHERE t.tier = (SELECT min(tier) FROM tiered m WHERE m.grid_id = i.grid_id)) AS x WHERE rn = 1""", ["incidents", "tiered"])
def hoist_tiers(spark, sf):
    """Nearest hoist cell under the strictest conditions the grid can meet."""
    wind = F.when(F.col("grid_id") % 2 == 1, 19.0).otherwise((F.col("cell_id") % 23).cast("double"))
    return tiers.hoist_candidates(shape(spark, sf, "incidents"), terrain_layer(spark, sf).withColumn("wind_speed", wind))


cte("flat_in", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY incident_id
  ORDER BY CASE WHEN is_open THEN 0 ELSE 1 END, slope, row, col) AS rn FROM near_layer WHERE grid_id = home_grid) AS t WHERE rn = 1""",
    "near_layer")
cte("flat_grid", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY slope, row, col) AS rn FROM layer) AS t
WHERE rn = 1""", "layer")


@query("incident_id:i cell_id:i slope* is_open scope", """
SELECT incident_id, cell_id, slope, is_open, 'radius' AS scope FROM flat_in
UNION ALL SELECT i.incident_id, g.cell_id, g.slope, g.is_open, 'grid' FROM incidents i JOIN flat_grid g USING (grid_id)
WHERE i.incident_id NOT IN (SELECT incident_id FROM flat_in)""", ["flat_in", "flat_grid", "incidents"])
def flattest_fallback(spark, sf):
    """Flattest open cell in the radius, else flattest in it, else of the grid."""
    return tiers.flattest(shape(spark, sf, "incidents"), terrain_layer(spark, sf))


cte("first_zone", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY
  CASE WHEN tactic = 'landing' AND risk_class < 2 THEN 0 WHEN tactic = 'hoist' THEN 1 ELSE 2 END) AS pick FROM calm_1) AS t
WHERE pick = 1""", "calm_1")
cte("zone_pick", """SELECT z.incident_id, g.grid_id,
  CAST(least(greatest(ceil(round((z.longitude - g.lon0) / g.lon_step, 9) - 5e-1), 0), g.n_rows - 1) AS INT) AS row,
  CAST(least(greatest(ceil(round((z.latitude - g.lat0) / g.lat_step, 9) - 5e-1), 0), g.n_cols - 1) AS INT) AS col,
  z.heli_size || '_' || z.tactic AS mode, z.suitability AS score, z.risk_class, false AS is_fallback
  FROM first_zone z JOIN incidents i USING (incident_id) JOIN grids g ON g.grid_id = i.grid_id
UNION ALL SELECT f.incident_id, f.home_grid, f.row, f.col, 'H_Light', 5e-1, NULL, true FROM flat_in f WHERE f.incident_id NOT IN (SELECT incident_id FROM first_zone)""",
    "first_zone", "grids", "flat_in")


@query("incident_id:i row:i col:i mode score* risk_class:i is_fallback distance_m*", f"""
SELECT p.*, {hav('i.latitude', 'i.longitude', 'l.latitude', 'l.longitude')} AS distance_m
FROM zone_pick p JOIN incidents i USING (incident_id) JOIN layer l ON l.grid_id = p.grid_id AND l.row = p.row AND l.col = p.col""",
       ["zone_pick", "layer"])
def selected_zone(spark, sf):
    """M9: best zone snapped to the grid, flattest-cell fallback where no model result exists."""
    incidents = shape(spark, sf, "incidents")
    return zones.selected_zone(incidents, calm_scored(spark, sf), terrain_layer(spark, sf), grids(spark, sf))


@query("grid_id:i row:i col:i", """
SELECT grid_id, row, col FROM (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY row, col) AS rn
FROM terrain_cells WHERE (cell_id * 7919) % 23 > 15) AS t WHERE rn % 50 = 1""", ["terrain_cells"])
def thinned_danger(spark, sf):
    """Every 50th cell with strong wind."""
    return paths.thinned(shape(spark, sf, "terrain_cells"), (F.col("cell_id") * 7919) % 23 > 15)


@query("grid_id:i n:i elev_mean* filled:i", None)
def scattered_grid(spark, sf):
    """Scattered samples on a regular grid with ring and mean fill."""
    c = shape(spark, sf, "terrain_cells")
    g = raster.scatter_to_grid(c, 60)
    return g.groupBy("grid_id").agg(F.count("*").alias("n"), F.avg("elevation").alias("elev_mean"),
                                    F.count("elevation").alias("filled"))


@query("incident_id:i recommended error_mean_m*", f"""
SELECT i.incident_id, z.tactic AS recommended, {hav('z.latitude', 'z.longitude', 'i.latitude', 'i.longitude')} AS error_mean_m
FROM first_zone z JOIN incidents i USING (incident_id)""", ["first_zone", "incidents"])
def landing_error(spark, sf):
    """Distance between the chosen zone and the incident as the actual site."""
    best = zones.best_zone(shape(spark, sf, "incidents"), calm_scored(spark, sf))
    actual = shape(spark, sf, "incidents").select("incident_id", F.col("latitude").alias("actual_lat"),
                                                  F.col("longitude").alias("actual_lon"))
    pairs = best.withColumn("recommended", F.col("tactic")).join(actual, "incident_id")
    return evaluation.landing_error(pairs, ["incident_id", "recommended"])

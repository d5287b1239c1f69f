"""Queries over candidates, ranking, relaxation tiers and neighbours, with their SQL."""

from pyspark.sql import functions as F

from ridgeline import params as P
from ridgeline.catalog.registry import angle_score, band, cte, hav, label, mod360, planar, query
from ridgeline.catalog.scalars import W, base_cells
from ridgeline.fixtures import shape
from ridgeline.functions import geo
from ridgeline.operators import ranking, spatial
from ridgeline.plans import zones
from ridgeline.sources import hazards as hazard_source

MODES = P.MODES

cte("pairs", f"""
SELECT * FROM (SELECT i.incident_id, i.heli_size, i.latitude AS at_lat, i.longitude AS at_lon, c.*,
    {planar('i.latitude', 'i.longitude', 'c.latitude', 'c.longitude')} AS distance_m
  FROM incidents i JOIN base c ON c.latitude BETWEEN i.latitude - 500e0 / 111000e0 AND i.latitude + 500e0 / 111000e0
    AND c.longitude BETWEEN i.longitude - 500e0 / 111000e0 AND i.longitude + 500e0 / 111000e0) AS p
WHERE distance_m <= 500e0""", "incidents", "base")


def candidate_sql(source, wind, wd):
    """Candidates per tactic from in-range pairs, with the wind given as expressions."""
    small = band(wind, (5, 8, 10), ("1e0", "6e-1", "2e-1"), "0e0")
    large = band(wind, (5, 12, 20), ("1e0", "6e-1", "2e-1"), "0e0")
    heading = mod360("degrees(atan2(longitude - 128.5e0, latitude - 38.25e0))")
    head = (f"SELECT *, {wind} AS wind_speed, CASE heli_size WHEN 'small' THEN {small} ELSE {large} END AS wind_score, "
            f"{angle_score(heading + ' - ' + wd)} AS wind_dir_score FROM {source} WHERE land_type <> 2")
    parts = []
    for t in zones.TACTICS:
        suit = "CASE heli_size " + " ".join(
            f"WHEN '{s}' THEN static_{s}_{t} + wind_score * {W[f'{s}_{t}']['wind']:e} "
            f"+ wind_dir_score * {W[f'{s}_{t}']['wind_dir']:e}" for s in ("small", "large")) + " END"
        parts.append(f"SELECT incident_id, heli_size, cell_id, latitude, longitude, wind_speed, distance_m, '{t}' AS tactic, "
                     f"round({suit}, 9) AS suitability FROM ({head}) AS h")
    union = " UNION ALL ".join(parts)
    return (f"SELECT *, {label('suitability')} AS risk_class FROM ({union}) AS u WHERE suitability IS NOT NULL")


def greedy_sql(prefix, source, n, sep, order="risk_class, suitability DESC, distance_m, cell_id"):
    """Names and SQL of n chained picks; each later pick keeps the distance to all earlier ones."""
    names = []
    for r in range(1, n + 1):
        apart = " ".join(
            f"AND EXISTS (SELECT 1 FROM {p} q WHERE q.incident_id = c.incident_id AND q.tactic = c.tactic "
            f"AND sqrt(pow(q.latitude - c.latitude, 2) + pow(q.longitude - c.longitude, 2)) >= {sep!r}e0)" for p in names)
        name = f"{prefix}_{r}"
        cte(name, f"SELECT *, {r} AS rank FROM (SELECT *, row_number() OVER (PARTITION BY incident_id, tactic ORDER BY {order}) AS rn "
                  f"FROM {source} c WHERE true {apart}) AS t WHERE rn = 1", source, *names)
        names.append(name)
    return names


cte("calm_candidates", candidate_sql("pairs", "6.5e0", "270e0"), "pairs")
CALM = greedy_sql("calm", "calm_candidates", 3, 0.000455)
WIDE = greedy_sql("wide", "calm_candidates", 3, 0.0025)
cte("calm_ranked", " UNION ALL ".join(f"SELECT * FROM {n}" for n in CALM), *CALM)
RANKED = "incident_id:i tactic rank:i cell_id:i latitude* longitude* risk_class:i suitability* distance_m* wind_speed*"


def calm_scored(spark, sf):
    speed, direction = P.FALLBACK_WIND
    cells = base_cells(spark, sf).withColumns({"wind_speed": F.lit(speed), "wind_direction": F.lit(direction)})
    return zones.score_cells(cells)


@query("incident_id:i cell_id:i distance_m*", "SELECT * FROM pairs", ["pairs"])
def radius_candidates(spark, sf):
    """Cells within 500 m of each incident, parity (clipped) disc."""
    return spatial.radius_join(shape(spark, sf, "incidents").drop("grid_id"), shape(spark, sf, "terrain_cells"))


@query("incident_id:i n_degree:i n_haversine:i far_m*", f"""
SELECT incident_id, count(*) FILTER (d <= 500e0) AS n_degree, count(*) FILTER (h <= 500e0) AS n_haversine,
  max(h) FILTER (h <= 500e0) AS far_m
FROM (SELECT i.incident_id, sqrt(pow(c.latitude - i.latitude, 2) + pow(c.longitude - i.longitude, 2)) * 110000e0 AS d,
    {hav('i.latitude', 'i.longitude', 'c.latitude', 'c.longitude')} AS h
  FROM incidents i JOIN terrain_cells c ON abs(c.latitude - i.latitude) < 0.01e0 AND abs(c.longitude - i.longitude) < 0.01e0) AS p
GROUP BY incident_id""", ["incidents", "terrain_cells"])
def radius_metrics(spark, sf):
    """candidate counts under the degree and the great-circle metric."""
    i, c = shape(spark, sf, "incidents").drop("grid_id"), shape(spark, sf, "terrain_cells")
    deg = spatial.radius_join(i, c, metric="degrees").groupBy("incident_id").agg(F.count("*").alias("n_degree"))
    arc = spatial.radius_join(i, c, metric="haversine", salts=4).groupBy("incident_id").agg(
        F.count("*").alias("n_haversine"), F.max("distance_m").alias("far_m"))
    return arc.join(deg, "incident_id")


@query("incident_id:i n_cells:i elev_mean*", """
SELECT incident_id, count(*) AS n_cells, avg(c.elevation) AS elev_mean FROM incidents i JOIN terrain_cells c
ON c.latitude BETWEEN i.latitude - 15e-2 AND i.latitude + 15e-2 AND c.longitude BETWEEN i.longitude - 15e-2 AND i.longitude + 15e-2
GROUP BY incident_id HAVING count(*) >= 10""", ["incidents", "terrain_cells"])
def incident_boxes(spark, sf):
    """F1: +-0.15 degree crop per incident, dropped below ten rows."""
    b = spatial.box_degrees(shape(spark, sf, "incidents").drop("grid_id"), shape(spark, sf, "terrain_cells"))
    return b.withColumn("elev_mean", F.col("sum_elev") / F.col("n_cells"))


@query("cell_id:i n_near:i", """
SELECT c.cell_id, count(*) AS n_near FROM terrain_cells c JOIN incidents i
ON c.latitude BETWEEN i.latitude - 5e-1 / 111e0 AND i.latitude + 5e-1 / 111e0
AND c.longitude BETWEEN i.longitude - 5e-1 / (111e0 * cos(radians(i.latitude))) AND i.longitude + 5e-1 / (111e0 * cos(radians(i.latitude)))
GROUP BY c.cell_id""", ["terrain_cells", "incidents"])
def km_boxes(spark, sf):
    """F2: cells inside the +-0.5 km box of an incident, counted per cell."""
    near = spatial.radius_join(shape(spark, sf, "incidents").drop("grid_id"), shape(spark, sf, "terrain_cells"), 750.0, "haversine")
    inside = spatial.km_box(*map(F.col, ("latitude", "longitude", "at_lat", "at_lon")), 0.5)
    return near.where(inside).groupBy("cell_id").agg(F.count("*").alias("n_near"))


@query(RANKED, "SELECT * FROM calm_ranked", ["calm_ranked"])
def ranked_zones(spark, sf):
    """Top three landing and hoist zones of every incident, fallback wind."""
    return zones.ranked_zones(shape(spark, sf, "incidents"), calm_scored(spark, sf))


@query(RANKED, " UNION ALL ".join(f"SELECT * FROM {n}" for n in WIDE), WIDE)
def ranked_zones_spread(spark, sf):
    """R2 with a separation that bites on this grid."""
    return zones.ranked_zones(shape(spark, sf, "incidents"), calm_scored(spark, sf), min_sep_deg=0.0025)


@query("incident_id:i tactic cell_id:i risk_class:i suitability*", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY
  CASE WHEN tactic = 'landing' AND risk_class < 2 THEN 0 WHEN tactic = 'hoist' THEN 1 ELSE 2 END) AS pick FROM calm_1) AS t
WHERE pick = 1""", ["calm_1"])
def landing_first(spark, sf):
    """One zone per incident, landing unless dangerous."""
    return zones.best_zone(shape(spark, sf, "incidents"), calm_scored(spark, sf))


@query("incident_id:i tactic rank:i d_score* d_distance_m*", """
SELECT c.incident_id, c.tactic, c.rank, c.suitability - f.suitability AS d_score, c.distance_m - f.distance_m AS d_distance_m
FROM calm_ranked c JOIN calm_1 f ON c.incident_id = f.incident_id AND c.tactic = f.tactic""", ["calm_ranked"])
def rank_delta(spark, sf):
    """Differences of each rank to the first."""
    return ranking.delta_to_first(ranked_zones(spark, sf))


cte("shifted", "SELECT cell_id, latitude + 33e-5 AS latitude, longitude + 41e-5 AS longitude FROM terrain_cells", "terrain_cells")


@query("hazard_id:i cell_id:i degrees* grade:i", """
SELECT hazard_id, cell_id, degrees, grade FROM (
  SELECT h.hazard_id, c.cell_id, c.density_grade AS grade, sqrt(pow(c.latitude - h.lat, 2) + pow(c.longitude - h.lon, 2)) AS degrees,
    row_number() OVER (PARTITION BY h.hazard_id ORDER BY sqrt(pow(c.latitude - h.lat, 2) + pow(c.longitude - h.lon, 2)), c.cell_id) AS rn
  FROM (SELECT *, TRY_CAST(nullif(regexp_extract(position, 'POINT\\(([0-9.]+)\\s+([0-9.]+)\\)', 1), '') AS DOUBLE) AS lon,
    TRY_CAST(nullif(regexp_extract(position, 'POINT\\(([0-9.]+)\\s+([0-9.]+)\\)', 2), '') AS DOUBLE) AS lat FROM hazards) AS h
  CROSS JOIN terrain_cells c WHERE lat IS NOT NULL) AS t WHERE rn = 1""", ["hazards", "terrain_cells"])
def nearest_cell(spark, sf):
    """Nearest terrain cell of every hazard point."""
    cells = shape(spark, sf, "terrain_cells")
    points = hazard_source.located(shape(spark, sf, "hazards")).select(
        "hazard_id", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))
    near = spatial.nearest_join(points, cells, "hazard_id")
    return (near.withColumnsRenamed({"near_id": "cell_id", "near_m": "degrees"})
            .join(cells.select("cell_id", F.col("density_grade").alias("grade")), "cell_id"))


cte("weather_in", """SELECT nx, ny, station_id, ws, wd FROM (SELECT s.station_id,
  88 + s.station_id % 4 AS nx, 136 + s.station_id % 5 AS ny, l.ws, l.wd FROM stations s JOIN latest l USING (station_id)) AS w""",
    "stations", "latest")


@query("cell_id:i nx:i ny:i wind_speed* wind_direction*", """
SELECT c.cell_id, c.nx, c.ny, w.ws AS wind_speed, w.wd AS wind_direction FROM lcc c LEFT JOIN
 (SELECT nx, ny, arg_min(ws, station_id) AS ws, arg_min(wd, station_id) AS wd FROM weather_in GROUP BY nx, ny) AS w
 ON c.nx = w.nx AND c.ny = w.ny""", ["lcc", "weather_in"])
def weather_grid_join(spark, sf):
    """Forecast weather by grid key, duplicates resolved to the first source."""
    from ridgeline.catalog.winds import latest_readings
    s = F.col("station_id")
    w = latest_readings(spark, sf).select((88 + s % 4).alias("nx"), (136 + s % 5).alias("ny"),
                                          s.alias("source_id"), "ws", "wd")
    return spatial.weather_by_cell(shape(spark, sf, "terrain_cells"), w)


@query("incident_id:i tactic rank:i cell_id:i p_safe*", " UNION ALL ".join(
    f"SELECT * FROM {n}" for n in greedy_sql("batch", "batch_candidates", 3, 0.000455,
                                            "risk_class, p_safe DESC, distance_m, cell_id")),
       ["batch_1", "batch_2", "batch_3"])
def ranked_by_probability(spark, sf):
    """R1 (batch order): class, probability of safe, degree distance."""
    rows = zones.candidates(shape(spark, sf, "incidents"), calm_scored(spark, sf), metric="degrees", clipped=False)
    p_safe = (F.col("cell_id") * 7919 % 1000) / 1000.0
    return ranking.spread_top(rows.withColumn("p_safe", p_safe), ranking.batch_order())


cte("degree_pairs", """
SELECT * FROM (SELECT i.incident_id, i.heli_size, c.*,
    sqrt(pow(c.latitude - i.latitude, 2) + pow(c.longitude - i.longitude, 2)) * 110000e0 AS distance_m
  FROM incidents i JOIN base c ON abs(c.latitude - i.latitude) < 0.01e0 AND abs(c.longitude - i.longitude) < 0.01e0) AS p
WHERE distance_m <= 500e0""", "incidents", "base")
cte("batch_candidates", "SELECT *, (cell_id * 7919 % 1000) / 1e3 AS p_safe FROM ("
    + candidate_sql("degree_pairs", "6.5e0", "270e0") + ") AS b", "degree_pairs")

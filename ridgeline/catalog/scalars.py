"""Queries over scores, risks, projections and cleaning, with their SQL."""

from functools import reduce
from operator import and_

from pyspark.sql import functions as F

from ridgeline import params as P
from ridgeline.catalog.registry import angle_score, band, clip, cte, label, mod360, query
from ridgeline.fixtures import shape, table
from ridgeline.functions import geo, risk, scores, times, wind
from ridgeline.sources import hazards as hazard_source
from ridgeline.sources import incidents as incident_source
from ridgeline.sources import observations as obs
from ridgeline.sources import terrain

W = P.TACTIC_WEIGHTS


def case(x, table_):
    return "(CASE " + " ".join(f"WHEN {x} = {k} THEN {v:e}" for k, v in table_.items()) + " ELSE NULL END)"


def static_sql(mode):
    return " + ".join(f"{p}_score * {W[mode][p]:e}" for p in P.STATIC_PARTS)


cte("graded", f"""
SELECT *, CASE WHEN slope_code = -9999 THEN NULL ELSE slope_code END AS slope_grade,
  CAST(land_type = 0 AS INT) AS land_0, CAST(land_type = 1 AS INT) AS land_1, CAST(land_type = 2 AS INT) AS land_2,
  {case("CASE WHEN slope_code = -9999 THEN NULL ELSE slope_code END", P.SLOPE_SCORE)} AS slope_score,
  {case("density_grade", P.DENSITY_SCORE)} AS density_score,
  {case("height_grade", P.HEIGHT_SCORE)} AS height_score,
  {band("elevation", (500, 1200), ("1e0", "7e-1"), "35e-2")} AS elevation_score
FROM terrain_cells""", "terrain_cells")
cte("base", "SELECT *, " + ", ".join(f"{static_sql(m)} AS static_{m}" for m in P.MODES) + " FROM graded", "graded")
# the wind of the newest reading per station, over all observations
cte("latest", """
SELECT station_id, arg_max(ws, (ts, event_id)) AS ws, arg_max(wd, (ts, event_id)) AS wd, max(ts) AS ts
FROM observations WHERE ws >= -50 AND wd >= -50 AND ws <= 100 AND wd <= 360 GROUP BY station_id""", "observations")


def base_cells(spark, sf):
    return terrain.base_table(shape(spark, sf, "terrain_cells"))


@query("cell_id:i land_0:i land_1:i land_2:i slope_score* density_score* height_score* elevation_score* "
       "static_small_landing* static_small_hoist* static_large_landing* static_large_hoist*",
       "SELECT * FROM base", ["base"])
def static_scores(spark, sf):
    """One-hot land, grades, component and static scores of every cell."""
    return base_cells(spark, sf)


@query("cell_id:i elevation:i slope_grade:i",
       "SELECT cell_id, floor(CAST(elevation AS FLOAT)) AS elevation, slope_grade FROM graded", ["graded"])
def storage_types(spark, sf):
    """Narrow storage types after the missing marker is nulled."""
    return terrain.narrowed(base_cells(spark, sf)).withColumn("elevation", F.floor("elevation"))


@query("event_id:i train_score* small_score* large_score* base_dir_score* wind_dir_sin* wind_dir_cos* wind_text", f"""
SELECT event_id, {band('ws', (5, 10, 15), ('1e0', '6e-1', '2e-1'), '0e0')} AS train_score,
  {band('ws', (5, 8, 10), ('1e0', '6e-1', '2e-1'), '0e0')} AS small_score,
  {band('ws', (5, 12, 20), ('1e0', '6e-1', '2e-1'), '0e0')} AS large_score,
  dir_score AS base_dir_score, sin(radians(wd)) AS wind_dir_sin, cos(radians(wd)) AS wind_dir_cos,
  CASE dir_score WHEN 1e0 THEN 'headwind' WHEN 0e0 THEN 'tailwind' ELSE 'crosswind' END AS wind_text
FROM (SELECT o.event_id, o.gust AS ws, o.wd, {angle_score(mod360("degrees(atan2(s.lon - 128.5e0, s.lat - 38.25e0))") + " - o.wd")} AS dir_score
      FROM observations o JOIN stations s USING (station_id)) AS x""", ["observations", "stations"])
def wind_scores(spark, sf):
    """Wind scores of every reading at its station."""
    o = obs.with_station(shape(spark, sf, "observations"), shape(spark, sf, "stations"))
    speed, wd = F.col("gust"), F.col("wd")
    scored = o.withColumns({
        "train_score": scores.train_wind_score(speed),
        "small_score": scores.size_wind_score(speed, F.lit("small")),
        "large_score": scores.size_wind_score(speed, F.lit("large")),
        "base_dir_score": scores.base_wind_dir_score(F.col("lat"), F.col("lon"), wd),
        **scores.wind_encoding(wd)})
    return scored.withColumn("wind_text", scores.wind_text(F.col("base_dir_score")))


@query("cell_id:i tree_risk* aero_risk* slope_wind_risk* base_km* walk_min* land_code:i", """
SELECT cell_id, density_grade * height_grade AS tree_risk, elevation * (cell_id % 30) AS aero_risk,
  slope_grade * (cell_id % 30) AS slope_wind_risk,
  sqrt(pow(latitude - 38.25e0, 2) + pow(longitude - 128.5e0, 2)) * 110e0 AS base_km,
  sqrt(pow(latitude - 38.25e0, 2) + pow(longitude - 128.5e0, 2)) * 110e3 / 50e0 AS walk_min,
  land_type AS land_code FROM graded""", ["graded"])
def features(spark, sf):
    """Interaction features, distance from base, decoded land."""
    b = base_cells(spark, sf).withColumn("wind_speed", (F.col("cell_id") % 30).cast("double"))
    km = geo.distance_from_base_km(F.col("latitude"), F.col("longitude"))
    flags = {k: F.col(f"land_{k}") for k in P.LAND_CODES}
    return b.withColumns({**scores.interactions(), "base_km": km, "land_code": scores.land_code(flags),
                          "walk_min": wind.rough_walk_minutes(km * 1000)})


cte("sweep_rows", f"""
SELECT *, {band('wind_speed', (5, 10, 15), ('1e0', '6e-1', '2e-1'), '0e0')} AS wind_score,
  {angle_score(mod360("degrees(atan2(longitude - 128.5e0, latitude - 38.25e0))") + " - 270e0")} AS wind_dir_score
FROM base, (SELECT unnest([0e0, 5e0, 10e0, 15e0, 25e0]) AS wind_speed) AS w""", "base")
cte("labelled", "SELECT *, " + ", ".join(
    f"(static_{m} + wind_score * {W[m]['wind']:e} + wind_dir_score * {W[m]['wind_dir']:e}) AS score_{m}"
    for m in P.MODES) + " FROM sweep_rows", "sweep_rows")


@query("cell_id:i wind_speed* score_small_landing* score_large_hoist* "
       "target_small_landing:i target_small_hoist:i target_large_landing:i target_large_hoist:i label_text",
       "SELECT *, " + ", ".join(f"{label(f'score_{m}')} AS target_{m}" for m in P.MODES)
       + f", CASE {label('score_small_landing')} WHEN 0 THEN 'safe' WHEN 1 THEN 'caution' ELSE 'danger' END AS label_text"
       + " FROM labelled", ["labelled"])
def targets(spark, sf):
    """Total scores and three-class labels of every cell under five winds."""
    from ridgeline.operators import augment
    rows = augment.wind_sweep(base_cells(spark, sf))
    return rows.withColumn("label_text", scores.class_text(F.col("target_small_landing")))


RISK_PARTS = {"slope": clip("canopy_m / 30e0"), "density": clip("density_ratio * 100e0 / 100e0"),
              "height": clip("canopy_m / 20e0"), "wind_speed": clip("w / 18e0"),
              "wind_dir": clip("abs(sin(radians(wd - asp)))"),
              "altitude": clip("((elevation + 120e0 * (temp - (15e0 - 65e-4 * elevation))) - 200e0) / 1508e0")}
cte("risk_in", """SELECT *, CAST((cell_id * 7) % 25 AS DOUBLE) AS w, CAST((cell_id * 13) % 360 AS DOUBLE) AS wd,
  CASE WHEN cell_id % 17 = 0 THEN NULL ELSE CAST((cell_id * 31) % 360 AS DOUBLE) END AS asp,
  CAST(cell_id % 35 AS DOUBLE) AS temp FROM terrain_cells""", "terrain_cells")


def risk_inputs(spark, sf):
    c = shape(spark, sf, "terrain_cells")
    k = F.col("cell_id")
    return c.withColumns({
        "wind_speed": ((k * 7) % 25).cast("double"), "wind_direction": ((k * 13) % 360).cast("double"),
        "aspect": F.when(k % 17 != 0, ((k * 31) % 360).cast("double")), "temp": (k % 35).cast("double"),
        "slope_deg": F.col("canopy_m"), "density_pct": F.col("density_ratio") * 100.0,
        "tree_height": F.col("canopy_m")})


@query("cell_id:i risk_L_Light* risk_L_Heavy* risk_H_Light* risk_H_Heavy* pct_L_Light* weight_sum*",
       "SELECT *, risk_L_Light * 100e0 AS pct_L_Light, " + " + ".join(f"{w:e}" for ws in P.RISK_WEIGHTS.values() for w in ws.values())
       + " AS weight_sum FROM (SELECT cell_id, " + ", ".join(
           "(" + " + ".join(f"coalesce({RISK_PARTS[k]}, 5e-1) * {w:e}" for k, w in ws.items()) + f") AS risk_{m}"
           for m, ws in P.RISK_WEIGHTS.items()) + " FROM risk_in) AS r", ["risk_in"])
def risk_scores(spark, sf):
    """Normalised parts, validated weights, four weighted risks, percent scale."""
    scored = risk.risk_scores(risk_inputs(spark, sf), temperature="temp")
    valid = risk.validated_weights(P.RISK_WEIGHTS)
    return scored.withColumns({"pct_L_Light": F.col("risk_L_Light") * 100.0,
                               "weight_sum": F.lit(sum(w for ws in valid.values() for w in ws.values()))})


def steps(x, spec):
    pairs, above = spec
    return band(x, [p[0] for p in pairs], [f"{p[1]:e}" for p in pairs], f"{above:e}")


def step_sql(size, tactic):
    off = "(CASE WHEN wd % 360 > 180 THEN 360 - wd % 360 ELSE wd % 360 END)"
    mid, tail = P.STEP_WIND_DIR[size]
    parts = {"slope": steps("canopy_m", P.STEP_SLOPE[tactic]),
             "density": steps("density_ratio * 100e0", P.STEP_DENSITY[size]),
             "height": steps("canopy_m", P.STEP_HEIGHT[size]), "wind_speed": steps("w", P.STEP_WIND[size]),
             "wind_dir": f"(CASE WHEN {off} <= 45 THEN 0e0 WHEN {off} < 135 THEN {mid:e} ELSE {tail:e} END)",
             "altitude": clip("(elevation - 200e0) / 1508e0")}
    ws = P.RISK_WEIGHTS[P.RISK_MODE_KEYS[(tactic, size)]]
    full = " + ".join(f"{parts[k]} * {w:e}" for k, w in ws.items())
    calm = " + ".join(f"{parts[k]} * {w:e}" for k, w in ws.items() if k != "wind_dir")
    blocked = f"({parts['slope']} >= 1 OR {parts['density']} >= 1 OR {parts['wind_speed']} >= 1)"
    return (f"SELECT cell_id, '{size}' AS size, '{tactic}' AS tactic, {clip(full)} AS risk, "
            f"{clip('(' + calm + f') / {1 - ws['wind_dir']:.17e}')} AS risk_no_dir, {blocked} AS blocked FROM risk_in")


@query("cell_id:i size tactic risk* risk_no_dir* blocked",
       " UNION ALL ".join(step_sql(s, t) for s in ("light", "heavy") for t in ("landing", "hoist")), ["risk_in"])
def step_risk(spark, sf):
    """Stepped cell risk and block flag for both sizes and tactics."""
    df = risk_inputs(spark, sf)
    kinds = F.array(*[F.struct(F.lit(s).alias("size"), F.lit(t).alias("tactic"))
                      for s in ("light", "heavy") for t in ("landing", "hoist")])
    df = df.withColumn("_k", F.explode(kinds)).select("*", "_k.*")
    args = [F.col(c) for c in ("canopy_m", "density_ratio", "canopy_m", "wind_speed", "elevation", "tactic", "size")]
    with_dir = risk.cell_risk(*args, F.col("wind_direction"))
    return df.select("cell_id", "size", "tactic", with_dir["risk"].alias("risk"),
                     risk.cell_risk(*args)["risk"].alias("risk_no_dir"), with_dir["blocked"].alias("blocked"))


C, S0, RO = geo.LCC_CONE, geo.LCC_SCALE, geo.LCC_ORIGIN
LCC_SQL = f"""
SELECT *, CAST(trunc(ra * sin(th) + 43.5e0) AS INT) AS nx, CAST(trunc({RO!r}e0 - ra * cos(th) + 136.5e0) AS INT) AS ny
FROM (SELECT *, {S0!r}e0 / pow(tan(pi() / 4e0 + radians(latitude) / 2e0), {C!r}e0) AS ra,
      (radians(longitude) - radians(126e0)) * {C!r}e0 AS th FROM terrain_cells) AS p"""
cte("lcc", LCC_SQL, "terrain_cells")


@query("cell_id:i nx:i ny:i", "SELECT * FROM lcc", ["lcc"])
def lcc_grid(spark, sf):
    """Forecast grid cell of every terrain cell."""
    c = shape(spark, sf, "terrain_cells")
    nx, ny = geo.lcc_cell(F.col("latitude"), F.col("longitude"))
    return c.withColumns({"nx": nx, "ny": ny})


@query("nx:i ny:i n_cells:i lat* lon*", f"""
SELECT nx, ny, n_cells,
  degrees(2e0 * atan(pow({S0!r}e0 / sqrt(x * x + y * y), 1e0 / {C!r}e0)) - pi() / 2e0) AS lat,
  degrees(atan2(x, y) / {C!r}e0) + 126e0 AS lon
FROM (SELECT nx, ny, count(*) AS n_cells, nx - 43e0 AS x, {RO!r}e0 + 136e0 - ny AS y FROM lcc GROUP BY nx, ny) AS g""",
       ["lcc"])
def lcc_inverse(spark, sf):
    """Centre of each forecast grid cell that holds terrain."""
    cells = lcc_grid(spark, sf).groupBy("nx", "ny").agg(F.count("*").alias("n_cells"))
    lat, lon = geo.lcc_inverse(F.col("nx"), F.col("ny"))
    return cells.withColumns({"lat": lat, "lon": lon})


@query("cell_id:i longitude* latitude* elevation* slope_deg* tree_density*", """
SELECT cell_id, longitude, latitude, TRY_CAST(e AS DOUBLE) AS elevation, TRY_CAST(nullif(s, '-9999') AS DOUBLE) AS slope_deg,
  TRY_CAST(t AS DOUBLE) AS tree_density
FROM (SELECT *, CASE WHEN cell_id % 101 = 0 THEN '-9999' WHEN cell_id % 103 = 0 THEN 'n/a' ELSE CAST(elevation AS VARCHAR) END AS e,
  CAST(slope_code AS VARCHAR) AS s, CASE WHEN cell_id % 5 = 0 THEN 'none' ELSE CAST(density_grade AS VARCHAR) END AS t
  FROM terrain_cells) AS raw WHERE cell_id % 101 <> 0 AND TRY_CAST(e AS DOUBLE) IS NOT NULL""", ["terrain_cells"])
def terrain_clean(spark, sf):
    """Union of text parts, numbers coerced, missing marker nulled, bad rows dropped."""
    k = F.col("cell_id")
    raw = shape(spark, sf, "terrain_cells").withColumns({
        "elevation": F.when(k % 101 == 0, "-9999").when(k % 103 == 0, "n/a").otherwise(F.col("elevation").cast("string")),
        "slope_deg": F.col("slope_code").cast("string"),
        "tree_density": F.when(k % 5 == 0, "none").otherwise(F.col("density_grade").cast("string"))})
    parts = [raw.where(k % 3 == i) for i in range(3)]
    return terrain.clean(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query("hazard_id:i name kind lat* lon* in_area", """
SELECT h.*, lat BETWEEN s AND n AND lon BETWEEN w AND e AS in_area FROM (
  SELECT *, TRY_CAST(nullif(regexp_extract(position, 'POINT\\(([0-9.]+)\\s+([0-9.]+)\\)', 1), '') AS DOUBLE) AS lon,
    TRY_CAST(nullif(regexp_extract(position, 'POINT\\(([0-9.]+)\\s+([0-9.]+)\\)', 2), '') AS DOUBLE) AS lat FROM hazards) AS h,
  (SELECT min(latitude) AS s, max(latitude) AS n, min(longitude) AS w, max(longitude) AS e FROM terrain_cells) AS x
WHERE lat IS NOT NULL AND name LIKE '%1%'""", ["hazards", "terrain_cells"])
def hazard_points(spark, sf):
    """WKT positions parsed, names filtered, area flag."""
    points = hazard_source.located(shape(spark, sf, "hazards"), "1")
    return hazard_source.area_flag(points, shape(spark, sf, "terrain_cells"))


@query("station_id:i stamp wd* ws*", """
SELECT station_id, strftime(date_trunc('minute', ts), '%Y%m%d%H%M') AS stamp, wd, ws FROM observations
WHERE event_id % 50 <> 0 AND event_id % 77 <> 0 AND ws >= -50 AND wd >= -50 AND ws <= 100 AND wd <= 360""", ["observations"])
def obs_parse(spark, sf):
    """Readings from whitespace-separated text with comments, gaps and invalid values."""
    o = shape(spark, sf, "observations")
    line = F.concat_ws("  ", F.date_format("ts", times.STAMP), F.col("station_id").cast("string"),
                       F.when(F.col("event_id") % 77 == 0, "x").otherwise(F.col("wd").cast("string")),
                       F.col("ws").cast("string"))
    lines = o.select(F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("# "), line)).otherwise(line).alias("value"))
    parsed = obs.valid(obs.parse_lines(lines))
    return parsed.withColumn("stamp", F.date_format("ts", times.STAMP))


@query("event_id:i floored base_time start_time end_time replay_start", """
SELECT event_id, strftime(date_trunc('hour', ts) + to_minutes(CAST(minute(ts) // 5 * 5 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS floored,
  strftime(CASE WHEN minute(ts) >= 40 THEN date_trunc('hour', ts) ELSE date_trunc('hour', ts) - INTERVAL 1 HOUR END, '%Y%m%d%H00') AS base_time,
  strftime(ts - INTERVAL 20 MINUTE, '%Y%m%d%H%M') AS start_time, strftime(ts - INTERVAL 10 MINUTE, '%Y%m%d%H%M') AS end_time,
  strftime(date_trunc('minute', ts) - INTERVAL 10 MINUTE, '%Y-%m-%d %H:%M:%S') AS replay_start FROM observations""",
       ["observations"])
def time_windows(spark, sf):
    """P25: five-minute floor, base hour, live window and replay window."""
    o = shape(spark, sf, "observations")
    start, end = times.live_window(F.col("ts"))
    replay, _ = times.replay_window(F.date_format("ts", times.STAMP))
    full = "yyyy-MM-dd HH:mm:ss"
    return o.select("event_id", F.date_format(times.floor_5min(F.col("ts")), full).alias("floored"),
                    F.date_format(times.base_hour(F.col("ts")), "yyyyMMddHH00").alias("base_time"),
                    F.date_format(start, times.STAMP).alias("start_time"),
                    F.date_format(end, times.STAMP).alias("end_time"),
                    F.date_format(replay, full).alias("replay_start"))


@query("event_id:i wd_filled* u* v* wd_back* ws_work* walk_kmh* wind_limit*", """
SELECT event_id, coalesce(w, 0e0) AS wd_filled, -sin(radians(wd)) AS u, -cos(radians(wd)) AS v,
  """ + mod360("degrees(atan2(sin(radians(wd)), cos(radians(wd))))") + """ AS wd_back,
  gust * pow((elev + 60e0) / 10e0, 27e-2) AS ws_work,
  greatest(6e0 * exp(-35e-1 * abs(tan(radians(gust)) + 5e-2)), 1e-1) AS walk_kmh,
  CASE event_id % 3 WHEN 0 THEN 10e0 WHEN 1 THEN 20e0 ELSE 15e0 END AS wind_limit
FROM (SELECT o.*, elev, CASE WHEN wd < 0 THEN NULL ELSE wd END AS w FROM observations o JOIN stations USING (station_id)) AS x""",
       ["observations", "stations"])
def wind_vectors(spark, sf):
    """Vectors and back, altitude profile, walking speed, limits."""
    o = obs.with_station(shape(spark, sf, "observations"), shape(spark, sf, "stations"))
    wd = F.col("wd")
    kind = F.when(F.col("event_id") % 3 == 0, "light").when(F.col("event_id") % 3 == 1, "heavy").otherwise("other")
    return o.withColumns({
        "wd_filled": F.coalesce(F.when(wd >= 0, wd), F.lit(0.0)), "u": wind.u_of(wd), "v": wind.v_of(wd),
        "wd_back": wind.direction_of(wind.u_of(wd), wind.v_of(wd)),
        "ws_work": wind.at_work_altitude(F.col("gust"), F.col("elev")),
        "walk_kmh": wind.walking_kmh(F.col("gust")), "wind_limit": wind.wind_limit(kind)})


@query("incident_id:i in_extent", """
SELECT incident_id, latitude BETWEEN 38e0 AND 38.3e0 AND longitude BETWEEN 128.3e0 AND 128.6e0 AS in_extent FROM incidents""",
       ["incidents"])
def extent_check(spark, sf):
    """incidents inside the supported extent."""
    return incident_source.extent_check(shape(spark, sf, "incidents"))


@query("incident_id:i latitude* longitude*", """
SELECT cell_id AS incident_id, latitude, longitude FROM terrain_cells
ORDER BY ((((cell_id % 2147483647) * 48355) % 2147483647) * 16807 + 42) % 2147483647, cell_id LIMIT 10""", ["terrain_cells"])
def random_incidents(spark, sf):
    """Deterministic sample of real cells."""
    return incident_source.random_cells(shape(spark, sf, "terrain_cells"), 10)


@query("grid_id:i n_rows:i is_test is_train_final", """
SELECT grid_id, count(*) AS n_rows, part = 'test' AS is_test, part <> 'test' AS is_train_final
FROM (SELECT *, CASE cell_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'train_1' ELSE 'train_2' END AS part FROM terrain_cells) AS p
GROUP BY grid_id, part = 'test', part <> 'test'""", ["terrain_cells"])
def split_flags(spark, sf):
    """Union of the source tables with their split flags."""
    c = shape(spark, sf, "terrain_cells")
    k = F.col("cell_id") % 5
    parts = {"train_1": c.where(k == 1), "train_2": c.where(k > 1), "test": c.where(k == 0)}
    return (terrain.union_splits(parts).groupBy("grid_id", "is_test", "is_train_final")
            .agg(F.count("*").alias("n_rows")))


@query("n_rows:i n_features:i missing:i n_complete:i n_scored:i", f"""
SELECT count(*) AS n_rows, {len(P.FEATURES)} AS n_features, 0 AS missing, count(*) FILTER (elevation IS NOT NULL AND slope_grade IS NOT NULL
  AND density_grade IS NOT NULL AND height_grade IS NOT NULL AND land_0 IS NOT NULL AND land_1 IS NOT NULL AND land_2 IS NOT NULL) AS n_complete,
  count(static_large_landing) AS n_scored FROM base""", ["base"])
def input_audit(spark, sf):
    """M7: the model's features present, row counts, rows with all of them, rows with a static score."""
    rows = base_cells(spark, sf).withColumns({"wind_speed": (F.col("cell_id") % 30).cast("double"),
                                              **scores.wind_encoding((F.col("cell_id") % 360).cast("double"))})
    rows = rows.withColumns(scores.interactions())
    here = [c for c in P.FEATURES if c in rows.columns]
    complete = reduce(and_, [F.col(c).isNotNull() for c in here])
    return rows.agg(F.count("*").alias("n_rows"), F.lit(len(here)).alias("n_features"), F.lit(len(P.FEATURES) - len(here)).alias("missing"),
                    F.count_if(complete).alias("n_complete"), F.count("static_large_landing").alias("n_scored"))

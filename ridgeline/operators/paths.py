"""Path tables: segments, running distance, smoothing, times, profiles, summaries.

Points are rows (path_id, seq, ...) with seq dense from 0.  Neighbour rows come
from chunked windows, so a path of any length is cut into bounded pieces; path
totals are plain aggregates that combine before the shuffle.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ridgeline import params as P
from ridgeline.functions import geo, paths as path_exprs, wind
from ridgeline.operators.spatial import layers_at
from ridgeline.operators.tiles import CHUNK, chunked, unchunked

KEY = "path_id"


def _chunk_order():
    return W.partitionBy(KEY, "_chunk").orderBy("seq")


def with_next(points: DataFrame, columns, chunk: int = CHUNK) -> DataFrame:
    """Each point with ``next_<column>`` of the following point."""
    w = _chunk_order()
    halo = chunked(points, 0, 1, (KEY,), chunk)
    return unchunked(halo.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns}), chunk)


def running_sum(points: DataFrame, value: Column, name: str, chunk: int = CHUNK) -> DataFrame:
    """Inclusive running sum along each path: inside the chunk, plus the totals of earlier chunks."""
    rows = points.withColumns({"_chunk": F.floor(F.col("seq") / chunk), "_v": value})
    totals = rows.groupBy(KEY, "_chunk").agg(F.sum("_v").alias("_total"))
    earlier = W.partitionBy(KEY).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(KEY, "_chunk", F.coalesce(F.sum("_total").over(earlier), F.lit(0.0)).alias("_offset"))
    inside = rows.withColumn("_in", F.sum("_v").over(_chunk_order().rowsBetween(W.unboundedPreceding, 0)))
    return (inside.join(offsets, [KEY, "_chunk"])
            .withColumn(name, F.coalesce("_in", F.lit(0.0)) + F.col("_offset"))
            .drop("_chunk", "_v", "_in", "_offset"))


def segments(points: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Distance to the next point in metres; null on the last point."""
    nxt = with_next(points, ["latitude", "longitude"], chunk)
    return nxt.withColumn("segment_m", geo.haversine_m(
        *map(F.col, ("latitude", "longitude", "next_latitude", "next_longitude"))))


def cumulative_distance(points: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Distance from the previous point and running distance from the start."""
    w = _chunk_order()
    halo = chunked(points, 1, 0, (KEY,), chunk)
    halo = halo.withColumns({"_plat": F.lag("latitude").over(w), "_plon": F.lag("longitude").over(w)})
    step = F.coalesce(geo.haversine_m(*map(F.col, ("_plat", "_plon", "latitude", "longitude"))), F.lit(0.0))
    stepped = unchunked(halo.withColumn("step_m", step), chunk).drop("_plat", "_plon")
    return running_sum(stepped, F.col("step_m"), "dist_m", chunk)


def smoothed(points: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """First point, every change of direction, last point.

    The direction before the second point is unknown, so that point always
    stays.  Paths of one or two points stay whole.
    """
    w = _chunk_order()
    halo = chunked(points, 1, 1, (KEY,), chunk)

    def at(column, k):
        return F.lead(column, k).over(w) if k >= 0 else F.lag(column, -k).over(w)

    halo = halo.withColumns({f"_{c}{tag}": at(c, k) for c in ("row", "col")
                             for tag, k in (("p", -1), ("n", 1))})
    out_dir = F.struct(F.col("_rown") - F.col("row"), F.col("_coln") - F.col("col"))
    in_dir = F.struct(F.col("row") - F.col("_rowp"), F.col("col") - F.col("_colp"))
    ends = F.col("_rowp").isNull() | F.col("_rown").isNull()
    keep = ends | (F.col("seq") <= 1) | (out_dir != in_dir)
    home = unchunked(halo.withColumn("_keep", keep), chunk)
    return home.where("_keep").drop("_keep", "_rowp", "_rown", "_colp", "_coln")


def walk_times(points: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Walking minutes per path; a segment takes the slope of its end cell, at least 0.3 km/h."""
    nxt = with_next(points, ["latitude", "longitude", "slope"], chunk)
    metres = geo.haversine_m(*map(F.col, ("latitude", "longitude", "next_latitude", "next_longitude")))
    seconds = metres / (wind.walking_kmh(F.col("next_slope"), 0.3) * 1000.0 / 3600.0)
    return nxt.groupBy(KEY).agg((F.coalesce(F.sum(seconds), F.lit(0.0)) / 60.0).alias("walk_min"))


def flight_profile(points: DataFrame, margin_m: float = P.FLIGHT_MARGIN_M,
                   ramp_of=lambda n: F.greatest(F.lit(1), F.floor(n / 7)), zero_based: bool = False,
                   chunk: int = CHUNK) -> DataFrame:
    """Level cruise above the highest terrain with ramps at both ends; the end ramp wins where they meet.

    ``zero_based`` ramps start on the ramp's base; otherwise the first point
    is already one step up.
    """
    totals = points.groupBy(KEY).agg(
        F.max("terrain_m").alias("_top"), F.count("*").alias("_n"),
        F.min_by("terrain_m", "seq").alias("_first"), F.max_by("terrain_m", "seq").alias("_last"))
    p = cumulative_distance(points, chunk).join(totals, KEY)
    cruise = F.col("_top") + margin_m
    ramp = ramp_of(F.col("_n"))
    to_end = F.col("_n") - 1 - F.col("seq")

    def climb(base, i):
        t = i / ramp if zero_based else (i + 1) / (ramp + 1)
        low = base + margin_m * 0.3
        return low + (cruise - low) * t

    altitude = (F.when(to_end < ramp, climb(F.col("_last"), to_end))
                .when(F.col("seq") < ramp, climb(F.col("_first"), F.col("seq"))).otherwise(cruise))
    return p.withColumn("alt_m", altitude).drop("_top", "_n", "_first", "_last")


def penalties(points: DataFrame) -> DataFrame:
    """Penalty, bands and reason of every point; needs slope, wind_speed, is_forest, is_ridge."""
    cols = [F.col(c) for c in ("slope", "wind_speed", "is_forest", "is_ridge")]
    scored = points.withColumns({"penalty": path_exprs.point_penalty(*cols),
                                 "reason": path_exprs.walk_reason(*cols)})
    top = scored.groupBy(KEY).agg(F.max("penalty").alias("max_penalty"))
    return scored.join(top, KEY).withColumns({
        "band": path_exprs.penalty_band(F.col("penalty")),
        "relative_band": path_exprs.relative_band(F.try_divide(F.col("penalty"), F.col("max_penalty"))),
        "briefing_band": path_exprs.briefing_band(F.col("penalty")),
        "flight_band": path_exprs.flight_band(F.col("wind_speed")),
        "flight_reason": path_exprs.flight_reason(F.col("wind_speed"), F.col("is_ridge"))})


def evaluate(points: DataFrame, size: Column | None = None) -> DataFrame:
    """Length, mean slope and share of points above the wind limit, per path."""
    limit = wind.wind_limit(size) if size is not None else F.lit(P.WIND_LIMIT_DEFAULT)
    return segments(points).groupBy(KEY).agg(
        F.coalesce(F.sum("segment_m"), F.lit(0.0)).alias("total_m"), F.avg("slope").alias("slope_mean"),
        F.avg(F.when(F.col("wind_speed") > limit, 1.0).otherwise(0.0)).alias("windy_share"))


def summary(points: DataFrame) -> DataFrame:
    """Briefing numbers per path, including the elevation difference of its ends."""
    return segments(points).groupBy(KEY).agg(
        (F.coalesce(F.sum("segment_m"), F.lit(0.0)) / 1000.0).alias("distance_km"),
        F.count("*").alias("n_points"), F.avg("slope").alias("slope_mean"),
        F.max("wind_speed").alias("wind_max"), F.avg("wind_speed").alias("wind_mean"),
        F.abs(F.max_by("elevation", "seq") - F.min_by("elevation", "seq")).alias("elev_diff"))


def path_risk(points: DataFrame, name: str = "risk") -> DataFrame:
    """Mean segment risk per path.

    The last point starts no segment.  Points outside the grid (null layers)
    add nothing but still count in the divisor.
    """
    w = P.PATH_RISK_WEIGHTS
    last = points.groupBy(KEY).agg(F.max("seq").alias("_last"))
    part = (F.least(F.col("wind_speed") / 20.0, F.lit(1.0)) * w["wind"]
            + F.least(F.col("slope") / 90.0, F.lit(1.0)) * w["slope"]
            + F.when(F.col("is_open"), 0.0).otherwise(0.3) * w["forest"]
            + F.when(F.col("is_ridge"), 0.2).otherwise(0.0) * w["ridge"])
    inside = F.when(F.col("wind_speed").isNotNull(), part)
    counted = points.join(last, KEY).where(F.col("seq") < F.col("_last"))
    risk = counted.groupBy(KEY).agg((F.coalesce(F.sum(inside), F.lit(0.0)) / F.count("*")).alias(name))
    return last.select(KEY).join(risk, KEY, "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def max_wind(points: DataFrame, name: str = "wind_max") -> DataFrame:
    """Strongest wind on the path, 0 when no point lies in the grid."""
    return points.groupBy(KEY).agg(
        F.greatest(F.coalesce(F.max("wind_speed"), F.lit(0.0)), F.lit(0.0)).alias(name))


def straight_cells(pairs: DataFrame, rounding: str = "truncate", points: int | None = None) -> DataFrame:
    """Cells on the line (r0,c0)-(r1,c1): one per step of the longer axis, or a fixed number.

    ``truncate`` cuts toward zero, ``round`` rounds halves to even.  A fixed
    number of points steps by a constant and ends exactly on the goal.
    """
    longest = F.greatest(F.abs(F.col("r1") - F.col("r0")), F.abs(F.col("c1") - F.col("c0"))) + 1
    n = F.lit(points) if points else longest
    line = pairs.withColumn("_n", n).withColumn("seq", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))

    def at(a, b):
        if points:
            step = (b - a) / (points - 1)
            x = F.when(F.col("seq") == points - 1, b.cast("double")).otherwise(F.col("seq") * step + a)
        else:
            x = a + F.coalesce(F.try_divide((b - a) * F.col("seq"), F.col("_n") - 1), F.lit(0.0))
        return (F.rint(x) if rounding == "round" else x).cast("int")

    return line.withColumns({"row": at(F.col("r0"), F.col("r1")), "col": at(F.col("c0"), F.col("c1"))}).drop("_n")


def refined_waypoints(pairs: DataFrame, grid: DataFrame, points: int = 10, reach: int = 4,
                      steep: float = 30.0, keys=("grid_id",)) -> DataFrame:
    """Waypoints on the line; on steep ground the cheapest cell within reach replaces the point.

    Moving costs 1.5 per cell, and a neighbour must be strictly cheaper; ties
    go to the first in row-then-column order.
    """
    cost = grid.select(*keys, "row", "col", "slope",
                       path_exprs.slope_ridge_cost(F.col("slope"), F.col("is_ridge")).alias("cost"))
    # points and moves are many per request, and cells grow: neither side is sent to all tasks
    line = straight_cells(pairs, points=points).join(cost.hint("merge"), [*keys, "row", "col"], "left")
    flat = line.where(~F.coalesce(F.col("slope") > steep, F.lit(False)))
    span = F.sequence(F.lit(-reach), F.lit(reach))
    moves = (line.where(F.col("slope") > steep).withColumnRenamed("cost", "base_cost").drop("slope")
             .withColumn("dr", F.explode(span)).withColumn("dc", F.explode(span))
             .withColumns({"from_row": F.col("row"), "from_col": F.col("col"),
                           "row": F.col("row") + F.col("dr"), "col": F.col("col") + F.col("dc")})
             .join(cost.drop("slope").hint("merge"), [*keys, "row", "col"]))
    total = F.col("cost") + (F.abs("dr") + F.abs("dc")) * 1.5
    better = F.when(total < F.col("base_cost"), F.struct(total.alias("t"), "dr", "dc"))
    best = (moves.groupBy(KEY, "seq", "from_row", "from_col").agg(F.min(better).alias("b"))
            .select(KEY, "seq", (F.col("from_row") + F.coalesce("b.dr", F.lit(0))).alias("row"),
                    (F.col("from_col") + F.coalesce("b.dc", F.lit(0))).alias("col")))
    return flat.select(KEY, "seq", "row", "col").unionByName(best)


def straight_flight(pairs: DataFrame, grid: DataFrame, grids: DataFrame, points: int = 40,
                    margin_m: float = P.FLIGHT_MARGIN_M, keys=("grid_id",)) -> DataFrame:
    """Straight flight with the corridor maximum under each sample; ``grid`` carries corridor_max."""
    from ridgeline.operators.spatial import snap_to_grid
    t = F.col("seq") / (points - 1)
    line = (pairs.withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
            .withColumns({"latitude": F.col("lat0") + (F.col("lat1") - F.col("lat0")) * t,
                          "longitude": F.col("lon0") + (F.col("lon1") - F.col("lon0")) * t})
            .drop("lat0", "lat1", "lon0", "lon1"))
    snapped = snap_to_grid(line, grids, keys)
    placed = layers_at(snapped, grid.withColumnRenamed("corridor_max", "terrain_m"), ["terrain_m"], keys)
    return flight_profile(placed, margin_m, lambda n: F.greatest(F.lit(2), F.floor(n / 8)), zero_based=True)


def flight_minutes(profile: DataFrame) -> DataFrame:
    return profile.groupBy(KEY).agg(wind.flight_minutes(F.max("dist_m")).alias("flight_min"))


def total_eta(flight: DataFrame, walk: DataFrame) -> DataFrame:
    """Flight and walking minutes and their sum; a missing leg counts 0."""
    both = flight.join(walk, KEY, "full")
    f, w = F.coalesce("flight_min", F.lit(0.0)), F.coalesce("walk_min", F.lit(0.0))
    return both.select(KEY, f.alias("flight_min"), w.alias("walk_min"), (f + w).alias("total_min"))


def route_stats(points: DataFrame) -> DataFrame:
    """Distance, slopes, cliff cells, time and node count per path."""
    base = segments(points).groupBy(KEY).agg(
        F.coalesce(F.sum("segment_m"), F.lit(0.0)).alias("distance_m"), F.avg("slope").alias("slope_mean"),
        F.max("slope").alias("slope_max"), F.count_if(F.col("slope") > P.CLIFF_SLOPE).alias("cliff_cells"),
        F.count("*").alias("nodes"))
    return base.join(walk_times(points), KEY)


def hardest_start(incidents: DataFrame, grid: DataFrame, grids: DataFrame, reach: int = 35, step: int = 5,
                  skip: int = 15, keys=("grid_id",), tile: int = 64) -> DataFrame:
    """Start whose straight line to the incident has the highest mean slope.

    Starts are offsets on a lattice around the incident outside the inner
    square.  Incidents in the same cell share one search.  The lines of a spot
    stay within ``reach``, so a tile of spots meets its cells and their rim in
    one task, and no row is made per cell of a line.
    """
    spots = incidents.select(*keys, F.col("row").alias("r1"), F.col("col").alias("c1")).distinct()
    spots = (spots.join(grids.select(*keys, "n_rows", "n_cols"), list(keys)).where("r1 is not null and c1 is not null")
             .withColumns({"_tr": F.floor(F.col("r1") / tile), "_tc": F.floor(F.col("c1") / tile)}))
    cells = grid.select(*keys, "row", "col", F.coalesce(F.nanvl("slope", F.lit(0.0)), F.lit(0.0)).alias("s"),
                        F.col("slope").isNotNull().cast("int").alias("n"), F.coalesce(F.isnan("slope"), F.lit(False)).cast("int").alias("odd"))
    for c in ("row", "col"):
        cells = cells.withColumn(f"_t{c[0]}", F.explode(F.sequence(F.floor((F.col(c) - reach) / tile), F.floor((F.col(c) + reach) / tile))))
    by = [*keys, "_tr", "_tc"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spots.select(*keys).schema)
    lines = spots.groupBy(*by).cogroup(cells.groupBy(*by)).applyInPandas(
        _steepest(list(keys), reach, step, skip, tile), f"{kinds}, row int, col int, dr int, dc int, total double, n int, odd boolean")
    severity = F.when(F.col("odd"), F.lit(float("nan"))).otherwise(F.round(F.try_divide("total", "n"), 9))
    best = F.max(F.struct(severity.alias("severity"), (-F.col("dr")).alias("ndr"), (-F.col("dc")).alias("ndc"))).alias("b")
    return lines.groupBy(*keys, "row", "col").agg(best).select(
        *keys, "row", "col", (F.col("row") - F.col("b.ndr")).alias("start_row"), (F.col("col") - F.col("b.ndc")).alias("start_col"),
        F.col("b.severity").alias("severity"))


def _steepest(keys, reach: int, step: int, skip: int, tile: int):
    """The starts of each spot of a tile whose mean slope is the highest, with all that may equal it once rounded."""
    import numpy as np
    import pandas as pd

    around = range(-reach, reach + 1, step)
    offsets = [(dr, dc) for dr in around for dc in around if not (abs(dr) < skip and abs(dc) < skip)]
    names = [*keys, "row", "col", "dr", "dc", "total", "n", "odd"]

    def run(spots: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        if spots.empty or cells.empty:
            return pd.DataFrame(columns=names)
        r1, c1 = spots["r1"].to_numpy(int), spots["c1"].to_numpy(int)
        low = [int(spots[t].iloc[0]) * tile - reach for t in ("_tr", "_tc")]
        layers = np.zeros((4, tile + 2 * reach, tile + 2 * reach))  # slopes, cells with a slope, odd slopes, cells
        where = cells["row"].to_numpy(int) - low[0], cells["col"].to_numpy(int) - low[1]
        for layer, values in zip(layers, (cells["s"], cells["n"], cells["odd"], np.ones(len(cells)))):
            np.add.at(layer, where, np.asarray(values, float))
        sums = np.zeros((4, len(offsets), len(spots)))
        for k, (dr, dc) in enumerate(offsets):
            r0, c0 = r1 + dr, c1 + dc
            ok = np.flatnonzero((r0 >= 0) & (r0 < spots["n_rows"].to_numpy()) & (c0 >= 0) & (c0 < spots["n_cols"].to_numpy()))
            t, m = np.arange(max(abs(dr), abs(dc)) + 1), max(abs(dr), abs(dc))
            rr = np.rint(r0[ok, None] + -dr * t / m).astype(int) - low[0]
            cc = np.rint(c0[ok, None] + -dc * t / m).astype(int) - low[1]
            sums[:, k, ok] = layers[:, rr, cc].sum(axis=2)
        total, n, odd, met = sums
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = np.where(met == 0, -np.inf, np.where(odd > 0, np.inf, np.where(n > 0, total / n, -1.0)))
        top = mean.max(axis=0)
        k, at = np.nonzero((met > 0) & ((mean == top) | (mean >= top - 1e-8)))
        chosen = np.array(offsets)[k]
        out = pd.DataFrame({"row": r1[at], "col": c1[at], "dr": chosen[:, 0], "dc": chosen[:, 1],
                            "total": total[k, at], "n": n[k, at].astype(int), "odd": odd[k, at] > 0})
        for c in reversed(keys):
            out.insert(0, c, spots[c].iloc[0])
        return out

    return run


def thinned(cells: DataFrame, flag: Column, every: int = 50, keys=("grid_id",)) -> DataFrame:
    """Every n-th flagged cell in (row, col) order, counted per grid row first.

    The position of a cell is the count of flagged cells in earlier rows plus
    its place in its own row, so no window spans a whole grid.
    """
    hit = cells.where(flag)
    per_row = hit.groupBy(*keys, "row").agg(F.count("*").alias("_n"))
    earlier = W.partitionBy(*keys).orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_row.select(*keys, "row", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy(*keys, "row").orderBy("col"))
    return (hit.join(offsets, [*keys, "row"])
            .withColumn("_at", F.col("_before") + inside - 1)
            .where(F.col("_at") % every == 0).drop("_before", "_at"))


def direction_discount(points: DataFrame, current: DataFrame, penalty: DataFrame,
                       discount: float = P.DIRECTION_DISCOUNT, lookahead: int = P.DIRECTION_LOOKAHEAD,
                       keys=("grid_id",)) -> DataFrame:
    """Penalty of the next waypoints' cells, discounted once per visit.

    ``current`` holds path_id and at_seq.  Nothing changes once the walker has
    reached the last point.
    """
    last = points.groupBy(KEY).agg(F.max("seq").alias("_last"))
    ahead = (points.join(current, KEY).join(last, KEY)
             .where((F.col("at_seq") < F.col("_last"))
                    & (F.col("seq") >= F.col("at_seq")) & (F.col("seq") < F.col("at_seq") + lookahead)))
    visits = ahead.groupBy(KEY, *keys, "row", "col").agg(F.count("*").alias("visits"))
    return (visits.join(penalty, [*keys, "row", "col"])
            .withColumn("weighted", F.col("penalty") * F.pow(F.lit(1.0 - discount), F.col("visits"))))


def waypoint_progress(steps: Column, points: Column, per_step: int = 3) -> Column:
    return F.least(steps * per_step, points - 1)

"""Landing and hoist zones for all incidents: score cells once, join, rank, spread."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline import params as P
from ridgeline.functions import scores
from ridgeline.operators import ranking, spatial, tiers
from ridgeline.session import staged

TACTICS = ("landing", "hoist")


def score_cells(cells: DataFrame, classes: dict[str, Column] | None = None) -> DataFrame:
    """Suitability and class of every cell in every mode.

    Needs the base table columns plus wind_speed and wind_direction.  All of
    it depends on the cell alone, so it is computed once per cell and not once
    per incident.  River cells and cells without a static score leave early.
    ``classes`` replaces the rule class of a mode, for instance by a model's.
    """
    usable = cells.where(F.col("land_type") != P.RIVER_CODE)
    scored = usable.withColumn("wind_dir_score", scores.base_wind_dir_score(
        F.col("latitude"), F.col("longitude"), F.col("wind_direction")))
    wind = {s: scores.size_wind_score(F.col("wind_speed"), F.lit(s)) for s in ("small", "large")}
    scored = scored.withColumns({
        f"suit_{m}": scores.suitability(F.col(f"static_{m}"), wind[m.split("_")[0]], F.col("wind_dir_score"), m)
        for m in P.MODES})
    rule = {m: scores.risk_label(F.round(f"suit_{m}", 9)) for m in P.MODES}
    return scored.withColumns({f"class_{m}": (classes or rule)[m] for m in P.MODES})


def candidates(incidents: DataFrame, scored: DataFrame, radius_m: float = P.RESCUE_RADIUS_M,
               metric: str = "planar", extra=(), **join) -> DataFrame:
    """One row per incident, cell in range and tactic."""
    columns = ["cell_id", "latitude", "longitude", "wind_speed", *extra,
               *[f"{p}_{m}" for m in P.MODES for p in ("suit", "class")]]
    near = spatial.radius_join(incidents.select("incident_id", "latitude", "longitude", "heli_size"),
                               scored.select(*columns), radius_m, metric, **join)

    def option(tactic):
        small = F.col("heli_size") == "small"

        def pick(prefix):
            return F.when(small, F.col(f"{prefix}_small_{tactic}")).otherwise(F.col(f"{prefix}_large_{tactic}"))

        return F.struct(F.lit(tactic).alias("tactic"), pick("suit").alias("suitability"),
                        pick("class").alias("risk_class"))

    rows = near.select("incident_id", "heli_size", "cell_id", "latitude", "longitude", "wind_speed", "distance_m",
                       *extra, F.explode(F.array(*[option(t) for t in TACTICS])).alias("_o"))
    return rows.select("*", "_o.*").drop("_o").where(F.col("suitability").isNotNull())


def ranked_zones(incidents: DataFrame, scored: DataFrame, radius_m: float = P.RESCUE_RADIUS_M,
                 top_n: int = 3, min_sep_deg: float = ranking.MIN_SEPARATION_DEG, **join) -> DataFrame:
    """Top zones per incident and tactic, spatially spread."""
    rows = candidates(incidents, scored, radius_m, **join)
    rows = rows.withColumn("suitability", F.round("suitability", 9))
    return ranking.spread_top(rows, ranking.service_order(), top_n, min_sep_deg)


def best_per_tactic(incidents: DataFrame, scored: DataFrame, radius_m: float = P.RESCUE_RADIUS_M, **join) -> DataFrame:
    rows = candidates(incidents, scored, radius_m, **join).withColumn("suitability", F.round("suitability", 9))
    return ranking.first_n(rows, ranking.GROUP, ranking.service_order())


def best_zone(incidents: DataFrame, scored: DataFrame, radius_m: float = P.RESCUE_RADIUS_M, **join) -> DataFrame:
    """One zone per incident by the landing-first rule."""
    return ranking.landing_first(best_per_tactic(incidents, scored, radius_m, **join))


def selected_zone(incidents: DataFrame, scored: DataFrame, grid: DataFrame, grids: DataFrame,
                  radius_m: float = P.RESCUE_RADIUS_M, has_model: Column | None = None) -> DataFrame:
    """Best zone snapped to the incident's grid, or the flattest-cell fallback, flagged as such.

    ``has_model`` marks the incidents the scores apply to; the others fall back.
    """
    from ridgeline.functions import geo
    served = incidents if has_model is None else incidents.where(has_model)
    # one row per incident, used by the match and by the search for the unmatched
    best = staged(best_zone(served, scored, radius_m).select(
        "incident_id", F.col("latitude").alias("zone_lat"), F.col("longitude").alias("zone_lon"),
        "tactic", "heli_size", "risk_class", "suitability"))
    placed = spatial.snap_to_grid(incidents.select("incident_id", "grid_id").join(best, "incident_id"), grids,
                                  lat="zone_lat", lon="zone_lon")
    found = placed.select("incident_id", "grid_id", "row", "col",
                          F.concat_ws("_", "heli_size", "tactic").alias("mode"),
                          F.col("suitability").alias("score"), "risk_class", F.lit(False).alias("is_fallback"))
    rest = incidents.join(best, "incident_id", "left_anti")
    flat = tiers.flattest(rest, grid, radius_m).join(rest.select("incident_id", "grid_id"), "incident_id")
    spare = flat.select("incident_id", "grid_id", "row", "col", F.lit("H_Light").alias("mode"),
                        F.lit(0.5).alias("score"), F.lit(None).cast("int").alias("risk_class"),
                        F.lit(True).alias("is_fallback"))
    where = grid.select("grid_id", "row", "col", F.col("latitude").alias("zone_lat"), F.col("longitude").alias("zone_lon"))
    out = found.unionByName(spare).join(where, ["grid_id", "row", "col"])
    at = incidents.select("incident_id", F.col("latitude").alias("at_lat"), F.col("longitude").alias("at_lon"))
    return out.join(at, "incident_id").withColumn("distance_m", geo.haversine_m(
        *map(F.col, ("at_lat", "at_lon", "zone_lat", "zone_lon"))))

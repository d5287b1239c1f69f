"""Distance joins, nearest neighbours, boxes and grid look-ups."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline import params as P
from ridgeline.functions import geo
from ridgeline.operators import pyramid
from ridgeline.session import staged

METRICS = {
    "planar": geo.planar_m,
    "haversine": geo.haversine_m,
    "degrees": lambda *a: geo.degrees_apart(*a) * 110_000.0,
}
# metres per degree used to size the buckets: never larger than the metric's own
METRES_PER_DEGREE = {"planar": 111_000.0, "haversine": 111_000.0, "degrees": 110_000.0}


def _renamed(points: DataFrame) -> DataFrame:
    return points.withColumnsRenamed({"latitude": "at_lat", "longitude": "at_lon"})


def _slots(centre: Column, reach: Column, size: float) -> Column:
    return F.sequence(F.floor((centre - reach) / size), F.floor((centre + reach) / size))


BUCKET = 4  # side of a bucket of the radius join, in radii


def radius_join(points: DataFrame, cells: DataFrame, radius_m: float = P.RESCUE_RADIUS_M,
                metric: str = "planar", clipped: bool | None = None, keys=(), salts: int = 1,
                inclusive: bool = True) -> DataFrame:
    """Pairs (point, cell) within the radius, as an equi-join on buckets of four radii.

    A point lies in one bucket; a cell is copied to the (mostly one or two, at
    most four, at high latitude a few more) buckets its disc can touch, so all
    pairs of a point are made in one place and what follows can limit or add
    them up before a shuffle.  ``clipped`` also applies
    the un-scaled longitude box of the planar metric, which cuts the disc to
    the east and west.  ``salts`` > 1 spreads one crowded bucket over that
    many keys: a cell takes one salt by its id, a point asks for all of them.
    Without it, adaptive execution still splits a skewed partition.  Neither
    side is sent to all tasks: both grow, and files tell little of their size.
    """
    clipped = metric == "planar" if clipped is None else clipped
    size = radius_m / METRES_PER_DEGREE[metric]
    side, reach = size * BUCKET, F.lit(size * 1.0001)
    widest = F.cos(F.radians(F.least(F.abs("latitude") + reach, F.lit(90.0))))
    width = reach if clipped or metric == "degrees" else F.least(F.coalesce(F.try_divide(reach, widest), F.lit(360.0)), F.lit(360.0))
    probes = (_renamed(points)
              .withColumns({"_by": F.floor(F.col("at_lat") / side), "_bx": F.floor(F.col("at_lon") / side)})
              .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
    bucketed = (cells.withColumn("_salt", F.pmod(F.xxhash64("cell_id"), F.lit(salts)).cast("int") if salts > 1 else F.lit(0))
                .withColumn("_by", F.explode(_slots(F.col("latitude"), reach, side)))
                .withColumn("_bx", F.explode(_slots(F.col("longitude"), width, side))))
    pairs = probes.join(bucketed.hint("merge"), [*keys, "_by", "_bx", "_salt"])
    if clipped:
        pairs = pairs.where(
            F.col("latitude").between(F.col("at_lat") - size, F.col("at_lat") + size)
            & F.col("longitude").between(F.col("at_lon") - size, F.col("at_lon") + size))
    away = METRICS[metric](*map(F.col, ("at_lat", "at_lon", "latitude", "longitude")))
    pairs = pairs.withColumn("distance_m", away)
    near = F.col("distance_m") <= radius_m if inclusive else F.col("distance_m") < radius_m
    return pairs.where(near).drop("_by", "_bx", "_salt")


def nearest_join(points: DataFrame, cells: DataFrame, point_id: str, metric: str = "euclid", keys=(), cell_id: str = "cell_id") -> DataFrame:
    """Nearest cell of every point (ties: lowest cell id), exact at any distance, through a pyramid of occupied buckets.

    Copies of a position are reduced to one cell first.  Result: point_id, near_id, near_m (degrees for the Euclidean metric, their square
    for "square"); both are null for a point without coordinates or, with keys, without cells.
    """
    spots = cells.groupBy(*keys, "latitude", "longitude").agg(F.min(cell_id).alias("spot"))
    tree = pyramid.pyramid(spots, keys)
    at = staged(_renamed(points).select(point_id, *keys, "at_lat", "at_lon"))
    if tree is None:
        return at.select(point_id, F.lit(None).cast(cells.schema[cell_id].dataType).alias("near_id"), F.lit(None).cast("double").alias("near_m"))
    return at.select(point_id).join(pyramid.nearest(at, tree, point_id, metric).hint("merge"), point_id, "left")


def snap_to_grid(points: DataFrame, grids: DataFrame, keys=("grid_id",), lat="latitude", lon="longitude") -> DataFrame:
    """Nearest (row, col) of a regular grid by arithmetic; ties go to the lower index.

    ``grids`` is the one-row-per-grid geometry.  Rows run with longitude.
    """
    def index(value, origin, step, count):
        steps = F.coalesce(F.try_divide(value - origin, step), F.lit(0.0))
        return F.least(F.greatest(F.ceil(F.round(steps, 9) - 0.5), F.lit(0)), count - 1).cast("int")

    g = grids.select(*keys, "lat0", "lon0", "lat_step", "lon_step", "n_rows", "n_cols")
    return (points.join(g, list(keys))
            .withColumns({"row": index(F.col(lon), F.col("lon0"), F.col("lon_step"), F.col("n_rows")),
                          "col": index(F.col(lat), F.col("lat0"), F.col("lat_step"), F.col("n_cols"))})
            .drop("lat0", "lon0", "lat_step", "lon_step", "n_rows", "n_cols"))


def truncated_index(value: Column, origin: Column, step: Column) -> Column:
    """The truncating variant of the grid look-up."""
    return ((value - origin) / step).cast("int")


def box_degrees(points: DataFrame, cells: DataFrame, half: float = 0.15, keys=(), at_least: int = 10) -> DataFrame:
    """Cell count and extent of the +-half degree box of each point.

    Cells are first summed per small bucket, so a box adds up bucket totals
    for its inside and looks at single cells only along its rim.  A point lies
    in one tile of 16 x 16 buckets and the totals are copied to the tiles they
    matter to, so a point meets only buckets that hold cells.  No side is sent
    to all tasks: all of them grow with the input.
    """
    parts, tile = 8, 16
    size = half / parts
    buckets = cells.withColumns({"_by": F.floor(F.col("latitude") / size),
                                 "_bx": F.floor(F.col("longitude") / size)})
    totals = buckets.groupBy(*keys, "_by", "_bx").agg(F.count("*").alias("n_cells"),
                                                      F.sum("elevation").alias("sum_elev"))
    at = _renamed(points).select("incident_id", *keys, "at_lat", "at_lon")
    at = at.withColumns({f"_t{c}": F.floor(F.floor(F.col(x) / size) / tile) for c, x in (("y", "at_lat"), ("x", "at_lon"))})
    copied = totals
    for c in "yx":  # a bucket more than a box reaches, for the rounding
        copied = copied.withColumn(f"_t{c}", F.explode(_slots(F.col(f"_b{c}"), F.lit(parts + 1), tile)))

    def touched(slot, centre):
        return slot.between(F.floor((centre - half) / size), F.floor((centre + half) / size))

    def inside(slot, centre):
        return (slot * size >= centre - half) & ((slot + 1) * size < centre + half)

    sides = ((F.col("_by"), F.col("at_lat")), (F.col("_bx"), F.col("at_lon")))
    probes = at.join(copied.hint("merge"), [*keys, "_ty", "_tx"])
    for s in sides:
        probes = probes.where(touched(*s))
    whole = inside(*sides[0]) & inside(*sides[1])
    full = probes.where(whole).select("incident_id", "n_cells", "sum_elev")
    rim = (probes.where(~whole).drop("n_cells", "sum_elev", "_ty", "_tx").join(buckets.hint("merge"), [*keys, "_by", "_bx"])
           .where(F.col("latitude").between(F.col("at_lat") - half, F.col("at_lat") + half)
                  & F.col("longitude").between(F.col("at_lon") - half, F.col("at_lon") + half))
           .groupBy("incident_id").agg(F.count("*").alias("n_cells"), F.sum("elevation").alias("sum_elev")))
    return (full.unionByName(rim).groupBy("incident_id")
            .agg(F.sum("n_cells").alias("n_cells"), F.sum("sum_elev").alias("sum_elev"))
            .where(F.col("n_cells") >= at_least))


def km_box(lat: Column, lon: Column, at_lat: Column, at_lon: Column, km: float = 5.0) -> Column:
    """Inside a +-km box, longitude scaled by the cosine of the latitude."""
    dlat = F.lit(km / 111.0)
    dlon = km / (111.0 * F.cos(F.radians(at_lat)))
    return lat.between(at_lat - dlat, at_lat + dlat) & lon.between(at_lon - dlon, at_lon + dlon)


def weather_by_cell(cells: DataFrame, weather: DataFrame) -> DataFrame:
    """Left join of forecast weather on the 5 km grid; the weather side is made unique first."""
    nx, ny = geo.lcc_cell(F.col("latitude"), F.col("longitude"))
    first = weather.groupBy("nx", "ny").agg(F.min(F.struct("source_id", "ws", "wd")).alias("w")) \
        .select("nx", "ny", F.col("w.ws").alias("wind_speed"), F.col("w.wd").alias("wind_direction"))
    return cells.withColumns({"nx": nx, "ny": ny}).join(first, ["nx", "ny"], "left")


def layers_at(points: DataFrame, grid: DataFrame, columns, keys=("grid_id",), how: str = "left") -> DataFrame:
    """Read grid layers at the (row, col) of each point."""
    return points.join(grid.select(*keys, "row", "col", *columns), [*keys, "row", "col"], how)

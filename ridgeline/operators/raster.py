"""Grid layers: slope, aspect, curvature, ridges, neighbourhood means and maxima.

Cells are long rows keyed (grid_id, row, col).  Value frames (rangeBetween)
find the neighbour at exactly row-1, so a hole in the grid gives null, not the
wrong neighbour.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ridgeline import params as P
from ridgeline.functions import geo
from ridgeline.operators import mesh, spatial
from ridgeline.operators.tiles import tiled, untiled
from ridgeline.session import staged

KEYS = ("grid_id",)


def _axis(axis: str, keys=KEYS):
    other = "col" if axis == "row" else "row"
    return W.partitionBy(*keys, "_tr", "_tc", other).orderBy(axis)


def _gradient(value: str, axis: str, spacing: Column, keys=KEYS) -> Column:
    """Central difference inside, one-sided at the border of the grid."""
    w = _axis(axis, keys)
    before = F.max(value).over(w.rangeBetween(-1, -1))
    after = F.max(value).over(w.rangeBetween(1, 1))
    here = F.col(value)
    return (F.when(before.isNull(), (after - here) / spacing)
            .when(after.isNull(), (here - before) / spacing)
            .otherwise((after - before) / (spacing * 2)))


def geometry(cells: DataFrame, keys=KEYS) -> DataFrame:
    """Bounds, steps and metric spacing of each grid: one row per grid."""
    bounds = cells.groupBy(*keys).agg(
        F.min("latitude").alias("lat0"), F.max("latitude").alias("lat1"),
        F.min("longitude").alias("lon0"), F.max("longitude").alias("lon1"),
        (F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"))
    stepped = bounds.withColumns({
        "lat_step": F.try_divide(F.col("lat1") - F.col("lat0"), F.col("n_cols") - 1),
        "lon_step": F.try_divide(F.col("lon1") - F.col("lon0"), F.col("n_rows") - 1)})
    lat = F.col("lat0") + F.col("lat_step") * F.floor(F.col("n_cols") / 2)
    lon = F.col("lon0") + F.col("lon_step") * F.floor(F.col("n_rows") / 2)
    return stepped.withColumns({
        "row_m": geo.haversine_m(lat, lon, lat, lon + F.col("lon_step")),
        "col_m": geo.haversine_m(lat, lon, lat + F.col("lat_step"), lon)})


def terrain_layer(cells: DataFrame, row_m: Column, col_m: Column, keys=KEYS, tile: int = 256) -> DataFrame:
    """slope, aspect, curvature, is_ridge, is_valley from one shuffle by tile.

    Slope uses the given spacing per axis, aspect unit spacing and curvature
    a fixed spacing, since the ridge threshold was tuned for it.
    """
    fixed = F.lit(P.CURVATURE_SPACING_M)
    t = tiled(cells.withColumns({"_row_m": row_m, "_col_m": col_m}), 2, keys, tile)
    t = t.withColumns({
        "_d_row": _gradient("elevation", "row", F.lit(1.0), keys),
        "_d_col": _gradient("elevation", "col", F.lit(1.0), keys)})
    t = t.withColumns({"_c_row": F.col("_d_row") / fixed, "_c_col": F.col("_d_col") / fixed})
    t = t.withColumn("curvature", _gradient("_c_row", "row", fixed, keys)
                     + _gradient("_c_col", "col", fixed, keys))
    s_row, s_col = F.col("_d_row") / F.col("_row_m"), F.col("_d_col") / F.col("_col_m")
    t = t.withColumns({
        "slope": F.degrees(F.atan(F.sqrt(s_row * s_row + s_col * s_col))),
        "aspect": F.pmod(F.degrees(F.atan2(-F.col("_d_row"), F.col("_d_col"))) + 360, F.lit(360.0)),
        "is_ridge": F.col("curvature") < -P.RIDGE_CURVATURE,
        "is_valley": F.col("curvature") > P.RIDGE_CURVATURE})
    return untiled(t, tile).drop("_d_row", "_d_col", "_c_row", "_c_col", "_row_m", "_col_m")


def neighbourhood(cells: DataFrame, value: str, reach: int, how: str, name: str, keys=KEYS,
                  tile: int = 256) -> DataFrame:
    """Mean or maximum over the square of +-reach cells, clipped at the border.

    Both are separable: one pass along the rows, one along the columns.
    """
    t = tiled(cells, reach, keys, tile)
    row_frame = _axis("row", keys).rangeBetween(-reach, reach)
    col_frame = _axis("col", keys).rangeBetween(-reach, reach)
    if how == "max":
        t = t.withColumn("_pass", F.max(value).over(row_frame))
        t = t.withColumn(name, F.max("_pass").over(col_frame)).drop("_pass")
    else:
        t = t.withColumns({"_sum": F.sum(value).over(row_frame), "_cnt": F.count(value).over(row_frame)})
        t = t.withColumn(name, F.sum("_sum").over(col_frame) / F.sum("_cnt").over(col_frame))
        t = t.drop("_sum", "_cnt")
    return untiled(t, tile)


def forest_layer(cells: DataFrame, ratio: str | None = "density_ratio", forest: Column | None = None) -> DataFrame:
    """Forest mask, clipped density and canopy height.

    With a measured ratio the density is that ratio (missing = 0); without
    one it is approximated from the mask.
    """
    mask = forest if forest is not None else F.coalesce(F.col(ratio) > P.FOREST_RATIO_FROM, F.lit(False))
    if ratio is not None:
        density = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(ratio), F.lit(0.0))))
    else:
        density = F.when(mask, P.FOREST_DENSITY).otherwise(0.0)
    return cells.withColumns({
        "is_open": ~mask, "density": density,
        "canopy": F.when(mask, P.FOREST_CANOPY_M).otherwise(P.OPEN_CANOPY_M)})


def scatter_to_grid(points: DataFrame, n: int, keys=KEYS) -> DataFrame:
    """Scattered samples to an n x n grid per key: elevation linear in the triangles of the samples, density of the nearest sample.

    points: keys, cell_id, latitude, longitude, elevation, density_ratio; of samples in one place the lowest cell_id counts.  The grid
    spans the samples.  Grid cells outside the triangles take the mean of the interpolated ones of their key, or of the samples if no
    triangle exists.  Rows run with longitude.
    """
    samples = staged(points.where("elevation is not null").select(*keys, "cell_id", "latitude", "longitude", "elevation", "density_ratio"))
    b = staged(samples.groupBy(*keys).agg(
        F.min("latitude").alias("lat0"), F.max("latitude").alias("lat1"), F.min("longitude").alias("lon0"), F.max("longitude").alias("lon1"),
        F.avg("elevation").alias("_mean")))
    steps = {f"{c}_step": (F.col(f"{c}1") - F.col(f"{c}0")) / (n - 1) for c in ("lat", "lon")}
    every = F.sequence(F.lit(0), F.lit(n - 1))
    frame = b.withColumns(steps).withColumn("row", F.explode(every)).withColumn("col", F.explode(every))
    place = F.to_json(F.struct(*keys, "row", "col"))
    frame = staged(frame.select(*keys, "row", "col", place.alias("place"), "_mean", (F.col("lat0") + F.col("col") * F.col("lat_step")).alias("latitude"),
                                (F.col("lon0") + F.col("row") * F.col("lon_step")).alias("longitude")))
    net = samples.select(*keys, F.col("cell_id").alias("station_id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), "elevation")
    linear = staged(mesh.located(frame, staged(mesh.faces_of(net, ("elevation",), keys)), ("elevation",), "place", keys))
    near = spatial.nearest_join(frame, samples, "place", "square", keys)
    dense = near.join(samples.select(F.col("cell_id").alias("near_id"), "density_ratio"), "near_id").select("place", "density_ratio")
    fill = frame.join(linear, "place").groupBy(*keys).agg(F.avg("elevation").alias("_inside"))
    return (frame.join(linear, "place", "left").join(dense, "place", "left").join(fill, list(keys), "left")
            .withColumn("elevation", F.coalesce("elevation", "_inside", "_mean"))
            .select(*keys, "row", "col", "latitude", "longitude", "elevation", "density_ratio"))

"""Pyramids of occupied buckets: nearest spots and empty circles without growing searches.

Spots lie in buckets of a leaf size at which no bucket is crowded; four by four buckets make one bucket of the level above, up to a root
that holds them all.  The table has one row per occupied bucket and level, with one of its spots.  A search goes down from the root and
keeps the buckets that can still matter, so its work follows the answer and not the density or the distance.
"""

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ridgeline.functions import geo
from ridgeline.session import staged

LEAF = 32  # a point is compared with all spots of its few buckets, and these pairs are sorted
FINEST = 1e-9  # degrees; buckets are not made smaller
SMALL = 1 << 16
ROOTS = 16  # buckets of a key that a search starts from


@dataclass
class Pyramid:
    spots: DataFrame  # spot, latitude, longitude, keys, by, bx
    tree: DataFrame  # keys, level, by, bx, py, px, spot, s_lat, s_lon
    keys: tuple
    size: float
    levels: int
    lat0: float
    lon0: float
    top: int  # lowest level at which no key has more than ROOTS buckets: where searches start, however far apart the keys lie

    def at(self, level: int) -> DataFrame:
        """Buckets of a level; their number is bounded near the root, where they are sent to the tasks."""
        rows = self.tree.where(F.col("level") == level).drop("level")
        return F.broadcast(rows) if not self.keys and 16 ** (self.levels - level) <= SMALL else rows.hint("merge")

    def box(self, level: int) -> tuple[Column, Column, Column, Column]:
        """South, north, west and east of a bucket."""
        size = self.size * 4.0 ** level
        return (self.lat0 + F.col("by") * size, self.lat0 + (F.col("by") + 1) * size,
                self.lon0 + F.col("bx") * size, self.lon0 + (F.col("bx") + 1) * size)

    def down(self, rows: DataFrame, level: int) -> DataFrame:
        """rows with all buckets of their key at the top level, and from there rows(by, bx, ...) with the buckets of the next level."""
        if level < self.top:
            return rows.withColumnsRenamed({"by": "py", "bx": "px"}).join(self.at(level), [*self.keys, "py", "px"]).drop("py", "px")
        buckets = self.at(level).drop("py", "px")
        return rows.join(buckets, list(self.keys)) if self.keys else rows.crossJoin(F.broadcast(buckets))


def _central(size, lat0: float, lon0: float) -> Column:
    """A spot with its distance to the middle of its bucket first: one near the middle bounds the distance of the others best."""
    dy, dx = (F.col(c) - o - (F.col(b) + 0.5) * size for c, o, b in (("latitude", lat0, "by"), ("longitude", lon0, "bx")))
    return F.struct((dy * dy + dx * dx).alias("off"), "spot", "latitude", "longitude")


def pyramid(spots: DataFrame, keys=(), most: int = LEAF) -> Pyramid | None:
    """The pyramid of spots(spot, latitude, longitude, keys) with different positions; None without spots."""
    spots = staged(spots.where("latitude is not null and longitude is not null"))
    e = spots.agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("latitude", "longitude")], F.count("*").alias("n")).first()
    if not e["n"]:
        return None
    lat0, lon0 = e["min_latitude"], e["min_longitude"]
    extent = max(e["max_latitude"] - lat0, e["max_longitude"] - lon0, FINEST)
    size = extent / math.sqrt(e["n"])
    while True:
        by, bx = (F.floor((F.col(c) - o) / size) for c, o in (("latitude", lat0), ("longitude", lon0)))
        placed = spots.withColumns({"by": by, "bx": bx})
        if size <= FINEST or placed.groupBy(*keys, "by", "bx").count().agg(F.max("count")).first()[0] <= most:
            break
        size /= 2
    levels = max(1, math.ceil(math.log(extent / size + 1e-9, 4)) + 1)
    leaves = staged(placed.groupBy(*keys, "by", "bx").agg(F.min(_central(size, lat0, lon0)).alias("one")))
    wide = F.lit(size) * F.pow(F.lit(4.0), F.col("level"))
    tree = (leaves.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
            .select(*keys, "level", F.expr("shiftright(by, 2 * level)").alias("by"), F.expr("shiftright(bx, 2 * level)").alias("bx"),
                    "one.spot", "one.latitude", "one.longitude")
            .groupBy(*keys, "level", "by", "bx").agg(F.min(_central(wide, lat0, lon0)).alias("one"))
            .select(*keys, "level", "by", "bx", F.shiftright("by", 2).alias("py"), F.shiftright("bx", 2).alias("px"),
                    "one.spot", F.col("one.latitude").alias("s_lat"), F.col("one.longitude").alias("s_lon")))
    tree = staged(tree)
    top = (tree.groupBy(*keys, "level").count().groupBy("level").agg(F.max("count").alias("most"))
           .where(F.col("most") <= ROOTS).agg(F.min("level")).first()[0])  # the root is one bucket
    return Pyramid(placed, tree, tuple(keys), size, levels, lat0, lon0, top)


def _gap(low, high, other_low, other_high) -> tuple[Column, Column]:
    """Least and largest distance of a value of one interval to a value of the other."""
    return (F.greatest(other_low - high, low - other_high, F.lit(0.0)), F.greatest(other_high - low, high - other_low))


def _square(dy: Column, dx: Column) -> Column:
    return dy * dy + dx * dx


def _flat(root: bool):
    def between(a, b):
        (y0, y1), (x0, x1) = _gap(*a[:2], *b[:2]), _gap(*a[2:], *b[2:])
        near, far = _square(y0, x0), _square(y1, x1)
        return (F.sqrt(near), F.sqrt(far)) if root else (near, far)
    return between


def _sphere(a, b):
    """Bounds of the great-circle distance between two boxes, by the extremes of each term of its formula."""
    (y0, y1), (x0, x1) = _gap(*a[:2], *b[:2]), _gap(*a[2:], *b[2:])

    def cosine(low, high):
        ends = [F.greatest(F.cos(F.radians(x)), F.lit(0.0)) for x in (low, high)]
        return F.least(*ends), F.when((low < 0) & (high > 0), 1.0).otherwise(F.greatest(*ends))

    def half_sine(x):
        return F.pow(F.sin(F.radians(F.least(x, F.lit(360.0))) / 2), 2)

    (a0, a1), (b0, b1) = cosine(*a[:2]), cosine(*b[:2])
    most = F.when((x0 <= 180) & (x1 >= 180), 1.0).otherwise(F.greatest(half_sine(x0), half_sine(x1)))
    near = half_sine(F.least(y0, F.lit(180.0))) + a0 * b0 * F.least(half_sine(x0), half_sine(x1))
    far = F.least(half_sine(F.least(y1, F.lit(180.0))) + a1 * b1 * most, F.lit(1.0))
    return tuple(F.lit(2 * geo.P.EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(x, F.lit(1.0)))) for x in (near, far))


# metric: (distance of two positions, bounds of the distance between boxes given as south, north, west, east)
METRICS: dict[str, tuple[Callable, Callable]] = {
    "euclid": (geo.degrees_apart, _flat(True)),
    "square": (lambda a, b, c, d: _square(a - c, b - d), _flat(False)),
    "haversine": (geo.haversine_m, _sphere),
}


def nearest(points: DataFrame, tree: Pyramid, point_id: str, metric: str) -> DataFrame:
    """(point_id, near_id, near_m): nearest spot of every point(point_id, at_lat, at_lon, keys); ties go to the lowest spot.

    Points of one small box go down the pyramid together.  In each level a bucket stays if its nearest place is not farther from the
    box than the farthest that any bucket's known spot can be.  points are read twice and should be staged.
    """
    distance, between = METRICS[metric]
    keys, query = list(tree.keys), tree.size / 2
    boxed = (points.where("at_lat is not null and at_lon is not null")
             .withColumns({"qy": F.floor(F.col("at_lat") / query), "qx": F.floor(F.col("at_lon") / query)}))
    own = ("south", "north", "west", "east")
    boxes = boxed.groupBy(*keys, "qy", "qx").agg(F.min("at_lat").alias("south"), F.max("at_lat").alias("north"),
                                                 F.min("at_lon").alias("west"), F.max("at_lon").alias("east"))
    near = boxes.withColumn("_most", F.lit(float("nan")))  # above all numbers
    reach = F.col("_most") * (1 + 1e-9) + 1e-12
    for level in range(tree.top, -1, -1):
        box = tuple(map(F.col, own))
        spot = (F.col("s_lat"), F.col("s_lat"), F.col("s_lon"), F.col("s_lon"))
        near = tree.down(near, level).withColumns({"_least": between(box, tree.box(level))[0], "_spot": between(box, spot)[1]})
        near = (near.where(F.col("_least") <= reach)  # by the bound of the level above, so that few buckets are shuffled
                .withColumn("_most", F.least("_most", F.min("_spot").over(W.partitionBy(*keys, "qy", "qx"))))
                .where(F.col("_least") <= reach).select(*keys, "qy", "qx", *own, "by", "bx", "_most"))
    # boxes, points and spots grow with the input, whatever their files weigh: they are shuffled, not sent to all tasks
    met = (boxed.join(near.drop(*own, "_most").hint("merge"), [*keys, "qy", "qx"])
           .join(tree.spots.select(*keys, "by", "bx", F.col("spot").alias("near_id"), "latitude", "longitude").hint("merge"), [*keys, "by", "bx"])
           .withColumn("near_m", distance(*map(F.col, ("at_lat", "at_lon", "latitude", "longitude")))))
    return met.groupBy(point_id).agg(F.min(F.struct("near_m", "near_id")).alias("_best")).select(point_id, "_best.near_id", "_best.near_m")

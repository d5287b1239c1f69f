"""Delaunay triangles of any number of stations, by tiles that grow.

Stations are meshed in the widest tiles of which none has more than TILE stations.  A triangle counts if its circle holds no station: it is certified on the spot if
the circle lies in the tile, and otherwise looked up in the pyramid of all stations.  Stations whose surrounding is not closed yet (an
edge with one triangle, or none at all) go on to tiles four times as wide, without the finished ones; the widest tile holds what is left
around the hull.  Every missing triangle has open corners only, and an empty circle is empty in each part, so no triangle is lost.

Stations on one circle without another inside make a polygon, which is fanned from its lowest station, so the mesh does not depend on
tiles or on the order of rows.  Of stations in one place the lowest takes part.
"""

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ridgeline.operators import pyramid
from ridgeline.session import staged

LEAF, TILE = 64, 512
OWN = 256  # stations whose surroundings are walked in step
NEAR = 1e-10
CORNERS = "ids array<long>, xs array<double>, ys array<double>"
FACES = "i long, j long, k long"


def local_triangles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Index triples of the Delaunay triangles of distinct points, found by walking around every point, all points in step.

    The nearest other point makes an edge of the mesh; the next corner on the left of an edge is the one whose circle reaches least
    far.  The walk ends where it began or at the hull, and then goes the other way round.  Of points on one circle some triangles are found.
    """
    out = []
    for first_row in range(0, len(x) if len(x) > 2 else 0, OWN):
        own = np.arange(first_row, min(first_row + OWN, len(x)))
        dx, dy = x[None, :] - x[own, None], y[None, :] - y[own, None]
        far = dx * dx + dy * dy
        other = far.copy()
        other[np.arange(len(own)), own] = np.inf
        start, length = np.argmin(other, axis=1), np.sqrt(far)
        live = np.arange(len(own))
        for sign in (1, -1):
            edge, at, hull = start.copy(), live, []
            for _ in range(len(x)):
                if not len(at):
                    break
                ex, ey = dx[at, edge[at]][:, None], dy[at, edge[at]][:, None]
                side = sign * (ex * dy[at] - ey * dx[at])
                left = side > NEAR * length[at] * length[at, edge[at]][:, None]
                reach = np.where(left, (far[at] - dx[at] * ex - dy[at] * ey) / np.where(left, side, 1.0), np.inf)
                corner = np.argmin(reach, axis=1)
                found = left.any(axis=1)
                hull.append(at[~found])
                at, corner = at[found], corner[found]
                out.append(np.sort(np.stack([own[at], edge[at], corner], axis=1), axis=1))
                edge[at] = corner
                at = at[corner != start[at]]
            live = np.concatenate(hull) if hull else live[:0]  # a closed walk needs no other way round
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.int64)


def circle(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres of the circles of triangles, given as rows of three corners, relative to the first corner."""
    bx, by, cx, cy = x[:, 1] - x[:, 0], y[:, 1] - y[:, 0], x[:, 2] - x[:, 0], y[:, 2] - y[:, 0]
    twice, b, c = 2 * (bx * cy - by * cx), bx * bx + by * by, cx * cx + cy * cy
    return (cy * b - by * c) / twice, (bx * c - cx * b) / twice


def _inside(px, py, cx, cy):
    """Power of points to circles through the origin with centre (cx, cy), and what counts as zero; works for arrays and Columns."""
    square = px * px + py * py
    sqrt = np.sqrt if isinstance(square, np.ndarray) else F.sqrt
    return square - 2 * (cx * px + cy * py), NEAR * (square + sqrt(square) * sqrt(cx * cx + cy * cy))


def _tile(stations: pd.DataFrame, leaf: bool, whole: bool, keys, size: float, lat0: float, lon0: float) -> pd.DataFrame:
    """Triangles of a tile's stations with their circles; certified ones have all stations of the circle as corners."""
    ids, lat, lon = (stations[c].to_numpy() for c in ("spot", "latitude", "longitude"))
    order = np.argsort(ids, kind="stable")
    ids, lat, lon = ids[order], lat[order], lon[order]
    x, y = lon - lon.mean(), lat - lat.mean()
    faces = local_triangles(x, y)
    cx, cy = circle(x[faces], y[faces])
    ok = np.isfinite(cx) & np.isfinite(cy)
    faces, cx, cy = faces[ok], cx[ok], cy[ok]
    ax, ay = lon[faces[:, 0]], lat[faces[:, 0]]
    radius = np.hypot(cx, cy) * (1 + 1e-9)
    if whole:
        sure = np.ones(len(faces), bool)
    elif leaf:
        south, west = (stations[c].iloc[0] * size + o for c, o in (("ty", lat0), ("tx", lon0)))
        sure = ((ax + cx - radius >= west) & (ax + cx + radius < west + size) & (ay + cy - radius >= south) & (ay + cy + radius < south + size))
    else:
        sure = np.zeros(len(faces), bool)
    rows = []
    for k, corners in enumerate(faces):
        if sure[k]:
            power, zero = _inside(lon - ax[k], lat - ay[k], cx[k], cy[k])
            corners = np.union1d(corners, np.flatnonzero(np.abs(power) <= zero))
        rows.append((ids[corners].tolist(), lon[corners].tolist(), lat[corners].tolist()))
    out = pd.DataFrame(rows, columns=["ids", "xs", "ys"])
    return out.assign(cx=cx, cy=cy, sure=sure, **{k: stations[k].iloc[0] for k in keys})


def _tiler(*how):
    def tile(stations: pd.DataFrame) -> pd.DataFrame:
        return _tile(stations, *how)

    return tile


def _fans(batches):
    """Triangles of polygons, counter-clockwise from the lowest station."""
    for polygons in batches:
        out = []
        for ids, xs, ys in zip(polygons["ids"], polygons["xs"], polygons["ys"]):
            order = np.argsort(ids)
            ids, xs, ys = ids[order], xs[order], ys[order]
            around = 1 + np.argsort(np.arctan2(ys[1:] - ys.mean(), xs[1:] - xs.mean()), kind="stable")
            turn = np.arctan2(ys - ys.mean(), xs - xs.mean())
            around = around[np.argsort((turn[around] - turn[0]) % (2 * np.pi), kind="stable")]
            out += [(ids[0], ids[j], ids[k]) for j, k in zip(around, around[1:])]
        yield pd.DataFrame(out, columns=["i", "j", "k"], dtype="int64")


def _verified(candidates: DataFrame, tree: pyramid.Pyramid) -> DataFrame:
    """Candidates whose circle holds no station of the pyramid, with all stations on the circle.

    A circle goes down through the occupied buckets that it touches, and is dropped as soon as a bucket's known station lies inside.
    """
    key = W.partitionBy(*tree.keys, "a", "b", "c")
    ax, ay = F.col("xs")[0], F.col("ys")[0]
    radius = F.sqrt(F.col("cx") * F.col("cx") + F.col("cy") * F.col("cy"))
    rows = candidates.select(*tree.keys, *[F.col("ids")[n].alias(c) for n, c in enumerate("abc")], ax.alias("ax"), ay.alias("ay"), "cx", "cy",
                             (radius * (1 + 1e-9)).alias("radius"))
    own = (*tree.keys, "a", "b", "c", "ax", "ay", "cx", "cy", "radius")

    def holds(lon, lat):
        power, zero = _inside(lon - F.col("ax"), lat - F.col("ay"), F.col("cx"), F.col("cy"))
        return power < -zero, F.abs(power) <= zero

    for level in range(tree.top, -1, -1):
        south, north, west, east = tree.box(level)
        off_y = F.greatest(south - F.col("ay") - F.col("cy"), F.col("ay") + F.col("cy") - north, F.lit(0.0))
        off_x = F.greatest(west - F.col("ax") - F.col("cx"), F.col("ax") + F.col("cx") - east, F.lit(0.0))
        rows = tree.down(rows, level).where(off_x * off_x + off_y * off_y <= F.col("radius") * F.col("radius") * (1 + 1e-9))
        inside = F.max(holds(F.col("s_lon"), F.col("s_lat"))[0]).over(key)
        rows = rows.withColumn("_in", inside).where(~F.col("_in")).select(*own, "by", "bx")
    inside, on = holds(F.col("longitude"), F.col("latitude"))
    met = rows.join(tree.spots.select(*tree.keys, "by", "bx", "spot", "latitude", "longitude"), [*tree.keys, "by", "bx"]).withColumns({"_in": inside, "_on": on}).where("_in or _on")
    rim = F.when(F.col("_on"), F.struct("spot", "longitude", "latitude"))
    return (met.groupBy("a", "b", "c").agg(F.max("_in").alias("_in"), F.array_sort(F.collect_set(rim)).alias("rim")).where(~F.col("_in"))
            .select(F.col("rim.spot").alias("ids"), F.col("rim.longitude").alias("xs"), F.col("rim.latitude").alias("ys")))


def _from_own_corner(stations: DataFrame, keys) -> DataFrame:
    """Stations with by and bx counted from the lowest of their key, so tiles cut a key only where it is wider than they are."""
    low = stations.groupBy(*keys).agg(F.min("by").alias("_by"), F.min("bx").alias("_bx"))
    low = low.select(*[F.col(k).alias(f"_{k}") for k in keys], "_by", "_bx")
    same_key = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.lit(True))
    own = stations.join(low, same_key) if keys else stations.crossJoin(low)
    return own.withColumns({"by": F.col("by") - F.col("_by"), "bx": F.col("bx") - F.col("_bx")}).select(*stations.columns)


def triangles(net: DataFrame, keys=()) -> DataFrame:
    """Delaunay triangles (i, j, k) of net(station_id, lat, lon), counter-clockwise from the lowest station; a mesh for each key.

    Station ids are unique over all keys.
    """
    places = net.groupBy(*keys, F.col("lat").alias("latitude"), F.col("lon").alias("longitude")).agg(F.min("station_id").cast("long").alias("spot"))
    tree = pyramid.pyramid(places, keys, LEAF)
    kind = net.schema["station_id"].dataType.simpleString()
    if tree is None:
        return net.sparkSession.createDataFrame([], f"i {kind}, j {kind}, k {kind}")
    own = "".join(f", {k} {net.schema[k].dataType.simpleString()}" for k in keys)
    open_, found, sides = tree.spots.select(*keys, "spot", "latitude", "longitude", "by", "bx"), [], None
    crowds = (open_.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(tree.levels))))
              .groupBy(*keys, "level", F.expr("shiftright(by, 2 * level)").alias("ty"), F.expr("shiftright(bx, 2 * level)").alias("tx")).count()
              .groupBy("level").agg(F.max("count").alias("most")).where(F.col("most") <= TILE).agg(F.max("level")).first()[0])  # leaves never exceed it
    for level in range(crowds or 0, tree.levels + 1):
        size = tree.size * 4.0 ** level
        leaf = not found
        whole = leaf and level == tree.levels
        placed = open_ if leaf else _from_own_corner(open_, keys)
        tiled = placed.withColumns({"ty": F.expr(f"shiftright(by, {2 * level})"), "tx": F.expr(f"shiftright(bx, {2 * level})")})
        mesh = staged(tiled.groupBy(*keys, "ty", "tx").applyInPandas(
            _tiler(leaf, whole, keys, size, tree.lat0, tree.lon0), f"{CORNERS}, cx double, cy double, sure boolean{own}"))
        polygons = mesh.where("sure").select("ids", "xs", "ys")
        if not whole:
            polygons = polygons.unionByName(_verified(mesh.where("not sure"), tree))
        found.append(staged(polygons.where("size(ids) > 2").mapInPandas(_fans, FACES).distinct()))
        if level == tree.levels:
            break
        # a side with its third corner; those of finished stations do not change any more and are left out of the next level
        corners = [F.struct(F.least(u, v).alias("u"), F.greatest(u, v).alias("v"), F.col(w).alias("w"))
                   for u, v, w in (("i", "j", "k"), ("j", "k", "i"), ("i", "k", "j"))]
        new = found[-1].select(F.explode(F.array(*corners)).alias("e")).select("e.*")
        sides = new if sides is None else sides.unionByName(new).distinct()
        rim = (sides.groupBy("u", "v").count().where("count = 1").select(F.explode(F.array("u", "v")).alias("spot")).distinct())
        met = sides.select(F.explode(F.array("u", "v")).alias("spot")).distinct()
        more = tiled.select(*keys, "ty", "tx").distinct().groupBy(*keys).count().where("count > 1")  # a key in one tile has all its triangles
        parted = more.select(*[F.col(k).alias(f"_{k}") for k in keys], F.lit(1).alias("_parted"))
        same_key = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.lit(True))
        open_ = staged(open_.join(rim, "spot", "left_semi").unionByName(open_.join(met, "spot", "left_anti")).join(parted, same_key, "left_semi"))
        if open_.isEmpty():
            break
        for end in "uv":
            sides = sides.join(open_.select(F.col("spot").alias(end)), end, "left_semi")
        sides = staged(sides.select("u", "v", "w"))
    faces = reduce(DataFrame.unionByName, found).distinct()
    return faces.select(*[F.col(c).cast(kind).alias(c) for c in "ijk"])


def faces_of(net: DataFrame, values, keys=()) -> DataFrame:
    """Triangles with their corner positions and the values to interpolate."""
    out = triangles(net, keys)
    for corner in ("i", "j", "k"):
        own = keys if corner == "i" else ()
        out = out.join(net.select(*own, F.col("station_id").alias(corner), F.struct("lat", "lon", *values).alias(f"p_{corner}")), corner)
    return out


def barycentric(lat, lon) -> dict:
    """Weights of the corners p_i, p_j, p_k at a position."""
    def at(corner, c):
        return F.col(f"p_{corner}.{c}")

    det = ((at("j", "lat") - at("k", "lat")) * (at("i", "lon") - at("k", "lon"))
           + (at("k", "lon") - at("j", "lon")) * (at("i", "lat") - at("k", "lat")))
    wi = ((at("j", "lat") - at("k", "lat")) * (lon - at("k", "lon")) + (at("k", "lon") - at("j", "lon")) * (lat - at("k", "lat"))) / det
    wj = ((at("k", "lat") - at("i", "lat")) * (lon - at("k", "lon")) + (at("i", "lon") - at("k", "lon")) * (lat - at("k", "lat"))) / det
    return {"wi": wi, "wj": wj, "wk": 1 - wi - wj}


def located(points: DataFrame, faces: DataFrame, values, point_id: str = "cell_id", keys=()) -> DataFrame:
    """(point_id, values) of the points inside the mesh: linear in the triangle that holds the point, of several the first.

    faces has the corners p_i, p_j, p_k (lat, lon and the values).  A triangle lies in the buckets of its size that its box meets (at
    most nine); a point looks into one bucket of every size that occurs.
    """
    def ends(c):
        corners = [F.col(f"p_{x}.{c}") for x in "ijk"]
        return F.least(*corners), F.greatest(*corners)

    (south, north), (west, east) = ends("lat"), ends("lon")
    slack = 1e-6 * (F.greatest(north - south, east - west) + 1)
    level = F.ceil(F.log2(F.greatest(north - south, east - west, F.lit(pyramid.FINEST))) / 2).cast("int")
    boxed = faces.withColumn("level", level).withColumn("size", F.pow(F.lit(4.0), F.col("level")))
    levels = [r["level"] for r in boxed.select("level").distinct().collect()]  # a few: one per power of four of a degree
    if not levels:
        return points.select(point_id, *[F.lit(None).cast("double").alias(v) for v in values]).limit(0)
    for name, low, high in (("by", south, north), ("bx", west, east)):
        boxed = boxed.withColumn(name, F.explode(F.sequence(F.floor((low - slack) / F.col("size")), F.floor((high + slack) / F.col("size")))))
    lat, lon = F.col("latitude"), F.col("longitude")
    probes = points.select(*keys, point_id, "latitude", "longitude").withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    probes = probes.withColumns({"by": F.floor(lat / F.pow(F.lit(4.0), F.col("level"))), "bx": F.floor(lon / F.pow(F.lit(4.0), F.col("level")))})
    inside = F.least("wi", "wj", "wk") >= -1e-9
    met = probes.join(boxed.drop("size"), [*keys, "level", "by", "bx"]).withColumns(barycentric(lat, lon)).where(inside)
    linear = [sum((F.col(f"w{x}") * F.col(f"p_{x}.{v}") for x in "jk"), F.col("wi") * F.col(f"p_i.{v}")).alias(v) for v in values]
    return met.groupBy(point_id).agg(F.min(F.struct("i", "j", "k", *linear)).alias("_first")).select(point_id, *[F.col(f"_first.{v}").alias(v) for v in values])

"""Properties: bounded pieces and other ways give the same rows; greedy and routing against brute force."""

import heapq
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline import params as P
from ridgeline.catalog import rasters, routes, routing as routing_queries, winds, zones as zone_queries
from ridgeline.fixtures import shape
from ridgeline.operators import decisions, evaluation, mesh, paths, raster, routing, sampling, spatial, stations
from ridgeline.plans import zones


def rows(df, *columns, digits=6):
    def cell(v):
        return round(v, digits) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(cell(v) for v in r) for r in df.select(*columns).collect()), key=str)


def test_small_tiles_equal_one_tile(spark, sf):
    cells = shape(spark, sf, "terrain_cells")
    cols = ("cell_id", "slope", "aspect", "curvature", "is_ridge")
    small = raster.terrain_layer(cells, F.lit(96.0), F.lit(100.0), tile=7)
    assert rows(small, *cols) == rows(raster.terrain_layer(cells, F.lit(96.0), F.lit(100.0)), *cols)
    a = raster.neighbourhood(cells, "elevation", 3, "max", "m", tile=5)
    assert rows(a, "cell_id", "m") == rows(raster.neighbourhood(cells, "elevation", 3, "max", "m"), "cell_id", "m")


def test_small_chunks_equal_whole_paths(spark, sf):
    p = routes.points(spark, sf)
    assert rows(paths.cumulative_distance(p, 3), "path_id", "seq", "dist_m") == \
        rows(paths.cumulative_distance(p), "path_id", "seq", "dist_m")
    assert rows(paths.smoothed(p, 3), "path_id", "seq") == rows(paths.smoothed(p), "path_id", "seq")
    assert rows(paths.walk_times(p, 2), "path_id", "walk_min") == rows(paths.walk_times(p), "path_id", "walk_min")


def test_salted_radius_join(spark, sf):
    i, c = shape(spark, sf, "incidents").drop("grid_id"), shape(spark, sf, "terrain_cells")
    assert rows(spatial.radius_join(i, c, salts=5), "incident_id", "cell_id") == \
        rows(spatial.radius_join(i, c), "incident_id", "cell_id")


def test_strict_circle_is_wider_than_the_clipped_disc(spark, sf):
    i, c = shape(spark, sf, "incidents").drop("grid_id"), shape(spark, sf, "terrain_cells")
    strict = set(rows(spatial.radius_join(i, c, clipped=False), "incident_id", "cell_id"))
    clipped = set(rows(spatial.radius_join(i, c), "incident_id", "cell_id"))
    assert clipped < strict


def test_nearest_reaches_far_points_and_prefers_low_ids(spark):
    cells = spark.createDataFrame([(1, 10.0, 10.0), (2, 10.0, 10.0), (3, 40.0, 40.0)],
                                  "cell_id long, latitude double, longitude double")
    points = spark.createDataFrame([(7, 10.0001, 10.0), (8, -60.0, -120.0)],
                                   "p long, latitude double, longitude double")
    for metric in ("euclid", "haversine"):
        got = {r["p"]: r["near_id"] for r in spatial.nearest_join(points, cells, "p", metric).collect()}
        assert got == {7: 1, 8: 1}


def test_greedy_picks_are_apart_and_start_with_the_best(spark, sf):
    ranked = zones.ranked_zones(shape(spark, sf, "incidents"), zone_queries.calm_scored(spark, sf), min_sep_deg=0.0025)
    got = ranked.select("incident_id", "tactic", "rank", "latitude", "longitude", "cell_id").collect()
    groups = {}
    for r in got:
        groups.setdefault((r["incident_id"], r["tactic"]), []).append(r)
    for picks in groups.values():
        for a, b in itertools.combinations(picks, 2):
            assert math.hypot(a["latitude"] - b["latitude"], a["longitude"] - b["longitude"]) >= 0.0025
    best = {(r[0], r[1]): r[2] for r in zones.best_per_tactic(
        shape(spark, sf, "incidents"), zone_queries.calm_scored(spark, sf)).select("incident_id", "tactic", "cell_id").collect()}
    assert best == {k: next(p["cell_id"] for p in v if p["rank"] == 1) for k, v in groups.items()}


def test_result_does_not_depend_on_partitioning(spark, sf):
    cells = zone_queries.calm_scored(spark, sf)
    i = shape(spark, sf, "incidents")
    cols = ("incident_id", "tactic", "rank", "cell_id")
    assert rows(zones.ranked_zones(i.repartition(7), cells.repartition(13, "row")), *cols) == \
        rows(zones.ranked_zones(i, cells), *cols)
    a = sampling.by_stratum(cells, F.lit(True), 0.3, "cell_id")
    b = sampling.by_stratum(cells.repartition(11), F.lit(True), 0.3, "cell_id")
    assert rows(a, "cell_id") == rows(b, "cell_id")


def test_blocks_of_stations_do_not_change_results(spark, sf, monkeypatch):
    cells, net = shape(spark, sf, "terrain_cells"), winds.live_network(spark, sf)
    cols = ("cell_id", "wind_speed", "wind_direction")
    whole = rows(stations.idw_wind(cells, net), *cols)
    monkeypatch.setattr(stations, "BLOCK", 4)
    monkeypatch.setattr(stations, "CELLS", 200)
    assert rows(stations.idw_wind(cells, net), *cols) == whole


NET = "station_id int, lat double, lon double, elev double, ws double, wd double"


def small_network(spark, positions):
    net = spark.createDataFrame([(k, y, x, 100.0, 4.0 + k, 90.0) for k, (y, x) in enumerate(positions)], NET)
    return stations.network(net.drop("ws", "wd"), net)


@pytest.mark.parametrize("positions", [[], [(38.0, 128.0)], [(38.0, 128.0), (38.1, 128.1)], [(38.0, 128.0), (38.1, 128.1), (38.2, 128.2)],
                                       [(38.0, 128.0)] * 4])
def test_a_network_without_triangle_gives_the_constant_wind(spark, positions):
    at = spark.createDataFrame([(1, 38.05, 128.05, 100.0)], "cell_id long, latitude double, longitude double, elevation double")
    got = stations.linear_wind(at, small_network(spark, positions)).first()
    assert (got["wind_speed"], got["wind_direction"]) == (6.5, 270.0)


def test_cells_without_coordinates_have_no_nearest_station(spark):
    at = spark.createDataFrame([(1, None, 128.0), (2, 38.0, 128.0)], "cell_id long, latitude double, longitude double")
    got = {r["cell_id"]: r["near_station"] for r in stations.nearest_wind(at, small_network(spark, [(38.0, 128.1), (39.0, 128.0)])).collect()}
    assert got == {1: None, 2: 0}


def test_synthetic_stations_stand_in_for_an_empty_network(spark):
    none = small_network(spark, [])
    assert [r["station_id"] for r in stations.synthetic_pair(none, 38.1, 128.4).orderBy("station_id").collect()] == [-2, -1]


def hull_area(points):
    """Area of the convex hull."""
    points = sorted(set(map(tuple, points)))

    def half(side):
        out = []
        for p in side:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    ring = half(points) + half(points[::-1])
    return sum(x * v - y * u for (x, y), (u, v) in zip(ring, ring[1:] + ring[:1])) / 2


def clustered(rng, n):
    return np.concatenate([rng.random((n, 2)) * 1e-3 + 5, rng.random((n // 4, 2)) * 10, rng.random((n // 4, 2)) * (10, 0.01)])


@pytest.mark.parametrize("name", ["even", "clustered", "grid", "hundred thousand"])
def test_a_large_network_is_meshed(spark, monkeypatch, name):
    """The triangles cover the hull without overlap, every inner edge has two, and no circle of a sample holds another station."""
    rng = np.random.default_rng(3)
    spots = {"even": lambda: rng.random((2500, 2)), "clustered": lambda: clustered(rng, 800), "hundred thousand": lambda: rng.random((100_000, 2)),
             "grid": lambda: np.stack(np.meshgrid(np.arange(40) * 0.01, np.arange(50) * 0.02), -1).reshape(-1, 2)}[name]()
    if name != "hundred thousand":
        monkeypatch.setattr(mesh, "TILE", 60)
    net = spark.createDataFrame([(k, float(y), float(x)) for k, (x, y) in enumerate(spots)], "station_id int, lat double, lon double")
    faces = np.array([tuple(r) for r in stations.triangles(net).collect()])
    edges = np.sort(np.concatenate([faces[:, [0, 1]], faces[:, [1, 2]], faces[:, [0, 2]]]), axis=1)
    shared = np.unique(edges, axis=0, return_counts=True)[1]
    rim = int((shared == 1).sum())
    assert shared.max() == 2 and len(faces) == 2 * len(spots) - 2 - rim and (faces[:, :1] < faces[:, 1:]).all()
    a, b, c = (spots[faces[:, k]] for k in range(3))
    twice = (b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])
    assert (twice > 0).all() and twice.sum() / 2 == pytest.approx(hull_area(spots), rel=1e-9)
    for k in rng.integers(0, len(faces), 60):
        x, y = (spots - a[k]).T
        (ux, uy), (vx, vy) = b[k] - a[k], c[k] - a[k]
        m, n = ux * ux + uy * uy, vx * vx + vy * vy
        px, py = (vy * m - uy * n) / twice[k], (ux * n - vx * m) / twice[k]
        assert (x * x + y * y - px * x - py * y >= -1e-9).all()


def test_cells_find_their_triangle(spark):
    """Linear values over a large clustered network against the plane that the stations lie on, and outside the nearest station."""
    rng = np.random.default_rng(8)
    at = clustered(rng, 400)
    net = spark.createDataFrame([(k, float(y), float(x), 0.0, float(2 * x + 3 * y), 90.0) for k, (x, y) in enumerate(at)], NET)
    net = stations.network(net.drop("ws", "wd"), net)
    asked = np.concatenate([rng.random((300, 2)) * 12 - 1, rng.random((300, 2)) * 1e-3 + 5])
    cells = spark.createDataFrame([(k, float(y), float(x), 10.0) for k, (x, y) in enumerate(asked)], "cell_id long, latitude double, longitude double, elevation double")
    got = {r.cell_id: r.wind_speed for r in stations.linear_wind(cells, net, altitude=False).collect()}
    near = [float(2 * x + 3 * y) for x, y in (at[np.argmin(((at - p) ** 2).sum(axis=1))] for p in asked)]
    plane = (2 * asked[:, 0] + 3 * asked[:, 1]).tolist()
    inside = [abs(got[k] - plane[k]) < 1e-6 for k in range(len(asked))]
    assert 400 < sum(inside) < len(asked) and all(i or got[k] == pytest.approx(near[k]) for k, i in enumerate(inside))


@pytest.mark.parametrize("metric", ["euclid", "square", "haversine"])
def test_nearest_of_far_and_crowded_points(spark, metric):
    rng = np.random.default_rng(11)
    spots = np.concatenate([rng.random((3000, 2)) * 1e-4 + (38, 128), rng.random((300, 2)) * (160, 350) - (80, 175)])
    asked = np.concatenate([rng.random((200, 2)) * 2e-4 + (38, 128), rng.random((200, 2)) * (178, 358) - (89, 179), spots[:50]])
    frame = [spark.createDataFrame([(k, k % 2, float(y), float(x)) for k, (y, x) in enumerate(p)], f"{name} long, side int, latitude double, longitude double")
             for name, p in (("cell_id", spots), ("p", asked))]
    got = {r.p: (r.near_id, r.near_m) for r in spatial.nearest_join(frame[1], frame[0], "p", metric, ["side"]).collect()}
    lat, lon = np.radians(spots).T
    for k, (y, x) in enumerate(asked):
        if metric == "haversine":
            chord = np.sin((lat - np.radians(y)) / 2) ** 2 + np.cos(lat) * np.cos(np.radians(y)) * np.sin((lon - np.radians(x)) / 2) ** 2
            far = 2 * P.EARTH_RADIUS_M * np.arctan2(np.sqrt(chord), np.sqrt(1 - chord))
        else:
            far = ((spots - (y, x)) ** 2).sum(axis=1) ** (1 if metric == "square" else 0.5)
        far[1 - k % 2::2] = np.inf
        assert got[k][1] == pytest.approx(far.min(), rel=1e-7, abs=1e-6 if metric == "haversine" else 1e-12)
        assert far[got[k][0]] == pytest.approx(far.min(), rel=1e-7, abs=1e-6 if metric == "haversine" else 1e-12)


def test_idw_at_a_station_takes_its_value(spark):
    net = spark.createDataFrame([(1, 38.0, 128.0, 100.0, 4.0, 90.0), (2, 38.1, 128.1, 300.0, 9.0, 180.0)],
                                "station_id int, lat double, lon double, elev double, ws double, wd double")
    net = stations.network(net.drop("ws", "wd"), net)
    at = spark.createDataFrame([(1, 38.0, 128.0, 100.0)], "cell_id long, latitude double, longitude double, elevation double")
    assert stations.idw_wind(at, net).first()["wind_speed"] == pytest.approx(4.0)


def test_lock_carries_across_slices(spark):
    data = [(1, 0, 11.0), (2, 3600, 12.5), (3, 7200, 13.5), (4, 90000, 12.5), (5, 180000, 12.0), (6, 270000, 12.9)]
    df = spark.createDataFrame([(1, e, t, w) for e, t, w in data], "path_id long, event_id long, t long, wind_max double") \
        .withColumn("ts", F.timestamp_seconds("t"))
    for seconds in (3600, 86_400, 10 ** 9):
        got = decisions.wind_lock(df, slice_seconds=seconds).orderBy("event_id").collect()
        assert [r["wind_locked"] for r in got] == [True, True, False, False, True, True]


def test_running_sums_with_few_and_many_buckets(spark):
    df = spark.createDataFrame([(float(i % 50), i % 3 == 0) for i in range(1000)], "v double, hit boolean")
    counts = df.groupBy("v").agg(F.count("*").alias("c"))
    from ridgeline.operators.prefix import running
    assert rows(running(counts, "v", ("c",), per_bucket=10), "v", "cum_c") == rows(running(counts, "v", ("c",)), "v", "cum_c")
    assert evaluation.exact_median(df, "v").first()[0] == 24.5


def brute_force(costs, start, goal, box, goal_cost):
    """Plain shortest path on a dictionary of edge costs."""
    best, heap = {start: 0.0}, [(0.0, start)]
    while heap:
        g, cell = heapq.heappop(heap)
        if g > best[cell]:
            continue
        if cell == goal:
            return g
        for to, cost in costs.get(cell, []):
            if not (box[0] <= to[0] <= box[1] and box[2] <= to[1] <= box[3]):
                continue
            if cost is None:
                if to != goal or goal_cost is None:
                    continue
                cost = goal_cost
            if g + cost < best.get(to, math.inf):
                best[to] = g + cost
                heapq.heappush(heap, (g + cost, to))
    return None


def test_least_cost_equals_brute_force(spark, sf):
    edges = routing.walk_edges(routes.windy_layer(spark, sf).where("col < 30"))
    table = {}
    for r in edges.collect():
        table[(r["row"], r["col"])] = [((e["row"], e["col"]), e["cost_heavy"]) for e in r["edges"]]
    asked = [(1, 0, 2, 3, 6, 9), (2, 0, 10, 5, 4, 20), (3, 0, 7, 7, 7, 7), (4, 0, 12, 25, 3, 2)]
    requests = spark.createDataFrame(asked, "request_id long, grid_id int, r0 int, c0 int, r1 int, c1 int") \
        .withColumn("size", F.lit("heavy"))
    got = {r["request_id"]: r for r in routing.least_cost(
        requests, edges, margin=6, unit_bound=routing_queries.WALK_BOUND).collect()}
    for q, _, r0, c0, r1, c1 in asked:
        box = (min(r0, r1) - 6, max(r0, r1) + 6, min(c0, c1) - 6, max(c0, c1) + 6)
        want = brute_force(table, (r0, c0), (r1, c1), box, P.CLIFF_GOAL_COST)
        assert (got[q]["cost"] is None) == (want is None)
        if want is not None:
            assert got[q]["cost"] == pytest.approx(want)
            path = [(c["row"], c["col"]) for c in got[q]["path"]]
            assert path[0] == (r0, c0) and path[-1] == (r1, c1)


def test_neighbours_follow_holes_and_borders(spark):
    grid = spark.createDataFrame([(0, r, c, float(r * 3 + c)) for r in range(3) for c in range(3) if (r, c) != (0, 1)],
                                 "grid_id int, row int, col int, v double")
    near = {(r["row"], r["col"]): sorted((n["row"], n["col"]) for n in r["around"])
            for r in routing.neighbours(grid, ["v"], tile=2).collect()}
    assert near[(0, 0)] == [(1, 0), (1, 1)]
    assert near[(2, 2)] == [(1, 1), (1, 2), (2, 1)]
    assert len(near[(1, 2)]) >= 4


def test_scatter_grid_is_full(spark, sf):
    g = raster.scatter_to_grid(shape(spark, sf, "terrain_cells"), 40)
    assert g.count() == 1600 and g.where("elevation is null or density_ratio is null").isEmpty()


def test_scatter_grid_is_linear_between_samples(spark):
    """A plane over each key comes back; a cell outside the triangles has the mean of those inside, density is the nearest sample's."""
    rng = np.random.default_rng(5)
    samples, n = [], 25
    for key, (a, b) in ((1, (3.0, -2.0)), (2, (-1.0, 4.0))):
        at = rng.random((300, 2)) * 0.2
        samples += [(key, 1000 * key + k, float(y), float(x), a * float(y) + b * float(x), float(k)) for k, (y, x) in enumerate(at)]
    samples += [(3, 5000, 1.0, 1.0, 7.0, 0.5), (3, 5001, 1.1, 1.1, 9.0, 0.25)]
    got = raster.scatter_to_grid(spark.createDataFrame(samples, "grid_id int, cell_id long, latitude double, longitude double, elevation double, density_ratio double"), n).collect()
    assert len(got) == 3 * n * n
    for key, (a, b) in ((1, (3.0, -2.0)), (2, (-1.0, 4.0))):
        own, at = [r for r in got if r.grid_id == key], np.array([s[2:4] for s in samples if s[0] == key])
        exact = [abs(r.elevation - a * r.latitude - b * r.longitude) < 1e-9 for r in own]
        assert 0.8 < sum(exact) / len(own) < 1  # the rim of the grid lies outside
        inside = np.mean([r.elevation for r, e in zip(own, exact) if e])
        assert all(e or r.elevation == pytest.approx(inside) for r, e in zip(own, exact))
        for r in own[::7]:
            assert r.density_ratio == float(np.argmin(((at - (r.latitude, r.longitude)) ** 2).sum(axis=1)))
    assert {(r.elevation, r.density_ratio) for r in got if r.grid_id == 3} == {(8.0, 0.5), (8.0, 0.25)}


def test_shared_tree_equals_brute_force(spark, sf):
    grid = routes.windy_layer(spark, sf).where("col < 40").withColumn("wind_speed", F.col("wind_speed") * 0.95)
    edges = routing.flight_edges(grid)
    table = {}
    for r in edges.collect():
        table[(r["row"], r["col"])] = [((e["row"], e["col"]), e["cost_heavy"]) for e in r["edges"]]
    sources = spark.createDataFrame([(0, "heavy", 10, 39)], "grid_id int, size string, row int, col int")
    old, routing.ROUTE_TILE = routing.ROUTE_TILE, 9
    try:
        tree = routing.source_tree(sources, edges)
        got = {(r["row"], r["col"]): r["g"] for r in tree.collect()}
    finally:
        routing.ROUTE_TILE = old
    box = (0, 14, 0, 39)
    for goal in [(0, 0), (3, 17), (14, 39), (9, 5), (10, 39)]:
        want = brute_force(table, (10, 39), goal, box, None)
        assert (got.get(goal) is None) == (want is None)
        if want is not None:
            assert got[goal] == pytest.approx(want)
    goals = spark.createDataFrame([(1, 0, "heavy", 3, 17)], "path_id long, grid_id int, size string, row int, col int")
    walked = routing.tree_paths(goals, tree).orderBy("seq").collect()
    assert [r["seq"] for r in walked] == list(range(len(walked)))
    assert (walked[0]["row"], walked[0]["col"]) == (10, 39) and (walked[-1]["row"], walked[-1]["col"]) == (3, 17)
    for a, b in zip(walked, walked[1:]):
        assert max(abs(a["row"] - b["row"]), abs(a["col"] - b["col"])) == 1


def test_ladder_ends_in_the_straight_line(spark, sf):
    """With a storm everywhere no level helps; a strong wind needs the relaxed limit."""
    from ridgeline.catalog.rasters import grids
    from ridgeline.plans import mission
    grid, g = routes.windy_layer(spark, sf), grids(spark, sf)
    base = mission.base_cells(g)
    start = base.first()
    asked = spark.createDataFrame([(1, 0, start["row"], start["col"], 5, 80, "light")],
                                  "path_id long, grid_id int, r0 int, c0 int, r1 int, c1 int, size string")
    for speed, level in ((17.0, 2), (30.0, 4)):
        flown = mission.flight_ladder(asked, base, grid.withColumn("wind_speed", F.lit(speed)))
        assert {r["level"] for r in flown.select("level").collect()} == {level}


@pytest.mark.parametrize("positions, area", [
    ([(0, 0), (2, 0), (0, 1), (2, 1)], 2.0),
    ([(127 + 0.1 * ((7 * k) % 20 % 5), 37 + 0.1 * ((7 * k) % 20 // 5)) for k in range(20)], 0.12),
    ([(0, 0), (3, 4), (-3, 4), (5, 0), (0, 5), (-4, 3), (4, 3), (0, -5)], None)])
def test_stations_on_one_circle_cover_their_hull(spark, positions, area):
    net = spark.createDataFrame([(k + 1, float(y), float(x)) for k, (x, y) in enumerate(positions)], "station_id int, lat double, lon double")
    total = 0.0
    for r in stations.triangles(net).collect():
        (ax, ay), (bx, by), (cx, cy) = (positions[n - 1] for n in (r.i, r.j, r.k))
        turn = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
        assert turn > 0 and r.i < min(r.j, r.k)
        total += turn / 2
    if area is None:
        hull = [(0, -5), (5, 0), (4, 3), (3, 4), (0, 5), (-3, 4), (-4, 3)]
        area = sum(x * v - y * u for (x, y), (u, v) in zip(hull, hull[1:] + hull[:1])) / 2
    assert total == pytest.approx(area)

"""Steps that must not send a growing table to every task or walk through all its pairs, on small rows of their own."""

import numpy as np
from pyspark.sql import functions as F

from ridgeline.operators import mesh, paths, pyramid, ranking, routing, spatial
from ridgeline.plans import training


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def lattice(spark, n):
    return spark.range(n * n).selectExpr("id AS cell_id", "38.0 + (id % {0}) * 9e-4 AS latitude".format(n),
                                         "128.0 + floor(id / {0}) * 1.1e-3 AS longitude".format(n), "id * 1.0 AS elevation")


def test_radius_join_makes_all_pairs_of_a_point_in_one_place(spark):
    points = spark.range(40).selectExpr("id AS incident_id", "38.0 + (id % 8) * 1.7e-3 AS latitude", "128.0 + id * 4.3e-4 AS longitude")
    cells = lattice(spark, 20)
    for metric in spatial.METRICS:
        near = spatial.radius_join(points, cells, metric=metric, clipped=False)
        assert "Broadcast" not in plan(near)
        buckets = near.withColumn("task", F.spark_partition_id()).groupBy("incident_id").agg(F.count_distinct("task").alias("n"))
        assert buckets.agg(F.max("n")).first()[0] == 1
        away = spatial.METRICS[metric](F.col("latitude"), F.col("longitude"), F.col("c_lat"), F.col("c_lon"))
        brute = points.crossJoin(cells.selectExpr("cell_id", "latitude AS c_lat", "longitude AS c_lon")).where(away <= 500.0)
        assert rows(near, "incident_id", "cell_id") == rows(brute, "incident_id", "cell_id")


def test_spread_picks_are_made_without_rounds(spark, monkeypatch):
    at = [(1, 0, 0.0), (1, 1, 0.0001), (1, 2, 0.001), (1, 3, 0.002), (2, 4, 0.0), (2, 5, 0.0), (None, 6, 0.0), (None, 7, 0.5)]
    df = spark.createDataFrame(at, "incident_id long, cell_id long, latitude double").withColumns(
        {"longitude": F.lit(0.0), "tactic": F.lit("landing")})
    monkeypatch.setattr(ranking, "_greedy", lambda *a: 1 / 0)
    picks = ranking.spread_top(df, [F.col("cell_id").asc()], n=3)
    assert rows(picks.na.fill(-1), "incident_id", "rank", "cell_id") == [(-1, 1, 6), (1, 1, 0), (1, 2, 2), (1, 3, 3), (2, 1, 4)]


def test_boxes_meet_occupied_buckets_only_and_broadcast_nothing(spark):
    cells = lattice(spark, 60).withColumns({"latitude": F.expr("latitude * 7 - 228.0"), "longitude": F.expr("longitude * 7 - 768.0")})
    points = spark.range(30).selectExpr("id AS incident_id", "38.0 + id * 1.3e-2 AS latitude", "128.0 + (id % 5) * 9e-2 AS longitude")
    got = spatial.box_degrees(points.union(points.limit(1)), cells)
    assert "Broadcast" not in plan(got)
    pairs = points.union(points.limit(1)).crossJoin(cells.selectExpr("latitude AS a", "longitude AS o", "elevation")).where(
        "a BETWEEN latitude - 0.15 AND latitude + 0.15 AND o BETWEEN longitude - 0.15 AND longitude + 0.15")
    brute = pairs.groupBy("incident_id").agg(F.count("*").alias("n_cells"), F.sum("elevation").alias("sum_elev")).where("n_cells >= 10")
    assert rows(got, "incident_id", "n_cells", "sum_elev") == rows(brute, "incident_id", "n_cells", "sum_elev")


def test_waypoints_send_no_cells_to_all_tasks(spark):
    grid = spark.range(400).selectExpr("0 AS grid_id", "CAST(floor(id / 20) AS INT) AS row", "CAST(id % 20 AS INT) AS col",
                                       "CAST(id % 60 AS DOUBLE) AS slope", "id % 7 = 0 AS is_ridge")
    pairs = spark.range(3).selectExpr("id AS path_id", "0 AS grid_id", "1 AS r0", "2 AS c0", "17 AS r1", "CAST(id + 9 AS INT) AS c1")
    assert "Broadcast" not in plan(paths.refined_waypoints(pairs, grid))


def test_hardest_start_makes_no_row_per_cell_of_a_line(spark):
    grid = spark.range(90 * 80).where("id % 97 <> 5").selectExpr(
        "0 AS grid_id", "CAST(floor(id / 80) AS INT) AS row", "CAST(id % 80 AS INT) AS col",
        "CASE WHEN id % 11 <> 3 THEN CAST((id * 7919) % 61 AS DOUBLE) END AS slope")
    grid = grid.union(grid.where("row = 40 AND col < 50"))  # cells that come twice count twice
    grids = spark.createDataFrame([(0, 90, 80)], "grid_id int, n_rows int, n_cols int")
    spots = spark.createDataFrame([(0, 40, 39), (0, 40, 39), (0, 0, 0), (0, 63, 64), (0, 89, 79), (1, 5, 5), (None, 3, 3)], "grid_id int, row int, col int")
    got = paths.hardest_start(spots, grid, grids)
    assert "FlatMapCoGroupsInPandas" in plan(got)
    starts = (spots.distinct().selectExpr("grid_id", "row AS r1", "col AS c1").join(grids, "grid_id")
              .withColumn("dr", F.explode(F.expr("sequence(-35, 35, 5)"))).withColumn("dc", F.explode(F.expr("sequence(-35, 35, 5)")))
              .where("NOT (abs(dr) < 15 AND abs(dc) < 15) AND r1 + dr BETWEEN 0 AND n_rows - 1 AND c1 + dc BETWEEN 0 AND n_cols - 1")
              .selectExpr("*", "r1 + dr AS r0", "c1 + dc AS c0"))
    mean = (paths.straight_cells(starts, "round").join(grid, ["grid_id", "row", "col"])
            .groupBy("r1", "c1", "r0", "c0").agg(F.round(F.avg("slope"), 9).alias("severity")))
    best = mean.groupBy("r1", "c1").agg(F.max(F.struct("severity", (-F.col("r0")).alias("r"), (-F.col("c0")).alias("c"))).alias("b"))
    assert rows(got, "row", "col", "start_row", "start_col", "severity") == rows(
        best.selectExpr("r1", "c1", "-b.r AS r0", "-b.c AS c0", "b.severity"), "r1", "c1", "r0", "c0", "severity")


def test_sides_beyond_the_cells_of_a_grid_have_no_rim(spark):
    """Boxes of a grid of 21 x 35 cells, without some of them, that reach over its sides, lie in it or beside it."""
    from ridgeline.operators import area
    grid = (spark.range(21 * 35).selectExpr("1 AS grid_id", "CAST(id DIV 35 + 3 AS INT) AS row", "CAST(id % 35 - 2 AS INT) AS col",
                                            "CASE WHEN id % 13 <> 5 THEN (id * 37 % 101) * 7e-1 END AS slope"))
    asked = spark.createDataFrame([(1, 1, 12, 9, 12, 20), (2, 1, 3, -2, 23, 32), (3, 1, 4, 30, 5, 31), (4, 1, 60, 9, 61, 12), (5, 2, 4, 4, 5, 5), (6, 1, 3, 9, 4, 10)],
                                  "incident_id int, grid_id int, r0 int, c0 int, r1 int, c1 int")
    for margin in (0, 3, 20):
        boxes = asked.join(grid.where("slope is not null"), "grid_id").where(
            f"row BETWEEN least(r0, r1) - {margin} AND greatest(r0, r1) + {margin} AND col BETWEEN least(c0, c1) - {margin} AND greatest(c0, c1) + {margin}")
        want = boxes.groupBy("incident_id").agg(F.count("*").alias("n_cells"), F.min("slope").alias("slope_min"), F.max("slope").alias("slope_max"),
                                                F.round(F.avg("slope"), 9).alias("m"), F.round(F.median("slope"), 9).alias("median"))
        got = area.box_slopes(asked, grid, margin).selectExpr("incident_id", "n_cells", "slope_min", "slope_max", "round(slope_mean, 9) AS m", "round(slope_median, 9) AS median")
        names = ("incident_id", "n_cells", "slope_min", "slope_max", "m", "median")
        assert rows(got, *names) == rows(want, *names)
    cells = grid.selectExpr("grid_id", "CAST(row AS long) AS _r", "CAST(col AS long) AS _c")
    over = spark.createDataFrame([(1, 1, -9, 70, -9, 70)], "incident_id int, grid_id int, _r0 long, _r1 long, _c0 long, _c1 long")
    box = area._to_borders(over, cells, ("grid_id",))
    assert rows(box, "_r0", "_r1", "_c0", "_c1") == [(0, 31, -16, 47)]
    assert area._blocks_of(box, 1, 4, 4).count() == area._blocks_of(box, 4, 16, 4).count() == 0


def test_short_files_are_learned_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(training, "ROWS_PER_TASK", 100)
    one = spark.range(1000).coalesce(1)
    wide = training.spread(one)
    assert wide.rdd.getNumPartitions() == 10 and rows(wide, "id") == rows(one, "id")
    assert training.spread(spark.range(150).coalesce(1)).rdd.getNumPartitions() == 1


def test_large_fits_follow_one_another_and_rows_stay_out_of_memory(spark, monkeypatch):
    """Each fit holds its own copy of the rows, so four at once need four times the memory and disk."""
    import threading
    import time
    lock, now, most = threading.Lock(), [0], [0]

    def fit(rows, mode, **how):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.2)
        with lock:
            now[0] -= 1
        return mode

    monkeypatch.setattr(training, "fit", fit)
    modes = ("large_landing", "large_hoist")
    table = spark.range(100).select("id", *[F.lit(0.0).alias(c) for c in training.P.FEATURES], *[F.lit(0).alias(f"target_{m}") for m in modes],
                                    F.lit(False).alias("is_test"), F.lit(True).alias("is_train_final"))
    cores = spark.sparkContext.defaultParallelism
    assert training.fit_all(table.repartition(4 * cores), modes) == {m: m for m in modes} and most == [1]
    training.fit_all(table.coalesce(1), modes)
    assert most == [2]
    kept = training.spread(training.learning_rows(table, modes))
    assert "id" not in kept.columns and not kept.storageLevel.useMemory and kept.storageLevel.useDisk
    kept.unpersist()


def test_a_query_of_one_mode_fits_that_mode(spark, monkeypatch):
    from ridgeline.catalog import models
    asked = []
    monkeypatch.setattr(models.ml, "fit_all", lambda rows, modes=(): asked.append([*modes]) or {})
    monkeypatch.setattr(models.ml, "save", lambda fits, folder: None)
    rows, calls = spark.range(1), []

    def load(folder, modes):
        calls.append(modes)
        if len(calls) == 1:
            raise models.AnalysisException("none")
        return dict.fromkeys(modes)

    monkeypatch.setattr(models.ml, "load", load)
    assert models.fitted(spark, "/none", ["large_landing"], rows) == {"large_landing": None} and asked == [["large_landing"]]


def test_fits_run_side_by_side(spark):
    import threading
    met = threading.Barrier(3)
    assert training.together([lambda k=k: (met.wait(20), k)[1] for k in range(3)]) == [0, 1, 2]


def test_searches_with_bounded_boxes_make_no_rounds_of_joins(spark, monkeypatch):
    """Walks in arrays by tile and through the table of states: same costs, paths and counts; the first without a round."""
    grid = spark.range(900).selectExpr(
        "0 AS grid_id", "CAST(floor(id / 30) AS INT) AS row", "CAST(id % 30 AS INT) AS col",
        "CASE WHEN id % 7 = 3 OR floor(id / 30) = 20 THEN 60.0 ELSE CAST(id * 31 % 40 AS DOUBLE) END AS slope",
        "CAST(id * 17 % 10 AS DOUBLE) / 10 AS density", "CAST(id * 13 % 20 AS DOUBLE) AS canopy").where("(row + 2 * col) % 23 != 5")
    edges = routing.walk_edges(grid)
    asked = spark.range(40).selectExpr(
        "id AS request_id", "0 AS grid_id", "CAST(id * 7 % 30 AS INT) AS r0", "CAST(id * 11 % 30 AS INT) AS c0",
        "CAST(id * 7 % 30 + id % 5 - 2 AS INT) AS r1", "CAST(id * 11 % 30 + id % 6 - 3 AS INT) AS c1",
        "CASE id % 4 WHEN 0 THEN 'light' WHEN 1 THEN 'heavy' WHEN 2 THEN 'other' END AS size")
    columns = ("request_id", "explored", "blocked", "cost", "path")

    def searched(asked, *how):
        return sorted(map(str, routing.least_cost(asked, edges, *how).select(*columns).collect()))

    for how in ((3, 500.0, 20.0), (2, None, 0.0)):
        with monkeypatch.context() as m:
            m.setattr(routing, "_searched_in_rounds", lambda *a: 1 / 0)
            m.setattr(routing, "SEARCH_TILE", 8)
            m.setattr(routing, "SEARCH_REACH", 16)
            m.setattr(routing, "SEARCH_STATES", 500)
            by_tile = searched(asked, *how)
        with monkeypatch.context() as m:
            m.setattr(routing, "_searched_by_tile", lambda asked, *a: spark.createDataFrame(
                [], "request_id long, explored long, blocked long, cost double, path array<struct<row:int,col:int>>"))
            m.setattr(routing, "SEARCH_REACH", -1)
            in_rounds = searched(asked, *how)
        assert by_tile == in_rounds and len(by_tile) == 40
    odd = asked.limit(3).unionByName(asked.limit(2)).unionByName(asked.limit(1).withColumn("request_id", F.lit(None).cast("long")))
    assert len(searched(odd, 3, 500.0, 20.0)) == 4  # a request given twice counts once; one without id keeps its row


def test_a_tile_at_rest_is_not_relaxed_again(spark, monkeypatch):
    """A tree within one tile takes one round; over several tiles it has the costs of the one-tile search."""
    grid = spark.range(400).selectExpr(
        "0 AS grid_id", "CAST(floor(id / 20) AS INT) AS row", "CAST(id % 20 AS INT) AS col", "'other' AS size")
    around = "filter(flatten(transform(array(-1, 0, 1), r -> transform(array(-1, 0, 1), c -> struct(row + r AS row, col + c AS col)))), " \
             "e -> e.row BETWEEN 0 AND 19 AND e.col BETWEEN 0 AND 19 AND (e.row != row OR e.col != col))"
    cost = "CAST(1 + (e.row * 7 + e.col * 13) % 11 AS DOUBLE)"
    edges = grid.selectExpr("grid_id", "row", "col", f"transform({around}, e -> struct(e.row AS row, e.col AS col, "
                            f"{cost} AS cost_light, {cost} AS cost_heavy, {cost} AS cost_other)) AS edges")
    source = grid.where("row = 3 AND col = 4")
    rounds = []
    relaxed = routing._relaxed_tile
    monkeypatch.setattr(routing, "_relaxed_tile", lambda keys: rounds.append(1) or relaxed(keys))
    whole = rows(routing.source_tree(source, edges), "row", "col", "g")
    assert len(rounds) == 1 and len(whole) == 400
    monkeypatch.setattr(routing, "ROUTE_TILE", 7)
    assert rows(routing.source_tree(source, edges), "row", "col", "g") == whole


def test_meshes_and_searches_of_far_keys_take_no_more_rounds(spark, monkeypatch):
    """rounds, levels and shuffled rows follow the extent of a key, not how far the keys lie apart."""
    monkeypatch.setattr(mesh, "TILE", 40)
    monkeypatch.setattr(mesh, "LEAF", 8)
    rounds, verified = [], mesh._verified
    monkeypatch.setattr(mesh, "_verified", lambda *a: rounds.append(1) or verified(*a))

    net = spark.range(300).selectExpr(
        "id % 3 AS grid_id", "id AS station_id", "38.0 + floor(id / 3) % 10 * 9e-4 + (id * 37 % 101) * 1e-6 AS lat",
        "128.0 + floor(id / 30) * 1.1e-3 + (id * 53 % 97) * 1e-6 + (id % 3) * 60.0 AS lon").localCheckpoint()
    single = set()
    for k in range(3):
        at = np.array([r[1:] for r in rows(net.where(f"grid_id = {k}"), "station_id", "lon", "lat")])
        single |= {tuple(int(c) * 3 + k for c in face) for face in mesh.local_triangles(at[:, 0] - at[:, 0].mean(), at[:, 1] - at[:, 1].mean())}
    got = mesh.triangles(net, ("grid_id",))
    assert {tuple(sorted(f)) for f in rows(got, "i", "j", "k")} == single
    assert len(rounds) <= 4

    spots = net.selectExpr("grid_id", "station_id AS spot", "lat AS latitude", "lon AS longitude")
    tree = pyramid.pyramid(spots, ("grid_id",), 8)
    assert tree.top <= 3 < tree.levels
    points = spots.selectExpr("grid_id", "spot AS point", "latitude + 3e-4 AS at_lat", "longitude - 4e-4 AS at_lon")
    brute = {}
    for k, spot, lat, lon in rows(spots, "grid_id", "spot", "latitude", "longitude"):
        brute.setdefault(k, []).append((lat, lon, spot))
    got = pyramid.nearest(points, tree, "point", "square").join(points, "point")
    for k, lat, lon, spot in rows(got, "grid_id", "at_lat", "at_lon", "near_id"):
        assert spot == min(brute[k], key=lambda s: ((s[0] - lat) ** 2 + (s[1] - lon) ** 2, s[2]))[2]
    assert got.count() == 300

"""Files in and out: terrain, hazards, readings, routes, incidents, models, streams."""

import tempfile

from pyspark.sql import functions as F

from ridgeline import params as P
from ridgeline.catalog import learning, routes as route_queries, scalars
from ridgeline.fixtures import shape
from ridgeline.operators import augment, paths
from ridgeline.plans import training
from ridgeline.sources import hazards, incidents, observations, routes, terrain
from ridgeline.streaming import observations as stream_obs


def folder():
    return tempfile.mkdtemp(prefix="ridgeline-test-")


def test_raw_terrain_parts(spark):
    d = folder()
    parts = []
    for i, lines in enumerate(["128.4,38.1,500,10,0.5,3\n128.5,38.2,-9999,1,1,1", "128.6,38.3,x,1,1,1\n128.7,38.1,700,-9999,none,2"]):
        parts.append(f"{d}/part{i}.csv")
        with open(parts[-1], "w") as f:
            f.write("longitude,latitude,elevation,slope_deg,tree_density,tree_height\n" + lines + "\n")
    got = sorted(tuple(r) for r in terrain.clean(terrain.read_raw(spark, parts)).select("elevation", "slope_deg", "tree_density")
                 .fillna(-1.0).collect())
    assert got == [(500.0, 10.0, 0.5), (700.0, -1.0, -1.0)]


def test_base_table_round_trip_and_pruning(spark, sf):
    base = scalars.base_cells(spark, sf).withColumn("is_test", F.col("cell_id") % 5 == 0)
    path = folder() + "/base"
    terrain.write_base(base, path, partition_by="is_test")
    back = terrain.read_base(spark, path, ["cell_id", "static_large_hoist"], split="is_test")
    assert back.count() == base.where("is_test").count()
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "cast(is_test#" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "elevation" not in plan.split("ReadSchema")[1]


def test_hazard_file_in_cp949(spark):
    d = folder()
    with open(f"{d}/h.csv", "w", encoding="cp949") as f:
        f.write("park,hazard_id,name,kind,position\n산,1,북쪽,fall,POINT(128.4 38.1)\n산,2,남쪽,fall,none\n")
    points = hazards.located(hazards.read(spark, f"{d}/h.csv"), "산", "park")
    assert [(r["name"], r["lat"], r["lon"]) for r in points.collect()] == [("북쪽", 38.1, 128.4)]
    cells = spark.createDataFrame([(1, 38.0, 128.0), (2, 38.2, 128.5)], "cell_id long, latitude double, longitude double")
    hazards.write(hazards.area_flag(points, cells), f"{d}/out")
    assert spark.read.option("header", True).csv(f"{d}/out").first()["in_area"] == "true"


def test_reading_lines(spark):
    d = folder()
    with open(f"{d}/obs.txt", "w") as f:
        f.write("# header\n\n202401010000  90 270.0 5.5 1\n202401010001 90 x 5.5\n202401010002 90 10\n202401010003 90 -99.9 -99.9\n")
    parsed = observations.parse_lines(observations.read_lines(spark, f"{d}/obs.txt"))
    assert parsed.count() == 2
    assert [(r["wd"], r["ws"]) for r in observations.valid(parsed).collect()] == [(270.0, 5.5)]


def test_incident_file_keeps_every_row(spark):
    d = folder()
    with open(f"{d}/i.csv", "w") as f:
        f.write("latitude,longitude\n38.1192,128.4652\n38.1389,128.3079\n")
    got = incidents.read(spark, f"{d}/i.csv")
    assert got.count() == 2 and got.select("incident_id").distinct().count() == 2


def test_route_json_lines(spark, sf):
    path = folder() + "/routes"
    rows = routes.export_rows(paths.penalties(route_queries.points(spark, sf)))
    routes.write_json(rows, path)
    assert spark.read.json(path).count() == rows.count()


def test_models_reload_and_agree_with_rule(spark, sf):
    rows = learning.training(spark, sf)
    models = training.fit_all(rows, ("large_landing",), trees=10)
    path = folder()
    training.save(models, path)
    scored = training.predict(rows.where("is_test"), training.load(path, ("large_landing",)))
    agree = scored.select(F.avg((F.col("class_large_landing") == F.col("target_large_landing")).cast("int"))).first()[0]
    assert agree > 0.8


def test_blocked_cells_get_two_winds(spark, sf):
    rows = augment.with_scenarios(scalars.base_cells(spark, sf)).groupBy("cell_id", augment.hard_block().alias("b")).count()
    assert {(r["b"], r["count"]) for r in rows.select("b", "count").distinct().collect()} == {
        (True, len(P.SCENARIO_WINDS_BASIC)), (False, len(P.SCENARIO_WINDS_FULL))}


def test_stream_in_many_batches_equals_batch(spark, sf):
    """Events arrive in several files; state and watermark carry over between batches."""
    from ridgeline.streaming import state
    d = folder() + "/events"
    events = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts").coalesce(1)
    for i in range(4):
        part = events.where((F.col("event_id") >= i * 250) & (F.col("event_id") < (i + 1) * 250))
        part.coalesce(1).write.parquet(f"{d}/in-{i}")
    import glob
    import os
    import shutil
    os.makedirs(f"{d}/all")
    for i in range(4):
        for f in glob.glob(f"{d}/in-{i}/part*.parquet"):
            shutil.copy(f, f"{d}/all/events-{i}.parquet")
            os.utime(f"{d}/all/events-{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))

    def make(inbox):
        rows = stream_obs.readings(spark, f"{d}/all", 1, inbox).withWatermark("ts", "1 hour")
        return state.wind_lock(rows.select(F.col("station_id").cast("bigint").alias("key"), "event_id", "ts", F.col("gust").alias("wind_max")))

    got = {(r["event_id"], r["wind_locked"]) for r in stream_obs.drain_closed(spark, make).collect()}
    from ridgeline.catalog.decisions import wind_lock
    want = {(r["event_id"], r["wind_locked"]) for r in wind_lock(spark, sf).collect()}
    assert got == want


def test_a_stream_without_rows_gives_an_empty_table(spark, sf):
    d = folder() + "/none"
    spark.read.parquet(f"{sf}/events.parquet").limit(0).write.parquet(d)
    rows = stream_obs.drain(stream_obs.read_events(spark, d, 1))
    assert rows.count() == 0 and "batch_id" in rows.columns


def test_shapes_cover_whole_tables(spark, sf):
    for name, source in (("terrain_cells", "orders"), ("incidents", "customer"), ("stations", "nation"),
                         ("observations", "events"), ("path_points", "lineitem")):
        assert shape(spark, sf, name).count() == spark.read.parquet(f"{sf}/{source}.parquet").count()


def test_streams_in_event_time_take_files_out_of_order(spark, sf, tmp_path):
    """The events in files whose order is not that of time, one file a batch, give what one file gives; rows behind the watermark go."""
    from ridgeline.streaming import observations, state

    events = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts").toPandas()
    parts = [events.iloc[k::3].sample(frac=1, random_state=k) for k in range(3)]
    for name, part in zip(("events_2", "events_0", "events_1"), parts):
        spark.createDataFrame(part).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    (tmp_path / "flat").mkdir()
    for k, f in enumerate(sorted(tmp_path.glob("events_*/part-*"))):
        f.rename(tmp_path / "flat" / f"events_{k}.parquet")

    def lock(folder, delay, **how):
        def make(inbox):
            rows = observations.readings(spark, folder, inbox=inbox, **how).withWatermark("ts", delay)
            return state.wind_lock(rows.selectExpr("CAST(station_id AS bigint) AS key", "event_id", "ts", "gust AS wind_max"))
        return sorted(tuple(r) for r in observations.drain_closed(spark, make).select("key", "event_id", "ts", "wind_locked").collect())

    whole = lock(sf, "20 minutes")
    assert len(whole) == len(events)
    assert lock(str(tmp_path / "flat"), "40 days", files_per_trigger=1) == whole
    late = lock(str(tmp_path / "flat"), "1 minute", files_per_trigger=1)
    assert 0 < len(late) < len(whole)

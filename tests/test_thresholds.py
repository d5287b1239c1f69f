"""Hand-computed cases at every threshold edge."""

import pytest
from pyspark.sql import functions as F

from ridgeline import params as P
from ridgeline.functions import geo, paths, risk, scores, wind


def values(spark, data, expr, schema="x double"):
    rows = spark.createDataFrame([(v,) if not isinstance(v, tuple) else v for v in data], schema)
    return [r[0] for r in rows.coalesce(1).select(expr).collect()]


def test_training_wind_edges(spark):
    assert values(spark, [4.99, 5.0, 9.99, 10.0, 14.99, 15.0], scores.train_wind_score(F.col("x"))) == \
        [1.0, 0.6, 0.6, 0.2, 0.2, 0.0]


@pytest.mark.parametrize("size,speeds,expected", [
    ("small", [4.9, 5.0, 8.0, 10.0], [1.0, 0.6, 0.2, 0.0]),
    ("large", [4.9, 5.0, 12.0, 20.0], [1.0, 0.6, 0.2, 0.0])])
def test_size_wind_edges(spark, size, speeds, expected):
    assert values(spark, speeds, scores.size_wind_score(F.col("x"), F.lit(size))) == expected


def test_angle_edges(spark):
    got = values(spark, [0.0, 44.9, 45.0, 134.9, 135.0, 224.9, 225.0, 314.9, 315.0, -359.0], scores.angle_score(F.col("x")))
    assert got == [1.0, 1.0, 0.5, 0.5, 0.0, 0.0, 0.5, 0.5, 1.0, 1.0]


def test_labels(spark):
    assert values(spark, [0.8, 0.7999, 0.55, 0.5499, None], scores.risk_label(F.col("x"))) == [0, 1, 1, 2, 2]


def test_unknown_grade_gives_no_score(spark):
    assert values(spark, [0.0, 1.0, 7.0, None], scores.coded(P.SLOPE_SCORE, F.col("x").cast("int"))) == [1.0, 0.7, None, None]


def test_step_wind_direction(spark):
    got = values(spark, [45.0, 46.0, 134.0, 135.0, 180.0, 315.0, -90.0], risk.step_wind_dir(F.col("x"), F.lit("heavy")))
    assert got == [0.0, 0.5, 0.5, 0.885, 0.885, 0.0, 0.5]


def test_clip_keeps_missing(spark):
    assert values(spark, [None, -1.0, 0.5, 3.0], risk.unit(F.col("x"))) == [None, 0.0, 0.5, 1.0]


def test_missing_part_is_medium_risk(spark):
    df = spark.createDataFrame([(None, float("nan"), 0.0, 0.0, 0.0, 200.0)],
                               "slope_deg double, density_pct double, tree_height double, wind_speed double, "
                               "wind_direction double, elevation double")
    row = risk.risk_scores(df).first()
    assert row["risk_L_Light"] == pytest.approx(0.5 * 0.42 + 0.5 * 0.10)


def test_weights_must_sum_to_one():
    with pytest.raises(ValueError):
        risk.validated_weights({"x": {"a": 0.5, "b": 0.4}})


def test_cell_blocked_only_by_slope_density_wind(spark):
    def blocked(slope, ratio, canopy, speed):
        c = risk.cell_risk(*[F.lit(float(v)) for v in (slope, ratio, canopy, speed)], F.lit(500.0),
                           F.lit("landing"), F.lit("light"))
        return spark.range(1).select(c["blocked"]).first()[0]

    assert blocked(15, 0, 0, 0) and blocked(0, 0.7, 0, 0) and blocked(0, 0, 0, 15)
    assert not blocked(14.9, 0.69, 50, 14.9)


def test_projection_known_cell_and_round_trip(spark):
    df = spark.createDataFrame([(37.5665, 126.9780)], "lat double, lon double")
    nx, ny = geo.lcc_cell(F.col("lat"), F.col("lon"))
    cell = df.select(nx.alias("nx"), ny.alias("ny"))
    assert tuple(cell.first()) == (60, 127)
    lat, lon = geo.lcc_inverse(F.col("nx"), F.col("ny"))
    back = cell.select(lat, lon).first()
    assert abs(back[0] - 37.5665) < 0.05 and abs(back[1] - 126.9780) < 0.05


def test_reason_rounds_halves_to_even(spark):
    df = spark.createDataFrame([(30.5, 8.5, True, False), (10.0, 8.0, False, False)],
                               "s double, w double, f boolean, r boolean")
    got = [r[0] for r in df.coalesce(1).select(paths.walk_reason(*map(F.col, "swfr"))).collect()]
    assert got == ["steep 30 deg · wind 8 m/s · forest", "good"]


def test_walking_speed_floor(spark):
    got = values(spark, [0.0, 80.0], wind.walking_kmh(F.col("x"), 0.3))
    assert got[0] == pytest.approx(6 * 2.718281828459045 ** (-0.175)) and got[1] == 0.3

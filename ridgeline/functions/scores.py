"""Suitability scores, wind scores, labels and model features as Column expressions."""

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline import params as P
from ridgeline.functions import geo


def coded(table: dict, code: Column) -> Column:
    """Look a code up in a small table; an unknown code gives null."""
    mapping = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.try_element_at(mapping, code)


def banded(value: Column, edges, results, above) -> Column:
    """results[i] while value < edges[i], else ``above``."""
    bands = list(zip(edges, results))
    out = F.when(value < bands[0][0], F.lit(bands[0][1]))
    for edge, result in bands[1:]:
        out = out.when(value < edge, F.lit(result))
    return out.otherwise(F.lit(above))


def elevation_grade(elevation: Column) -> Column:
    return banded(elevation, P.ELEVATION_GRADE_EDGES, (0, 1), 2)


def component_scores() -> dict[str, Column]:
    """The four terrain scores from the graded columns."""
    return {
        "slope_score": coded(P.SLOPE_SCORE, F.col("slope_grade")),
        "density_score": coded(P.DENSITY_SCORE, F.col("density_grade")),
        "height_score": coded(P.HEIGHT_SCORE, F.col("height_grade")),
        "elevation_score": coded(P.ELEVATION_SCORE, elevation_grade(F.col("elevation"))),
    }


def static_score(mode: str) -> Column:
    """Weighted terrain score of one mode; null when any grade is unknown."""
    weights = P.TACTIC_WEIGHTS[mode]
    return reduce(add, [F.col(f"{part}_score") * weights[part] for part in P.STATIC_PARTS])


def with_static_scores(cells: DataFrame) -> DataFrame:
    scored = cells.withColumns(component_scores())
    return scored.withColumns({f"static_{mode}": static_score(mode) for mode in P.MODES})


def land_flags(land: Column) -> dict[str, Column]:
    """One-hot land type for the known codes."""
    return {f"land_{k}": (land == k).cast("byte") for k in P.LAND_CODES}


def train_wind_score(speed: Column) -> Column:
    return banded(speed, P.TRAIN_WIND_EDGES, P.WIND_SCORES, 0.0)


def size_wind_score(speed: Column, size: Column) -> Column:
    """Wind score with the limits of the aircraft size."""
    small, large = (banded(speed, P.SIZE_WIND_EDGES[s], P.WIND_SCORES, 0.0) for s in ("small", "large"))
    return F.when(size == "small", small).otherwise(large)


def angle_score(difference: Column) -> Column:
    """1 into the wind, 0 with the wind, else 0.5, for an absolute angle difference."""
    d = geo.pmod360(F.abs(difference))
    return (F.when((d < 45) | (d >= 315), 1.0)
            .when((d >= 135) & (d < 225), 0.0).otherwise(0.5))


def base_wind_dir_score(lat: Column, lon: Column, wind_dir: Column) -> Column:
    return angle_score(geo.heading_from_base(lat, lon) - wind_dir)


def suitability(static: Column, wind: Column, wind_dir: Column, mode: str) -> Column:
    w = P.TACTIC_WEIGHTS[mode]
    return static + wind * w["wind"] + wind_dir * w["wind_dir"]


def risk_label(score: Column) -> Column:
    """0 safe, 1 caution, 2 danger; a missing score counts as danger."""
    return F.when(score >= P.SAFE_FROM, 0).when(score >= P.CAUTION_FROM, 1).otherwise(2)


def wind_encoding(wind_dir: Column) -> dict[str, Column]:
    return {"wind_dir_sin": F.sin(F.radians(wind_dir)), "wind_dir_cos": F.cos(F.radians(wind_dir))}


def interactions() -> dict[str, Column]:
    return {
        "tree_risk": (F.col("density_grade") * F.col("height_grade")).cast("double"),
        "aero_risk": F.col("elevation") * F.col("wind_speed"),
        "slope_wind_risk": F.col("slope_grade") * F.col("wind_speed"),
    }


def class_text(label: Column) -> Column:
    return coded(P.CLASS_LABELS, label)


def wind_text(score: Column) -> Column:
    return coded(P.WIND_LABELS, score)


def land_code(flags: dict[int, Column]) -> Column:
    """One-hot flags back to the land code."""
    return F.coalesce(*[F.when(flag == 1, F.lit(code)) for code, flag in flags.items()])

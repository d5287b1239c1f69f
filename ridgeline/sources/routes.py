"""Route export: flattened rows and JSON lines for a map client."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def export_rows(points: DataFrame) -> DataFrame:
    """One row per path point in the flattened exchange form."""
    return points.select("path_id", F.col("seq").alias("index"), F.col("latitude").alias("lat"),
                         F.col("longitude").alias("lon"), F.col("elevation").alias("height"),
                         "slope", "wind_speed", "is_forest", "penalty")


def json_rows(rows: DataFrame, key: str = "path_id") -> DataFrame:
    fields = [c for c in rows.columns if c != key]
    return rows.select(key, F.to_json(F.struct(*fields)).alias("point"))


def write_json(rows: DataFrame, path: str) -> None:
    """Partitioned JSON lines; a path may span files, its points carry their index."""
    json_rows(rows).write.mode("overwrite").json(path)

"""Hazard points: encoded CSV with WKT positions, area flag and CSV sink."""

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline import schemas

# fixed value: the accepted form of a position
POINT = r"POINT\(([0-9.]+)\s+([0-9.]+)\)"


def read(spark: SparkSession, path: str, encoding: str = "cp949") -> DataFrame:
    """Spark reads a few standard encodings only.

    Other ASCII-compatible ones are scanned byte for byte as Latin-1 (their
    multi-byte letters never contain a comma, quote or line end) and then
    decoded in Arrow batches.
    """
    @F.pandas_udf("string")
    def decoded(text: pd.Series) -> pd.Series:
        return text.map(lambda t: t.encode("latin-1").decode(encoding), na_action="ignore")

    raw = (spark.read.schema(schemas.HAZARD).option("header", True)
           .option("encoding", "ISO-8859-1").csv(path))
    return raw.select(*[decoded(c).alias(c) for c in raw.columns])


def located(hazards: DataFrame, name_like: str | None = None, name: str = "name") -> DataFrame:
    """Parse the positions, keep names that contain the text, drop rows that do not parse."""
    kept = hazards if name_like is None else hazards.where(F.col(name).contains(name_like))
    return (kept.withColumns({
        "lon": F.regexp_extract("position", POINT, 1).try_cast("double"),
        "lat": F.regexp_extract("position", POINT, 2).try_cast("double")})
        .dropna(subset=["lat", "lon"]))


def area_flag(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Whether a point lies inside the extent of the terrain (a one-row aggregate)."""
    extent = cells.agg(F.struct(F.min("latitude").alias("s"), F.max("latitude").alias("n"),
                                F.min("longitude").alias("w"), F.max("longitude").alias("e"))).scalar()
    return (points.withColumn("_x", extent)
            .withColumn("in_area", F.col("lat").between(F.col("_x.s"), F.col("_x.n"))
                        & F.col("lon").between(F.col("_x.w"), F.col("_x.e")))
            .drop("_x"))


def write(points: DataFrame, path: str) -> None:
    (points.select("hazard_id", "name", "kind", "lat", "lon", "in_area")
     .write.mode("overwrite").option("header", True).csv(path))

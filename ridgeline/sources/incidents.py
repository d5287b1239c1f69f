"""Incident positions: file intake, sampled positions and the extent check."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline import schemas
from ridgeline.operators import sampling


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every incident of the file, numbered by its position text."""
    df = spark.read.schema(schemas.INCIDENT).option("header", True).csv(path)
    return df.dropna().withColumn("incident_id", F.xxhash64("latitude", "longitude"))


def random_cells(cells: DataFrame, n: int = 1, seed: int = 42) -> DataFrame:
    """Real cells as incident positions, chosen by key hash."""
    return (sampling.hash_sample(cells, "cell_id", n, seed)
            .select(F.col("cell_id").alias("incident_id"), "latitude", "longitude"))


def extent_check(incidents: DataFrame, south=38.0, north=38.3, west=128.3, east=128.6) -> DataFrame:
    """Flag positions outside the supported extent instead of rejecting the batch."""
    inside = F.col("latitude").between(south, north) & F.col("longitude").between(west, east)
    return incidents.withColumn("in_extent", inside)

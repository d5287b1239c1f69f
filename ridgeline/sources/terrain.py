"""Terrain tables: raw CSV parts, cleaning, the graded base and its Parquet sink."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline import schemas
from ridgeline.functions import scores

MISSING = -9999


def number(column: Column, kind: str = "double") -> Column:
    """Text or number to a number; unreadable text and the missing marker become null."""
    return F.nullif(column.try_cast(kind), F.lit(MISSING).cast(kind))


def read_raw(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All CSV parts in one scan."""
    return spark.read.schema(schemas.RAW_TERRAIN).option("header", True).csv(paths)


def clean(raw: DataFrame) -> DataFrame:
    """Coerce the optional columns and drop rows without a position or elevation."""
    optional = [c for c in ("elevation", "slope_deg", "tree_height", "tree_density") if c in raw.columns]
    coerced = raw.withColumns({c: number(F.col(c)) for c in optional})
    return coerced.dropna(subset=["longitude", "latitude", "elevation"])


def union_splits(parts: dict[str, DataFrame], test_names=("test",)) -> DataFrame:
    """Union of the source tables with the split flags of each source."""
    flagged = [df.withColumns({"is_test": F.lit(name in test_names),
                               "is_train_final": F.lit(name not in test_names)})
               for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), flagged)


def base_table(cells: DataFrame) -> DataFrame:
    """Graded base: one-hot land, narrow types, the four component and static scores.

    The missing marker is nulled before the narrow casts, since it does not
    fit a byte.  Arithmetic stays double; the narrow types are for storage.
    """
    grades = {"slope_grade": number(F.col("slope_code"), "int").cast("byte"),
              "density_grade": number(F.col("density_grade"), "int").cast("byte"),
              "height_grade": number(F.col("height_grade"), "int").cast("byte")}
    flags = scores.land_flags(F.col("land_type"))
    return (scores.with_static_scores(cells.withColumns({**grades, **flags}))
            .withColumn("zone", F.lit(-1).cast("byte")).drop("slope_code"))


def narrowed(base: DataFrame) -> DataFrame:
    """Storage types: single-precision positions and scores, byte grades."""
    floats = [c for c, t in base.dtypes if t == "double"]
    return base.withColumns({c: F.col(c).cast("float") for c in floats})


def write_base(base: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = narrowed(base).write.mode("overwrite").option("compression", "snappy")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def read_base(spark: SparkSession, path: str, columns=None, split: str | None = None) -> DataFrame:
    """Scan the base with only the wanted columns and, if named, one split flag."""
    df = spark.read.parquet(path)
    if split is not None:
        # a partition folder name reads back as text
        df = df.where(F.col(split).cast("boolean"))
    return df.select(*columns) if columns else df

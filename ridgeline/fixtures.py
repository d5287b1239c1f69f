"""Deterministic projections of the supplied tables to the domain's shapes.

Each projection is a list of (expression, name) that Spark and DuckDB read
alike, so both engines see the same rows.  Whole tables are projected:
there is no row filter anywhere.
"""

import os

from pyspark.sql import DataFrame, SparkSession

SHEET_ROWS = 50
SHEET_COLS = 100

# name -> (source table, projection)
PROJECTIONS = {
    "terrain_cells": ("orders", [
        ("o_orderkey", "cell_id"),
        ("CAST(floor(o_orderkey / 5e3) AS INT)", "grid_id"),
        ("CAST(floor((o_orderkey % 5000) / 1e2) AS INT)", "row"),
        ("CAST(o_orderkey % 100 AS INT)", "col"),
        ("38.05e0 + (o_orderkey % 100) * 9e-4", "latitude"),
        ("128.35e0 + floor(o_orderkey / 1e2) * 1.1e-3", "longitude"),
        ("6e2 + 2e0 * (floor(o_orderkey / 1e2) % 150) + 3e0 * (o_orderkey % 100)"
         " + (CASE WHEN floor(o_orderkey / 1e2) % 37 = 0 THEN 3e2 ELSE 0e0 END)"
         " + round(o_totalprice % 6e1, 2)", "elevation"),
        ("CASE WHEN o_orderkey % 211 = 0 THEN -9999 ELSE CAST(o_custkey % 3 AS INT) END", "slope_code"),
        ("CAST((o_orderkey * 7919) % 4 AS INT)", "density_grade"),
        ("CAST((o_orderkey * 104729) % 3 AS INT)", "height_grade"),
        ("CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END", "land_type"),
        ("round(o_totalprice % 1e0, 2)", "density_ratio"),
        ("CAST(o_custkey % 45 AS DOUBLE) + 5e-1", "canopy_m"),
    ]),
    "stations": ("nation", [
        ("n_nationkey", "station_id"),
        ("n_name", "station_name"),
        ("37.93e0 + ((n_nationkey * n_nationkey * 3 + n_nationkey * 7) % 29) * 1.37e-2"
         " + n_nationkey * 3e-4", "lat"),
        ("128.21e0 + ((n_nationkey * n_nationkey * 5 + n_nationkey * 11) % 31) * 1.91e-2"
         " + n_nationkey * 2e-4", "lon"),
        ("2e1 + n_nationkey * 5.5e1", "elev"),
    ]),
    "observations": ("events", [
        ("event_id", "event_id"),
        ("ts", "ts"),
        ("CAST(user_id % 25 AS INT)", "station_id"),
        ("CASE WHEN event_type = 'error' THEN -9.99e1 ELSE CAST((event_id * 37) % 360 AS DOUBLE) END", "wd"),
        ("CASE WHEN event_type = 'error' THEN -9.99e1 ELSE round(value % 8e0, 2) END", "ws"),
        ("CASE WHEN event_type = 'error' THEN 0e0 ELSE round(value % 2.5e1, 2) END", "gust"),
    ]),
    "incidents": ("customer", [
        ("c_custkey", "incident_id"),
        ("CAST(floor(c_custkey / 5e2) AS INT)", "grid_id"),
        ("38.0502e0 + ((c_custkey * 37) % 97) * 9e-4", "latitude"),
        ("128.3503e0 + floor(c_custkey / 1e1) * 1.1e-3", "longitude"),
        ("CASE WHEN c_custkey % 4 = 0 THEN 'small' ELSE 'large' END", "heli_size"),
    ]),
    "path_points": ("lineitem", [
        ("l_orderkey", "path_id"),
        ("CAST(row_number() OVER (PARTITION BY l_orderkey"
         " ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INT)", "seq"),
        ("CAST(floor(l_orderkey / 5e3) AS INT)", "grid_id"),
        ("CAST(l_partkey % 15 AS INT)", "row"),
        ("CAST(l_suppkey % 100 AS INT)", "col"),
    ]),
    "hazards": ("customer", [
        ("c_custkey", "hazard_id"),
        ("c_name", "name"),
        ("c_mktsegment", "kind"),
        ("CASE WHEN c_custkey % 7 = 6 THEN concat('POINT ', c_name)"
         " ELSE concat('POINT(128.', lpad(CAST(350 + (c_custkey * 29) % 190 AS VARCHAR(12)), 3, '0'),"
         " ' 38.', lpad(CAST(50 + (c_custkey * 13) % 110 AS VARCHAR(12)), 3, '0'), ')') END", "position"),
    ]),
    "predictions": ("lineitem", [
        ("l_orderkey * 16 + l_linenumber", "row_id"),
        ("CAST((l_orderkey + l_partkey) % 3 AS INT)", "y_true"),
        ("CAST(CASE WHEN l_suppkey % 4 = 0 THEN (l_orderkey + l_partkey + 1) % 3"
         " ELSE (l_orderkey + l_partkey) % 3 END AS INT)", "y_pred"),
        ("((l_partkey * 7919 + l_suppkey * 31) % 1000) / 1e3", "probability"),
        ("CASE WHEN l_shipdate < TIMESTAMP '1998-01-01 00:00:00' THEN 'model' ELSE 'baseline' END", "source"),
        ("l_extendedprice", "price"),
    ]),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def shape(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the domain shapes, projected from its supplied table."""
    source, columns = PROJECTIONS[name]
    return table(spark, sf_dir, source).selectExpr(*[f"{expr} AS {alias}" for expr, alias in columns])


def shape_sql(name: str) -> str:
    """The same projection as a common table expression."""
    source, columns = PROJECTIONS[name]
    items = ", ".join(f'{expr} AS "{alias}"' for expr, alias in columns)
    return f"{name} AS (SELECT {items} FROM {source})"

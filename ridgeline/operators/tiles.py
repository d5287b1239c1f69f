"""Bounded windows over grids and paths.

A window keyed by a whole grid or path grows with it.  Here rows are cut into
tiles (or chunks) of fixed size, the rim of each neighbour is copied in, and
one shuffle by tile serves every neighbourhood window that follows: a window
keyed by (tile, row) is satisfied by the partitioning on the tile.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = 256
CHUNK = 4096


def _homes(position: Column, size: int, before: int, after: int) -> Column:
    """Tiles that need a position: its own and those whose rim it belongs to."""
    return F.array_distinct(F.array(F.floor((position - after) / size), F.floor(position / size),
                                    F.floor((position + before) / size)))


def tiled(grid: DataFrame, halo: int, keys=("grid_id",), tile: int = TILE) -> DataFrame:
    """Copy each cell to the tiles that need it and shuffle once by tile."""
    return (grid.withColumn("_tr", F.explode(_homes(F.col("row"), tile, halo, halo)))
            .withColumn("_tc", F.explode(_homes(F.col("col"), tile, halo, halo)))
            .repartition(*keys, "_tr", "_tc"))


def untiled(grid: DataFrame, tile: int = TILE) -> DataFrame:
    """Keep the home copy of each cell."""
    return (grid.where((F.col("_tr") == F.floor(F.col("row") / tile))
                       & (F.col("_tc") == F.floor(F.col("col") / tile))).drop("_tr", "_tc"))


def chunked(paths: DataFrame, before: int = 1, after: int = 1, keys=("path_id",), chunk: int = CHUNK,
            order: str = "seq") -> DataFrame:
    """Cut sequences into chunks with ``before``/``after`` rows of the neighbours."""
    return (paths.withColumn("_chunk", F.explode(_homes(F.col(order), chunk, before, after)))
            .repartition(*keys, "_chunk"))


def unchunked(paths: DataFrame, chunk: int = CHUNK, order: str = "seq") -> DataFrame:
    return paths.where(F.col("_chunk") == F.floor(F.col(order) / chunk)).drop("_chunk")

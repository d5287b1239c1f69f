"""Samples and splits that do not depend on how rows are partitioned.

``rand()`` changes with the partitioning, so a retried task would give other
rows.  Here the order or the choice comes from a hash or from arithmetic on
the row's own key.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed value: modulus of the key arithmetic, a prime near 2^31
PRIME = 2_147_483_647


def key_fraction(key: Column, seed: int = 42) -> Column:
    """Deterministic number in [0, 1) from an integer key, by modular arithmetic."""
    mixed = F.pmod(F.pmod(key, F.lit(PRIME)) * F.lit(48271 + 2 * seed), F.lit(PRIME))
    return F.pmod(mixed * 16807 + seed, F.lit(PRIME)) / float(PRIME)


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in key-fraction order; a top-k, so each task keeps at most n rows."""
    return df.orderBy(key_fraction(F.col(key), seed), key).limit(n)


def by_stratum(df: DataFrame, stratum: Column, fraction: float, key: str, seed: int = 42) -> DataFrame:
    """Keep every row outside the stratum and a fraction of the rows inside it."""
    inside = F.coalesce(stratum, F.lit(False))
    return df.where(~inside | (key_fraction(F.col(key), seed) < fraction))

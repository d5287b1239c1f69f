"""Consistent placement with a permutation-filled lookup table.

Every shard orders the slots of a prime-sized table by (offset + k * skip) mod size, both taken from a digest of its name.  Shards
take turns; on its turn a shard claims the first slot of its order that is still free, until the table is full.  Shares differ by one
slot at most, and a shard that leaves or joins moves few other slots.  The table has a fixed number of slots, whatever the data, so
it is filled on the driver and broadcast; a row finds its shard in constant time from a digest of its key.
"""

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537
MOST_SLOTS = 1_000_003
SHARDS = tuple(f"shard-{k:03d}" for k in range(64))


def _prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n ** 0.5) + 1))


def preference(shard: str, slots: int) -> tuple[int, int]:
    """Offset and skip of a shard's order of the slots."""
    digest = hashlib.md5(shard.encode()).hexdigest()
    return int(digest[:15], 16) % slots, int(digest[15:30], 16) % (slots - 1) + 1


def filled(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the number of the shard that claimed it; shards take turns in the order of their names."""
    if not _prime(slots) or slots > MOST_SLOTS:
        raise ValueError(f"the table needs a prime number of slots up to {MOST_SLOTS}")
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("give different shards, one at least and no more than slots")
    turns = sorted(range(len(shards)), key=lambda k: shards[k])
    orders = {k: preference(shards[k], slots) for k in turns}
    owner, next_, free = [-1] * slots, dict.fromkeys(turns, 0), slots
    while free:
        for k in turns:
            offset, skip = orders[k]
            while owner[slot := (offset + next_[k] * skip) % slots] >= 0:
                next_[k] += 1
            owner[slot] = k
            free -= 1
            if not free:
                break
    return owner


def lookup_table(spark: SparkSession, shards: list[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(slot, shard) with one row per slot."""
    return spark.createDataFrame([(slot, shards[k]) for slot, k in enumerate(filled(list(shards), slots))], "slot long, shard string")


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: 60 bits of its MD5 modulo the table's size; a null key counts as the empty string."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots))


def placed(df: DataFrame, key: str, shards: list[str] = SHARDS, slots: int = SLOTS, slot: str = "slot",
           shard: str = "shard") -> DataFrame:
    """df with its slot and shard; rows and other columns stay as they are.

    Rows with equal keys share a shard, a null key is placed as the empty string, an empty table stays empty.  Give other names for
    `slot` and `shard` where df has such columns; a clash is refused.
    """
    if {slot, shard} & set(df.columns):
        raise ValueError(f"df has a column {slot} or {shard} already; name others")
    table = lookup_table(df.sparkSession, shards, slots).select(F.col("slot").alias(slot), F.col("shard").alias(shard))
    return df.withColumn(slot, slot_of(df[key], slots)).join(F.broadcast(table), slot).select(*df.columns, slot, shard)


def write_shards(df: DataFrame, key: str, path: str, shards: list[str] = SHARDS, slots: int = SLOTS, per_shard: int = 1) -> None:
    """Write df as one folder per shard; per_shard tasks share a shard, so no shard is bound to one task."""
    part = F.pmod(F.xxhash64(key), F.lit(per_shard))
    placed(df, key, shards, slots).repartition("shard", part).write.partitionBy("shard").mode("overwrite").parquet(path)

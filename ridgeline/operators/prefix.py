"""Running counts over sorted values without a global sort in one task."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ridgeline.session import staged

VALUES_PER_BUCKET = 100_000


def running(counts: DataFrame, value: str, sums, keys=(), descending: bool = False,
            per_bucket: int = VALUES_PER_BUCKET) -> DataFrame:
    """Inclusive running sums in value order; needs one row per (keys, value).

    The values are cut at their approximate quantiles.  Sums run inside each
    bucket and start from the totals of the buckets before it, so a task holds
    one bucket and only the few bucket totals are put in one order.  The number
    of buckets follows the number of rows, so a bucket stays small.
    """
    counts = staged(counts)  # read for the number of rows, the cuts, the totals and the sums
    buckets = max(2, -(-counts.count() // per_bucket))
    steps = [i / buckets for i in range(1, buckets)]
    cuts = counts.agg(F.percentile_approx(value, steps, 10 * buckets)).scalar()
    # binary search: the number of cuts at or below the value
    placed = counts.withColumn("_cuts", cuts).withColumn("_bucket", F.aggregate(
        F.array(*[F.lit(2 ** i) for i in reversed(range((buckets - 1).bit_length()))]), F.lit(0),
        lambda at, jump: F.when((at + jump < buckets)
                                & (F.get(F.col("_cuts"), at + jump - 1) <= F.col(value)), at + jump)
        .otherwise(at))).drop("_cuts")
    order = F.col(value).desc() if descending else F.col(value).asc()
    before_order = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    totals = placed.groupBy(*keys, "_bucket").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    earlier = W.partitionBy(*keys).orderBy(before_order).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_bucket", *[
        F.coalesce(F.sum(f"_t_{s}").over(earlier), F.lit(0)).alias(f"_o_{s}") for s in sums])
    inside = W.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    out = placed.join(offsets, [*keys, "_bucket"])
    out = out.withColumns({f"cum_{s}": F.sum(s).over(inside) + F.col(f"_o_{s}") for s in sums})
    return out.drop("_bucket", *[f"_o_{s}" for s in sums])

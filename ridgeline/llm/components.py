"""Connected components of a link table, as joins over written tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.session import staged


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the smallest node that links reach; nodes without a link are absent.

    Minimum labels spread along links and then jump to the label of the label, so the number of rounds grows with the logarithm
    of the longest chain.  Each round is written to the shared folder.  Null ends are ignored, repeated links do no harm.
    """
    links = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    both = staged(links.select(F.col(a).alias("src"), F.col(b).alias("dst"))
                  .union(links.select(F.col(b).alias("src"), F.col(a).alias("dst"))).distinct())
    labels = staged(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("src"), F.min("dst")).alias("component")))
    while True:
        near = (both.join(labels, both.dst == labels.node).groupBy(F.col("src").alias("node"))
                .agg(F.min("component").alias("offer")))
        hooked = (labels.join(near, "node").select("node", F.least("component", "offer").alias("component"),
                                                   F.col("component").alias("was")))
        top = labels.select(F.col("node").alias("up"), F.col("component").alias("above"))
        new = staged(hooked.join(top, hooked.component == top.up, "left")
                     .select("node", F.least("component", F.coalesce("above", "component")).alias("component"), "was"))
        changed = new.where("component != was").limit(1).count()
        labels = new.drop("was")
        if not changed:
            return labels

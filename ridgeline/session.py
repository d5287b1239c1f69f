"""Session defaults and the shared folder that cuts long lineages."""

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the benchmark; a cluster job brings its own."""
    return (SparkSession.builder.master(f"local[{cores}]").appName("ridgeline")
            .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.driver.memory", memory)
            .config("spark.ui.enabled", "false")
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4m")
            .getOrCreate())


def importable_in_tasks(spark: SparkSession) -> None:
    """Python tasks import this package: a cluster job ships it (--py-files), a local one gets its path."""
    if spark.sparkContext.master.startswith("local"):
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        spark.sparkContext.environment.setdefault("PYTHONPATH", root)


def _ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the folder the cluster names; only a local session gets one of its own."""
    if spark.sparkContext.getCheckpointDir() is not None:
        return spark.sparkContext.getCheckpointDir()
    named = spark.conf.get(CHECKPOINT_SETTING, None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="ridgeline-checkpoint-")
    spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext.getCheckpointDir()


def staged(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows as a table in the shared folder and read it back.

    It survives lost executors like a checkpoint does.  A checkpoint would
    carry size estimates along, and those multiply with every join of a loop;
    a written table starts from its real size, so small results of a round
    are broadcast and the large side stays where it is.
    """
    path = f"{_ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Folders for binary output in the shared storage that the cluster names; paths work for any pyarrow file system."""

import re
import uuid

from pyarrow import fs
from pyspark.sql import SparkSession

from ridgeline.session import CHECKPOINT_SETTING, staged


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir (a session without it gets the one of session.staged)."""
    root = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        staged(spark.range(1))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path within it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))

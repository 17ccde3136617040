"""The folder that the driver and all executors share, for checkpoints and written tables."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Serves a session on one machine that names no folder, as in tests.
LOCAL_DIR = "file:///tmp/checkpoints/tessella"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or where the session's checkpoints go.

    A session on one machine (master ``local``) that names neither gets
    LOCAL_DIR; on a cluster this raises instead of using a local folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or LOCAL_DIR).rstrip("/")


def use_shared_checkpoints(spark: SparkSession) -> None:
    """Let ``checkpoint()`` write to the shared folder where the session has set none."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))

"""Folders for data a job must write on the way (staged tables, stream state)."""

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees, as the cluster names it.

    Only a local session without the setting gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix="fleetwarden-")
    raise ValueError("set spark.checkpoint.dir to a folder shared by the executors")


def fresh_folder(spark: SparkSession, purpose: str) -> str:
    """A folder name not used before, below the shared folder."""
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"

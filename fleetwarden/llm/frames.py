"""Small DataFrame helpers of the operators."""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Callable

from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where it is unset and the session is local, as in tests, a temporary one, once a session.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="fleetwarden-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The rows, written once to the checkpoint folder; their lineage ends there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, path: str) -> DataFrame:
    """The rows, read back from a table, so that the planner sees their real size.

    Unlike those of ``cut``, its columns are read one by one.
    """
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def share(df: DataFrame, value) -> Broadcast:
    """Broadcast a value of bounded size together with the code of its class; see ``shared``."""
    return df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(value))


def shared(broadcast: Broadcast):
    """Inside a task, what ``share`` was given."""
    return pickle.loads(broadcast.value)


def kept(broadcast: Broadcast, make: Callable):
    """Inside a task, ``make(shared(broadcast))``, made once in a Python worker.

    Later tasks of the worker go on with the same object, so it must not change their results; it
    is for things learnt on the way that are of bounded size.
    """
    if not hasattr(broadcast, "_kept"):
        broadcast._kept = make(shared(broadcast))
    return broadcast._kept


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """The rows without columns of these names, in any spelling."""
    taken = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def aside(df: DataFrame, *keep: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The rows with all columns but ``keep`` under names that clash with nothing, and what gives
    a result of them its own columns back, in their order, and no others."""
    own = df.columns
    names = [c if c in keep else f"c{i}_{c}" for i, c in enumerate(own)]

    def back(result: DataFrame) -> DataFrame:
        return result.select([F.col(f"`{n}`") for n in names]).toDF(*own)

    return df.toDF(*names), back


def ddl(df: DataFrame, more: str) -> str:
    """The columns of df and some more, as a schema string."""
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return f"{own}, {more}" if own else more


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, n: int):
    """The remainder by which rows are held out: crc32 of the id as text."""
    return F.crc32(F.col(column).cast("string")) % n

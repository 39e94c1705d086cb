"""The log of loads of a warehouse: their order, their ranges of ids, how they ended."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetwarden.sources.commit_log import CommitLog

#: Ids that ``monotonically_increasing_id`` may give in one partition.
PARTITION_IDS = 1 << 33
BEGUN, LOADED, FAILED = "begun", "loaded", "failed"
ENTRY = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("load_id", T.StringType()),
        T.StructField("load_order", T.LongType()),
        T.StructField("first_id", T.LongType()),
        T.StructField("last_id", T.LongType()),
        T.StructField("status", T.StringType()),
    ]
)


class Load(NamedTuple):
    load_id: str
    order: int
    first_id: int
    last_id: int


class LoadLog:
    """Every run adds an entry when it begins and one when it ends."""

    def __init__(self, spark: SparkSession, root: str):
        self.log = CommitLog(spark, f"{root}/_loads", ENTRY)

    def begin(self, load_id: str, partitions: int) -> Load:
        """Take a number and a range of ids, enough for so many partitions.

        A load that was begun before keeps its number, so the order of loads is that in which
        they first came; its ids are new, since rows of the run before may still be read.
        """

        def entry(before: list[dict]) -> dict:
            same = [e["load_order"] for e in before if e["load_id"] == load_id]
            order = same[0] if same else 1 + max((e["load_order"] for e in before), default=0)
            first = 1 + max((e["last_id"] for e in before), default=0)
            last = first + max(1, partitions) * PARTITION_IDS - 1
            return {"load_id": load_id, "load_order": order, "first_id": first, "last_id": last, "status": BEGUN}

        made = self.log.append(entry)
        return Load(load_id, made["load_order"], made["first_id"], made["last_id"])

    def finish(self, load: Load, complete: bool) -> None:
        status = LOADED if complete else FAILED
        own = {"load_id": load.load_id, "load_order": load.order, "first_id": load.first_id, "last_id": load.last_id}
        self.log.append(lambda _: {**own, "status": status})

    def newest(self) -> int:
        """The highest number of a load so far; 0 where there is none."""
        return max((e["load_order"] for e in self.log.entries()), default=0)

    def loads(self) -> DataFrame:
        """One row for each load: its number, runs begun, and how the last entry says it stands."""
        return self.log.rows().groupBy("load_id").agg(
            F.min("load_order").alias("load_order"),
            F.count_if(F.col("status") == BEGUN).alias("runs"),
            F.max_by("status", "n").alias("status"),
        )

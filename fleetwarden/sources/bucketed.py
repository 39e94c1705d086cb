"""A table in hash buckets of its key, of which a merge rewrites only those that it touches.

Files lie in ``version=<id>/bucket=<k>``. Which version of each bucket counts is said by the
commit log of the table, so a merge is seen as a whole or not at all: a broken one leaves
folders that no entry names, and readers keep the versions they began with. Of two merges of
one bucket the slower one starts again on the other's result. Versions before the last one are
deleted after a merge; the last one stays for readers that began before it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetwarden.sources.commit_log import CommitLog
from fleetwarden.sources.warehouse import write_counted

BUCKET, VERSION = "bucket", "version"
BUCKETS = 64
ENTRY = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("buckets", T.IntegerType()),
        T.StructField("versions", T.MapType(T.StringType(), T.StringType())),
    ]
)


class BucketedTable:
    """``buckets`` counts for a new table; an existing one keeps its number."""

    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int = BUCKETS
    ):
        self.spark, self.path, self.schema, self.key, self.new = spark, path, schema, key, buckets
        self.log = CommitLog(spark, f"{path}/_commits", ENTRY)

    def _state(self, entries: list[dict]) -> dict[int, str]:
        """The version of each bucket that has rows."""
        state: dict[int, str] = {}
        for entry in entries:
            state.update({int(k): v for k, v in entry["versions"].items()})
        return state

    def _place(self, versions: dict[int, str]) -> list[str]:
        return [f"{self.path}/{VERSION}={v}/{BUCKET}={k}" for k, v in sorted(versions.items())]

    def _read(self, versions: dict[int, str]) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*self._place(versions))

    def read(self) -> DataFrame:
        """The rows as of the last merge."""
        return self._read(self._state(self.log.entries()))

    def bucket(self, entries: list[dict]) -> Column:
        n = entries[0]["buckets"] if entries else self.new
        return F.pmod(F.xxhash64(self.key), F.lit(n)).cast("int")

    def merge(self, incoming: DataFrame, merged: Callable[[DataFrame], DataFrame]) -> int:
        """Replace the buckets of the keys in ``incoming`` by ``merged(their rows)``.

        ``merged`` must keep every key in its bucket, which it does if it adds no keys but those
        of ``incoming``. Returns the number of rows written. A job finds the touched buckets, at
        most as many as there are.
        """
        while True:
            entries = self.log.entries()
            state, bucket = self._state(entries), self.bucket(entries)
            keys = incoming.where(F.col(self.key).isNotNull()).select(bucket.alias(BUCKET))
            touched = [r[0] for r in keys.distinct().collect()]
            if not touched:
                return 0
            known = self._read({k: v for k, v in state.items() if k in touched})
            rows = merged(known).select(*self.schema.names).withColumn(BUCKET, bucket)
            version = uuid.uuid4().hex
            written = write_counted(
                rows.repartition(BUCKET), f"{self.path}/{VERSION}={version}", BUCKET
            )

            def commit(now: list[dict]) -> dict | None:
                current = self._state(now)
                if any(current.get(k) != state.get(k) for k in touched):
                    return None
                n = now[0]["buckets"] if now else self.new
                return {"buckets": n, "versions": {str(k): version for k in touched}}

            if self.log.append(commit) is not None:
                self._prune(touched)
                return written
            self.log.files.delete(f"{self.path}/{VERSION}={version}")

    def _prune(self, buckets: list[int]) -> None:
        """Delete the versions of these buckets before the last two."""
        history: dict[int, list[str]] = {}
        for entry in self.log.entries():
            for k, v in entry["versions"].items():
                history.setdefault(int(k), []).append(v)
        for k in buckets:
            for old in history[k][:-2]:
                self.log.files.delete(f"{self.path}/{VERSION}={old}/{BUCKET}={k}")

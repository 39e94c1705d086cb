"""A log of commits in a folder: numbered entries, each written once and as a whole.

Entry n is the file ``n.json``. It is written under a hidden name and then renamed, which
fails where n is taken, so of two writers one gets n and the other looks at the new entry and
tries n + 1. Where a file system renames atomically, as HDFS does, writers on several machines
are safe; writers in one process are so anywhere. An entry is one small row, so reading the log
costs a row for each load ever begun, never a look at their data.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_ONE_WRITER = threading.Lock()


class Files:
    """Paths of any file system that Spark knows, seen from the driver."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.system = self.path(folder).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def exists(self, name: str) -> bool:
        return self.system.exists(self.path(name))

    def names(self, folder: str) -> list[str]:
        if not self.exists(folder):
            return []
        return [s.getPath().getName() for s in self.system.listStatus(self.path(folder))]

    def delete(self, name: str) -> None:
        self.system.delete(self.path(name), True)

    def write_new(self, name: str, data: bytes) -> bool:
        """Whether the file was written; false where it is there already."""
        folder, _, last = name.rpartition("/")
        hidden = self.path(f"{folder}/.{last}-{uuid.uuid4().hex}")
        out = self.system.create(hidden, True)
        out.write(data)
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.system.getUri(), self.conf)
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.gateway.new_array(kind, 1)
        options[0] = kind.NONE
        try:
            context.rename(hidden, self.path(name), options)
        except Py4JJavaError as error:
            self.system.delete(hidden, False)
            if error.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
            return False
        return True


class CommitLog:
    """Entries of one schema, which has a whole number ``n``."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType):
        self.spark, self.folder, self.schema = spark, folder, schema
        self.files = Files(spark, folder)

    def _empty(self) -> bool:
        return not any(name.endswith(".json") for name in self.files.names(self.folder))

    def rows(self) -> DataFrame:
        """The entries as a table."""
        if self._empty():
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).json(self.folder)

    def entries(self) -> list[dict]:
        if self._empty():
            return []
        return sorted((r.asDict(True) for r in self.rows().collect()), key=lambda e: e["n"])

    def append(self, make: Callable[[list[dict]], dict | None]) -> dict | None:
        """Add the entry that ``make`` gives for all entries before it, None for no entry.

        ``make`` is called again with the new entries where another writer was faster.
        """
        while True:
            with _ONE_WRITER:
                before = self.entries()
                made = make(before)
                if made is None:
                    return None
                entry = {**made, "n": before[-1]["n"] + 1 if before else 1}
                name = f"{self.folder}/{entry['n']:012d}.json"
                if self.files.write_new(name, json.dumps(entry).encode()):
                    return entry

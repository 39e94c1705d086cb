"""Parquet tables of a warehouse folder.

A fact table is a set of loads, ``<table>/load_id=<id>/event_date=<day>``.  Loading
the same id again replaces that load, so a repeated job does not duplicate rows.
The machine table is kept in buckets, see ``bucketed``; the loads are numbered, see ``loads``.
"""

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOAD = "load_id"
EVENT_DATE = "event_date"
#: Rows after which a file that a later step reads is closed.  Readers pack files into tasks by
#: their bytes and a fixed cost each, so without it well compressed rows make tasks of any size.
FILE_ROWS = 100_000


def load_path(root: str, table: str, load_id: str) -> str:
    return f"{root}/{table}/{LOAD}={load_id}"


def write_counted(frame: DataFrame, path: str, *partitions: str, file_rows: int = 0) -> int:
    """Replace ``path`` with the rows of ``frame``; returns how many were written.

    ``file_rows`` bounds the rows of a file; 0 for no bound.
    """
    seen = Observation()
    counted = frame.observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.mode("overwrite").option("maxRecordsPerFile", file_rows).partitionBy(
        *partitions
    ).parquet(path)
    return seen.get["rows"]


def read_or_none(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = location.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return spark.read.schema(schema).parquet(path) if files.exists(location) else None


def _with_partitions(schema: T.StructType, dated: bool) -> T.StructType:
    extra = [T.StructField(LOAD, T.StringType())]
    if dated:
        extra.append(T.StructField(EVENT_DATE, T.DateType()))
    return T.StructType([*schema.fields, *extra])


def read_loads(
    spark: SparkSession, root: str, table: str, schema: T.StructType, dated: bool = False
) -> DataFrame:
    """All loads of a fact table, with ``load_id`` (and ``event_date``) columns."""
    full = _with_partitions(schema, dated)
    found = read_or_none(spark, f"{root}/{table}", full)
    return spark.createDataFrame([], full) if found is None else found

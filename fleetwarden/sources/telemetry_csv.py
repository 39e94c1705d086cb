"""The wide telemetry feed, read from CSV."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetwarden.functions.risk import (
    MACHINE_TYPES,
    MAINTENANCE_TYPES,
    WORKLOADS,
    canonical_category,
)
from fleetwarden.schemas import TELEMETRY, TELEMETRY_HEADERS
from fleetwarden.sources.warehouse import FILE_ROWS

CORRUPT = "corrupt_record"
SOURCE_ORDER = ("source_file", "source_offset", "Reading_ID")
_CATEGORIES = {
    "Machine_Type": MACHINE_TYPES,
    "Workload": WORKLOADS,
    "Maintenance_Type": MAINTENANCE_TYPES,
}


def _file_schema(header: list[str]) -> T.StructType:
    """Schema in the order of the file's own header; columns are matched by name.

    Whole numbers are read as doubles, since files written by other tools carry them
    as ``1500.0`` when the column has gaps.
    """
    missing = [name for name in TELEMETRY_HEADERS if name not in header]
    if missing:
        raise ValueError(f"telemetry file lacks columns: {', '.join(missing)}")
    fields = []
    for name in header:
        known = TELEMETRY_HEADERS.get(name)
        kind = TELEMETRY[known].dataType if known else T.StringType()
        fields.append(T.StructField(name, T.DoubleType() if kind == T.IntegerType() else kind))
    return T.StructType([*fields, T.StructField(CORRUPT, T.StringType())])


def _cleaned(field: T.StructField, column: Column) -> Column:
    if field.dataType == T.IntegerType():
        return F.round(F.nanvl(column, F.lit(None))).cast("int")
    if field.dataType == T.DoubleType():
        return F.nanvl(column, F.lit(None))
    if field.name in _CATEGORIES:
        return canonical_category(column, _CATEGORIES[field.name])
    return column


def read_telemetry_csv(spark: SparkSession, path: str) -> DataFrame:
    """Telemetry rows under the table column names.

    Rows that do not fit the schema keep their text in ``corrupt_record`` and NULL in
    the columns that failed; the caller decides where they go.  ``source_file``,
    ``source_offset`` and ``Reading_ID`` give the order of rows in the input;
    ``Reading_ID`` alone is unique.
    """
    header = spark.read.option("header", True).csv(path).columns
    raw = (
        spark.read.schema(_file_schema(header))
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .csv(path)
    )
    columns = [
        _cleaned(TELEMETRY[known], F.col(f"`{name}`")).alias(known)
        for name, known in TELEMETRY_HEADERS.items()
    ]
    return raw.select(
        *columns,
        CORRUPT,
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("source_offset"),
        F.monotonically_increasing_id().alias("Reading_ID"),
    )


def write_telemetry_csv(telemetry: DataFrame, path: str, *folders: str) -> None:
    """Write telemetry rows as compressed CSV files with the header of the wide feed.

    Further columns named in ``folders`` deal the rows into ``<name>=<value>`` folders in the
    same pass.  Compressed files can't be split, so each is closed at ``FILE_ROWS`` rows.
    """
    named = [F.col(known).alias(name) for name, known in TELEMETRY_HEADERS.items()]
    writer = telemetry.select(*named, *folders).write.options(
        header=True,
        compression="gzip",
        maxRecordsPerFile=FILE_ROWS,
        timestampNTZFormat="yyyy-MM-dd HH:mm:ss.SSSSSS",
    )
    (writer.partitionBy(*folders) if folders else writer).csv(path)

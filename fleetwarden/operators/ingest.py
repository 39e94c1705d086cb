"""From the wide telemetry feed to the fleet tables."""

import posixpath
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetwarden import schemas
from fleetwarden.functions import risk
from fleetwarden.plans.joins import MACHINE
from fleetwarden.plans.rollups import hourly_sums
from fleetwarden.sources import warehouse
from fleetwarden.sources.bucketed import BucketedTable
from fleetwarden.sources.commit_log import Files
from fleetwarden.sources.loads import Load, LoadLog
from fleetwarden.sources.telemetry_csv import CORRUPT, SOURCE_ORDER, read_telemetry_csv

LOAD_ORDER = schemas.LOAD_ORDER

# Machine columns an incoming row replaces, NULLs included; Industry is not one.
REPLACED = [name for name in schemas.MACHINES.names if name not in (MACHINE, "Industry")]


def latest_rows(incoming: DataFrame, order: list[str]) -> DataFrame:
    """The last incoming row of each machine in the order of the ``order`` columns.

    ``order`` must be unique.  Partial aggregation leaves one row per machine and task
    before anything moves.
    """
    values = [F.col(c) for c in incoming.columns if c != MACHINE]
    last = F.max_by(F.struct(*values), F.struct(*order)).alias("_last")
    known = incoming.where(F.col(MACHINE).isNotNull())
    return known.groupBy(MACHINE).agg(last).select(MACHINE, "_last.*")


def upsert_machines(existing: DataFrame, incoming: DataFrame, order: list[str]) -> DataFrame:
    """Machines after inserting or updating from telemetry rows.

    The last row of a machine wins and its values replace the old ones even when
    NULL; the industry of a known machine survives.
    """
    needed = incoming.select(MACHINE, *REPLACED, *order)
    latest = latest_rows(needed, order).select(MACHINE, *REPLACED)
    both = existing.alias("old").join(
        latest.withColumn("_incoming", F.lit(True)).alias("new"), MACHINE, "full_outer"
    )
    merged = [
        F.when(F.col("_incoming"), F.col(f"new.{name}")).otherwise(F.col(f"old.{name}")).alias(name)
        for name in REPLACED
    ]
    return both.select(MACHINE, *merged, F.col("old.Industry").alias("Industry"))


def merge_load(existing: DataFrame, incoming: DataFrame, order: list[str], load: int) -> DataFrame:
    """``upsert_machines`` for the load of number ``load``, which may be run late or again.

    ``existing`` has ``Load_Order``, the number of the load that a row came from; the result has
    it too. Rows of later loads stay as they are.
    """
    latest = latest_rows(incoming.select(MACHINE, *REPLACED, *order), order)
    both = existing.alias("old").join(
        latest.select(MACHINE, *REPLACED, F.lit(load).cast("bigint").alias(LOAD_ORDER)).alias("new"),
        MACHINE,
        "full_outer",
    )
    # Neither number is null on its own side of the join.
    taken = F.coalesce(F.col(f"new.{LOAD_ORDER}") >= F.coalesce(f"old.{LOAD_ORDER}", F.lit(0)), F.lit(False))
    merged = [
        F.when(taken, F.col(f"new.{name}")).otherwise(F.col(f"old.{name}")).alias(name)
        for name in (*REPLACED, LOAD_ORDER)
    ]
    return both.select(MACHINE, *merged, F.col("old.Industry").alias("Industry"))


def assign_industry(machines: DataFrame) -> DataFrame:
    """Machines with the industry their id stands for."""
    return machines.withColumn("Industry", risk.industry(F.col(MACHINE)))


def apply_schedule_overrides(
    schedule: DataFrame, overrides: DataFrame, order: str = "Scheduled_Date"
) -> DataFrame:
    """Schedule with the dates of overridden machines replaced on all their rows.

    ``overrides`` has ``Machine_ID, Scheduled_Date``.  Of several rows of a machine the
    last by ``order`` counts, by default the latest date.
    """
    dates = overrides.groupBy(MACHINE).agg(F.max_by("Scheduled_Date", order).alias("_date"))
    return (
        schedule.join(dates, MACHINE, "left")
        .withColumn("Scheduled_Date", F.coalesce("_date", "Scheduled_Date"))
        .select(*schedule.columns)
    )


def keep_overrides(spark: SparkSession, root: str, overrides: DataFrame) -> int:
    """Keep schedule dates (``Machine_ID, Scheduled_Date``) that replace those of a warehouse.

    They hold for the jobs of the loads begun so far, those run again included, and not for
    what later loads bring. Of several dates of a machine the latest counts, and a machine's
    dates replace those kept before. Returns the number of rows written.
    """
    known = overrides.where(F.col(MACHINE).isNotNull())
    dates = known.groupBy(MACHINE).agg(F.max("Scheduled_Date").alias("Scheduled_Date"))
    latest = F.lit(LoadLog(spark, root).newest()).cast("bigint").alias(LOAD_ORDER)
    new = dates.where(F.col("Scheduled_Date").isNotNull()).select(MACHINE, "Scheduled_Date", latest)
    return override_table(spark, root).merge(
        new.select(MACHINE), lambda old: old.join(new, MACHINE, "left_anti").unionByName(new)
    )


def corrected_schedule(spark: SparkSession, root: str, schedule: DataFrame) -> DataFrame:
    """A warehouse's schedule, with its ``load_id``, under the overrides that hold for it."""
    kept = override_table(spark, root)
    if not kept.log.entries():
        return schedule
    dates = kept.read().select(
        MACHINE, F.col("Scheduled_Date").alias("_date"), F.col(LOAD_ORDER).alias("_up_to")
    )
    orders = LoadLog(spark, root).loads().select(warehouse.LOAD, F.col("load_order").alias("_order"))
    joined = schedule.join(orders, warehouse.LOAD, "left").join(dates, MACHINE, "left")
    # A load that the log doesn't know was there before it.
    holds = F.coalesce("_order", F.lit(0)) <= F.col("_up_to")
    date = F.when(holds, F.col("_date")).otherwise(F.col("Scheduled_Date"))
    return joined.withColumn("Scheduled_Date", date).select(*schedule.columns)


# Each of the following takes further columns to carry along, such as a key.


def to_sensor_data(telemetry: DataFrame, *extra: Column) -> DataFrame:
    measured = [n for n in schemas.SENSOR_DATA.names if n in schemas.TELEMETRY.names]
    return telemetry.select(*extra, *measured)


def to_failure_records(
    telemetry: DataFrame, *extra: Column, include_all: bool = False
) -> DataFrame:
    """Failure rows with missing downtime as 0; ``include_all`` keeps status 0 too."""
    rows = telemetry if include_all else telemetry.where(risk.is_critical())
    return rows.select(
        *extra,
        MACHINE,
        "Failure_Status",
        "Failure_Type",
        F.coalesce("Downtime", F.lit(0.0)).alias("Downtime"),
        "Predicted_Failure_Probability",
        "Predicted_Failure_Time",
    )


def to_maintenance_schedule(telemetry: DataFrame, *extra: Column) -> DataFrame:
    """One job per row with a maintenance date; gaps become Unknown and 0."""
    return telemetry.where(F.col("Last_Maintenance_Date").isNotNull()).select(
        *extra,
        MACHINE,
        F.col("Last_Maintenance_Date").alias("Scheduled_Date"),
        F.coalesce("Maintenance_Type", F.lit(risk.UNKNOWN)).alias("Maintenance_Type"),
        F.coalesce("Maintenance_Cost", F.lit(0.0)).alias("Estimated_Cost"),
        F.coalesce("Maintenance_Duration", F.lit(0.0)).alias("Estimated_Duration"),
    )


def to_anomaly_detection(telemetry: DataFrame, *extra: Column) -> DataFrame:
    return telemetry.select(*extra, MACHINE, "Timestamp", "Anomaly_Score", "Anomaly_Flag")


def to_health_indicators(telemetry: DataFrame, *extra: Column) -> DataFrame:
    return telemetry.select(
        *extra,
        MACHINE,
        "Timestamp",
        (1 - F.col("Anomaly_Score")).alias("Health_Score"),
        F.coalesce("Predicted_Failure_Probability", F.lit(0.0)).alias("Failure_Probability"),
    )


def to_failure_trends(telemetry: DataFrame) -> DataFrame:
    """Mean failure status per machine type and day; rows missing either are left out."""
    return (
        telemetry.where(F.col("Machine_Type").isNotNull() & F.col("Timestamp").isNotNull())
        .groupBy("Machine_Type", F.to_date("Timestamp").alias("Timestamp"))
        .agg(F.avg("Failure_Status").alias("Failure_Rate"))
    )


_STAGED = T.StructType(
    [
        *schemas.TELEMETRY.fields,
        T.StructField(CORRUPT, T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("source_offset", T.LongType()),
        T.StructField("Reading_ID", T.LongType()),
        T.StructField(warehouse.EVENT_DATE, T.DateType()),
    ]
)
_REPORT = "step int, table string, status string, rows bigint, error string"


def machine_table(spark: SparkSession, root: str) -> BucketedTable:
    return BucketedTable(spark, f"{root}/machines", schemas.STORED_MACHINES, MACHINE)


def override_table(spark: SparkSession, root: str) -> BucketedTable:
    return BucketedTable(spark, f"{root}/schedule_overrides", schemas.STORED_OVERRIDES, MACHINE)


def _default_load_id(path: str) -> str:
    return re.sub(r"[^A-Za-z0-9_.-]", "_", posixpath.basename(path.rstrip("/")))


def staged_telemetry(spark: SparkSession, root: str) -> DataFrame:
    """The telemetry rows of all loads, good and corrupt.

    Folders are not taken for partitions, since loads of before have one for each day.
    """
    folder = f"{root}/telemetry"
    if not Files(spark, folder).exists(folder):
        return warehouse.read_loads(spark, root, "telemetry", _STAGED)
    rows = spark.read.schema(_STAGED).option("recursiveFileLookup", True).parquet(folder)
    place = F.regexp_extract(F.col("_metadata.file_path"), f"/{warehouse.LOAD}=([^/]+)/", 1)
    load = F.url_decode(F.replace(place, F.lit("+"), F.lit("%2B"))).alias(warehouse.LOAD)
    day = F.to_date("Timestamp").alias(warehouse.EVENT_DATE)
    return rows.select(*[n for n in _STAGED.names if n != warehouse.EVENT_DATE], day, load)


def _stage(spark: SparkSession, csv_path: str, root: str, load_id: str) -> tuple[DataFrame, Load]:
    """Parse the CSV once into Parquet and return the staged rows, and the load in the log.

    The loads then read only the columns they need.  Rows are rebalanced by
    day, with large days split, so each file has few days and the daily partitions that the
    loads make of them get few and even files.  Files of bounded rows keep the tasks of the
    loads, and what they sort, bounded too; the wide rows themselves are not sorted.
    Reading ids lie in a range that the log of loads gives to this run alone.
    """
    feed = read_telemetry_csv(spark, csv_path)
    load = LoadLog(spark, root).begin(load_id, feed.rdd.getNumPartitions())
    numbered = feed.withColumn("Reading_ID", F.col("Reading_ID") + load.first_id).withColumn(
        warehouse.EVENT_DATE, F.to_date("Timestamp")
    )
    path = warehouse.load_path(root, "telemetry", load_id)
    warehouse.write_counted(
        numbered.hint("rebalance", warehouse.EVENT_DATE), path, file_rows=warehouse.FILE_ROWS
    )
    return spark.read.schema(_STAGED).parquet(path), load


def run_etl(
    spark: SparkSession,
    csv_path: str,
    root: str,
    load_id: str | None = None,
    include_all: bool = False,
) -> DataFrame:
    """Load a telemetry CSV into the warehouse folder ``root``.

    The tables are loaded in a fixed order and one that fails does not stop the
    next.  Returns a row per step: table, ``loaded`` or ``failed``, rows, error.
    Running the same ``load_id`` (by default the file name) again replaces its rows and keeps
    its place among the loads: machines that a later load brought stay as that load left them.
    """
    load_id = load_id or _default_load_id(csv_path)
    staged, load = _stage(spark, csv_path, root, load_id)
    bad, good = staged.where(F.col(CORRUPT).isNotNull()), staged.where(F.col(CORRUPT).isNull())
    day = F.col(warehouse.EVENT_DATE)

    def key(name: str) -> Column:
        return F.col("Reading_ID").alias(name)

    def write_machines() -> int:
        def merged(existing: DataFrame) -> DataFrame:
            rows = merge_load(existing, good, list(SOURCE_ORDER), load.order)
            return rows.withColumn("Industry", F.coalesce("Industry", risk.industry(F.col(MACHINE))))

        return machine_table(spark, root).merge(good.select(MACHINE), merged)

    loads = {
        "sensor_data": lambda: to_sensor_data(good, key("Sensor_ID"), day),
        "failure_records": lambda: to_failure_records(
            good, key("Failure_ID"), include_all=include_all
        ),
        "maintenance_schedule": lambda: to_maintenance_schedule(good, key("Maintenance_ID")),
        "anomaly_detection": lambda: to_anomaly_detection(good, key("Anomaly_ID"), day),
        "machine_health_indicators": lambda: to_health_indicators(good, key("Health_ID"), day),
        "failure_trends": lambda: to_failure_trends(good),
        "sensor_hourly": lambda: hourly_sums(good).withColumn(warehouse.EVENT_DATE, F.col("_day")),
        "quarantine": lambda: bad.select(CORRUPT, "source_file", "Reading_ID"),
    }

    def append(table: str) -> int:
        rows = loads[table]()
        dated = [warehouse.EVENT_DATE] if warehouse.EVENT_DATE in rows.columns else []
        return warehouse.write_counted(rows, warehouse.load_path(root, table, load_id), *dated)

    report = []
    for step, table in enumerate(["machines", *loads], start=1):
        try:
            rows = write_machines() if table == "machines" else append(table)
            report.append((step, table, "loaded", rows, None))
        except Exception as error:  # one failed load must not stop the next
            report.append((step, table, "failed", None, str(error)))
    LoadLog(spark, root).finish(load, all(r[2] == "loaded" for r in report))
    return spark.createDataFrame(report, _REPORT)

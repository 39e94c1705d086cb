"""The set of DataFrames the report operators read."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from fleetwarden import schemas
from fleetwarden.operators.ingest import corrected_schedule
from fleetwarden.sources import warehouse
from fleetwarden.sources.bucketed import BucketedTable

STORED = {
    "machines": schemas.MACHINES,
    "sensor_data": schemas.SENSOR_DATA,
    "failure_records": schemas.FAILURE_RECORDS,
    "maintenance_schedule": schemas.MAINTENANCE_SCHEDULE,
    "machine_health_indicators": schemas.MACHINE_HEALTH_INDICATORS,
    "maintenance_effectiveness": schemas.MAINTENANCE_EFFECTIVENESS,
}

DATED = ("sensor_data", "machine_health_indicators")


@dataclass(frozen=True)
class Tables:
    """One DataFrame per fleet table."""

    machines: DataFrame
    sensor_data: DataFrame
    failure_records: DataFrame
    maintenance_schedule: DataFrame
    machine_health_indicators: DataFrame
    maintenance_effectiveness: DataFrame
    #: Hourly sums of the readings, where loads keep them; see ``plans.rollups``.
    sensor_hourly: DataFrame | None = None

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str) -> "Tables":
        """Read every table from ``root/<table>``; partition columns are kept."""
        return cls(**{name: spark.read.parquet(f"{root}/{name}") for name in STORED})

    @classmethod
    def empty(cls, spark: SparkSession, **given: DataFrame) -> "Tables":
        """Empty tables with the fixed schemas, except for those ``given``."""
        missing = {n: spark.createDataFrame([], s) for n, s in STORED.items() if n not in given}
        return cls(**(missing | given))

    @classmethod
    def from_warehouse(cls, spark: SparkSession, root: str) -> "Tables":
        """The tables as :func:`fleetwarden.operators.ingest.run_etl` writes them.

        ``maintenance_effectiveness``, which no feed fills, is read where it is there.
        """
        loads = {
            name: warehouse.read_loads(spark, root, name, _without_sensor_name(schema), name in DATED)
            for name, schema in STORED.items()
            if name not in ("machines", "maintenance_effectiveness")
        }
        loads["sensor_hourly"] = warehouse.read_loads(
            spark, root, "sensor_hourly", schemas.SENSOR_HOURLY, dated=True
        )
        schedule = loads["maintenance_schedule"]
        loads["maintenance_schedule"] = corrected_schedule(spark, root, schedule)
        stored = BucketedTable(spark, f"{root}/machines", schemas.STORED_MACHINES, "Machine_ID")
        machines = stored.read().select(*schemas.MACHINES.names)
        name = "maintenance_effectiveness"
        measured = warehouse.read_or_none(spark, f"{root}/{name}", STORED[name])
        if measured is not None:
            loads[name] = measured
        return cls.empty(spark, machines=machines, **loads)


def _without_sensor_name(schema: T.StructType) -> T.StructType:
    """The telemetry feed does not name the sensor."""
    return T.StructType([field for field in schema if field.name != "Sensor_Name"])

"""Telemetry stream to the sensor, anomaly and health tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from fleetwarden.operators.ingest import to_anomaly_detection, to_health_indicators, to_sensor_data
from fleetwarden.sources.warehouse import EVENT_DATE
from fleetwarden.streaming.hourly import HOUR, with_event_time

BATCH = "load_id"
KEYS = {
    "sensor_data": "Sensor_ID",
    "anomaly_detection": "Anomaly_ID",
    "machine_health_indicators": "Health_ID",
}
TABLES: dict[str, Callable[..., DataFrame]] = {
    "sensor_data": to_sensor_data,
    "anomaly_detection": to_anomaly_detection,
    "machine_health_indicators": to_health_indicators,
}


def without_repeats(
    telemetry: DataFrame, late_by: str = HOUR, delivery: list[str] | None = None
) -> DataFrame:
    """Each row once, however often it is delivered within the lateness.

    ``delivery`` names the columns by which the source tells deliveries apart; without
    it rows are repeats when all their columns agree.  State is keyed by these columns, as a
    digest of 128 bits, so one busy machine spreads over all partitions and a row is 16 bytes
    of the key in the state, however wide it is.
    """
    # A hash passes nulls over, so it is told where they are.
    parts = [part for c in delivery or telemetry.columns for part in (F.col(c), F.isnull(c))]
    digest = {f"_digest{n}": F.xxhash64(F.lit(n), *parts) for n in range(2)}
    timed = with_event_time(telemetry, late_by).withColumns(digest)
    return timed.dropDuplicatesWithinWatermark(list(digest)).drop("event_time", *digest)


def load_stream(
    telemetry: DataFrame, root: str, late_by: str = HOUR, delivery: list[str] | None = None
) -> DataStreamWriter:
    """A writer that adds every micro-batch to the three tables below ``root``.

    A batch writes its own ``load_id`` folder, named by the query's id and its number, and
    replaces it when it is run again after a failure, so no row is lost or doubled.  The
    id is kept in the checkpoint: a query with a new one adds its own folders.  Rows get
    a key from the hash of their values.  The caller sets the checkpoint location and the
    trigger and starts it.
    """
    values = telemetry.columns

    def write(batch: DataFrame, batch_id: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        key = F.xxhash64(*values)
        rows = batch.withColumns({"_key": key, EVENT_DATE: F.to_date("Timestamp")}).persist()
        try:
            for table, make in TABLES.items():
                made = make(rows, F.col("_key").alias(KEYS[table]), F.col(EVENT_DATE))
                made.write.mode("overwrite").partitionBy(
                    EVENT_DATE
                ).parquet(f"{root}/{table}/{BATCH}=stream-{query}-{batch_id}")
        finally:
            rows.unpersist()

    return without_repeats(telemetry, late_by, delivery).writeStream.foreachBatch(write)

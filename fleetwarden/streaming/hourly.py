"""Hourly sensor averages over a stream of readings."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwarden.plans.joins import MACHINE

HOUR = "1 hour"


def with_event_time(readings: DataFrame, late_by: str) -> DataFrame:
    """Readings with a watermark on ``event_time``, the instant form of ``Timestamp``.

    Watermarks need an instant; the zoneless timestamp is read in the session zone.
    """
    return readings.withColumn("event_time", F.col("Timestamp").cast("timestamp")).withWatermark(
        "event_time", late_by
    )


def hourly_sensor_averages(
    readings: DataFrame,
    sensors: list[str],
    machines: DataFrame | None = None,
    late_by: str = HOUR,
) -> DataFrame:
    """Average of each sensor per hour, and per machine type when ``machines`` is given.

    The machine table is joined as a static side, after the readings of an hour are summed
    by machine: a busy machine is one row an hour when it moves for the join.  Both sides are
    shuffled: a stream has no adaptive execution to see how large the table is, and a broadcast
    would pass all of it through the driver in every batch.  In append mode an hour is emitted
    once the watermark has passed its end.
    """
    timed = with_event_time(readings, late_by)
    hour = F.window("event_time", HOUR).alias("hour")
    count = F.count(F.lit(1)).alias("readings")
    keys = []
    if machines is None:
        averaged = timed.groupBy(hour).agg(*[F.avg(s).alias(s) for s in sensors], count)
    else:
        keys = ["Machine_Type"]
        sums = [F.struct(F.sum(s).alias("sum"), F.count(s).alias("n")).alias(s) for s in sensors]
        by_machine = timed.groupBy(hour, MACHINE).agg(*sums, count)
        typed = by_machine.join(machines.select(MACHINE, *keys).hint("merge"), MACHINE)
        averages = [F.try_divide(F.sum(f"{s}.sum"), F.sum(f"{s}.n")).alias(s) for s in sensors]
        averaged = typed.groupBy("hour", *keys).agg(*averages, F.sum("readings").alias("readings"))
    return averaged.select(
        F.col("hour.start").cast("timestamp_ntz").alias("hour"), *keys, *sensors, "readings"
    )

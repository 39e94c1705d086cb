"""Hourly sums and counts by machine, which loads keep and reports over all history add up.

Sums and counts of two loads add up to those of both, so a report over stored hours reads a
few rows for each machine and hour in place of its readings.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwarden.functions.time_buckets import HOUR_KEYS, hour_keys
from fleetwarden.plans.day_filters import PARTITION
from fleetwarden.plans.joins import MACHINE
from fleetwarden.schemas import ROLLED


def hourly_sums(readings: DataFrame, sensors: tuple[str, ...] = ROLLED) -> DataFrame:
    """Machine, day, hour, and ``sum_`` and ``count_`` of each sensor."""
    return readings.groupBy(MACHINE, *hour_keys("Timestamp")).agg(
        *[F.sum(s).alias(f"sum_{s}") for s in sensors],
        *[F.count(s).alias(f"count_{s}") for s in sensors],
    )


def mean(sensor: str) -> Column:
    """The average of a sensor over hours that are grouped together."""
    return F.try_divide(F.sum(f"sum_{sensor}"), F.sum(f"count_{sensor}"))


def latest_hours(hours: DataFrame) -> DataFrame:
    """The hours of the newest day, from the day partition where there is one."""
    day = PARTITION if PARTITION in hours.columns else HOUR_KEYS[0]
    newest = hours.agg(F.max(day).alias("d")).scalar()
    return hours.where(F.col(day) == newest)

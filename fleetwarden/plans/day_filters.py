"""Time filters on readings that reach the file scan.

The bounds stay half-open ranges on the raw column, so they are pushed to Parquet.
Tables stored with an ``event_date`` partition get the same bound on it, so whole
days are skipped without opening a file.
"""

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTITION = "event_date"


def since(readings: DataFrame, start: Column) -> DataFrame:
    """Readings at or after ``start``."""
    if PARTITION in readings.columns:
        readings = readings.where(F.col(PARTITION) >= F.to_date(start))
    return readings.where(F.col("Timestamp") >= start)


def latest_day(readings: DataFrame) -> DataFrame:
    """Readings of the newest date present.

    The date is a scalar subquery over one column (only partition values where the
    table has them); no reading is later than it, so a lower bound is enough.
    """
    if PARTITION in readings.columns:
        newest = readings.agg(F.max(PARTITION).alias("d")).scalar()
        return readings.where(F.col(PARTITION) == newest)
    newest = readings.agg(F.to_date(F.max("Timestamp")).alias("d")).scalar()
    return readings.where(F.col("Timestamp") >= newest)


def newest_days(readings: DataFrame, wanted: int) -> DataFrame:
    """Readings of the newest days that together hold ``wanted`` rows, for a top list.

    Only tables with the day partition are cut down.  Rows per day are counted first,
    which opens no column of ``readings``.  With fewer than ``wanted`` rows every day is kept, and so are
    rows without a time.
    """
    if PARTITION not in readings.columns:
        return readings
    per_day = readings.where(F.col(PARTITION).isNotNull()).groupBy(PARTITION).agg(
        F.count(F.lit(1)).alias("_rows")
    )
    # One row per day: the window grows with time, not with the readings.
    so_far = F.sum("_rows").over(Window.orderBy(F.desc(PARTITION)))
    cut = per_day.withColumn("_so_far", so_far).where(F.col("_so_far") >= wanted)
    oldest = cut.agg(F.max(PARTITION).alias("d")).scalar()
    return readings.where(oldest.isNull() | (F.col(PARTITION) >= oldest))


def newest_days_with(readings: DataFrame, wanted: int, known: DataFrame, key: str) -> DataFrame:
    """Readings of the newest days that hold ``wanted`` rows whose ``key`` is in ``known``.

    Walks down from the newest day while the DataFrame is built, twice as many days each time,
    and counts up to ``wanted`` rows in them, so no column of older days is opened. What is
    returned has the days as a plain bound on the partition. Where all days together hold too
    few rows, all are returned, those without a time included.
    """
    if PARTITION not in readings.columns:
        return readings
    oldest, newest = readings.agg(F.min(PARTITION), F.max(PARTITION)).first()
    days = 1
    while newest is not None:
        first = newest - timedelta(days=days - 1)
        if first <= oldest:
            break
        recent = readings.where(F.col(PARTITION) >= F.lit(first))
        if recent.select(key).join(known.select(key), key, "left_semi").limit(wanted).count() >= wanted:
            return recent
        days *= 2
    return readings

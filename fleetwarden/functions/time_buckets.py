"""Hour, day and month buckets.

Grouping happens on typed values (dates and small integers); the text label is
made once per group, after the aggregation.  None of these depend on the session
time zone when the column is a date or a zoneless timestamp.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_KEYS = ("_day", "_hour")


def hour_keys(timestamp: str) -> list[Column]:
    """Grouping columns of an hourly bucket, named as in ``HOUR_KEYS``."""
    return [F.to_date(timestamp).alias("_day"), F.hour(timestamp).alias("_hour")]


def hour_label() -> Column:
    """``yyyy-MM-dd HH:00:00`` text of the bucket made by :func:`hour_keys`."""
    hour = F.lpad(F.col("_hour").cast("string"), 2, "0")
    return F.concat(F.col("_day").cast("string"), F.lit(" "), hour, F.lit(":00:00"))


def day_label(day: str | Column) -> Column:
    """``yyyy-MM-dd`` text of a date."""
    column = F.col(day) if isinstance(day, str) else day
    return column.cast("date").cast("string")


def month_start(moment: str | Column) -> Column:
    return F.trunc(F.to_date(moment), "month")


def month_label(first_day: str | Column) -> Column:
    """``yyyy-MM`` text of a month bucket."""
    return F.substring(day_label(first_day), 1, 7)

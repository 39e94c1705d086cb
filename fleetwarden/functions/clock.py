"""The "as of" clock of a report: a pinned value, or now."""

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

AsOf = Column | date | datetime | str | None


def day(as_of: AsOf = None) -> Column:
    """``as_of`` as a DATE column; today when not given."""
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, Column):
        return as_of.cast("date")
    return F.lit(str(as_of)).cast("date")


def instant(as_of: AsOf = None) -> Column:
    """``as_of`` as a zoneless timestamp column; now when not given."""
    if as_of is None:
        return F.localtimestamp()
    if isinstance(as_of, Column):
        return as_of.cast("timestamp_ntz")
    return F.lit(str(as_of)).cast("timestamp_ntz")

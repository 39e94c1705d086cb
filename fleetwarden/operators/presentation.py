"""What the screens do with report rows: filter, page, summarise, fill a calendar."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetwarden.functions.clock import AsOf, day
from fleetwarden.functions.risk import gauge_band
from fleetwarden.plans.joins import MACHINE
from fleetwarden.plans.workspace import fresh_folder

CARDS = 5

# Order in which each report is shown: column and direction (fixed values).
DISPLAY_ORDER = {
    "failure_records_enriched": [("Predicted_Failure_Time", "desc")],
    "maintenance_schedule_upcoming_enriched": [("Scheduled_Date", "asc")],
    "failure_trends_monthly": [("Month", "asc")],
    "mtbf_monthly": [("timestamp", "asc")],
    "failure_probability_by_days_since_maintenance": [("time_since_maintenance", "asc")],
    "failures_daily": [("day", "asc")],
    "failure_probability_series": [("x", "asc")],
    "failure_detection_series": [("x", "asc")],
    "sensor_trends_hourly_failed_machines": [("timestamp", "asc")],
    "upcoming_maintenance": [("Scheduled_Date", "asc")],
    "maintenance_calendar": [("Scheduled_Date", "asc")],
    "maintenance_duration_histogram": [("label", "asc")],
    "maintenance_backlog": [("Predicted_Failure_Probability", "desc")],
    "maintenance_cost_monthly": [("month", "asc")],
    "pressure_trend_latest_day": [("Hourly_Timestamp", "asc")],
    "failure_probability_by_temperature": [("Temperature", "asc")],
    "workload_failure_rates": [("Workload", "asc")],
    "vibration_heatmap": [("Hourly_Timestamp", "asc"), ("Machine_Type", "asc")],
    "sensor_feature_means": [("importance", "desc")],
    "temperature_daily": [("Date", "asc")],
    "anomaly_hourly": [("hour", "asc")],
}


def in_display_order(report: DataFrame, name: str) -> DataFrame:
    """The rows of report ``name`` in the order it is shown.

    Reports themselves are unsorted: a global sort is a shuffle only a reader of the
    whole list needs.  Reports shown in no particular order are returned as they are.
    """
    order = DISPLAY_ORDER.get(name)
    if order is None:
        return report
    return report.orderBy(*[getattr(F, direction)(column) for column, direction in order])


def with_position(report: DataFrame, name: str) -> DataFrame:
    """The rows of report ``name`` with ``position``, from 1, in the order it is shown.

    Rows that the display order leaves equal follow the other columns. Rows are sorted in
    ranges, written once to the work folder with their place in the range, and moved up by the
    number of rows in the ranges before, a row for each range; no task sees the whole list.
    """
    shown = [(c, d) for c, d in DISPLAY_ORDER.get(name, [])]
    rest = [(c, "asc") for c in report.columns if c not in dict(shown)]
    order = [getattr(F, direction)(column) for column, direction in [*shown, *rest]]
    spark = report.sparkSession
    folder = fresh_folder(spark, "display-order")
    ranges = report.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = ranges.withColumn("_place", F.monotonically_increasing_id())
    placed.write.parquet(folder)
    placed = spark.read.schema(placed.schema).parquet(folder)
    # The id holds the range in its upper bits and counts from 0 in the lower 33.
    split = placed.withColumn("_range", F.shiftright("_place", 33)).withColumn(
        "_place", F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    )
    sizes = split.groupBy("_range").agg((F.max("_place") + 1).alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    known = F.map_from_entries(F.collect_list(F.struct("_range", "_offset")))
    listed = offsets.agg(known.alias("known"), F.max("_range").alias("top")).select(
        F.transform(
            F.sequence(F.lit(0).cast("bigint"), "top"),
            lambda i: F.coalesce(F.try_element_at("known", i), F.lit(0).cast("bigint")),
        )
    )
    # One value for the whole plan, an entry for each range.
    offset = F.get(listed.scalar(), F.col("_range").cast("int"))
    return split.select((offset + F.col("_place") + 1).alias("position"), *report.columns)


def only(report: DataFrame, column: str, choice: str = "all") -> DataFrame:
    """Rows with the chosen value; ``all`` keeps every row."""
    return report if choice == "all" else report.where(F.col(column) == choice)


def page(report: DataFrame, order: list[str | Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows, with column ``has_next``.

    ``order`` must order rows fully.  One row more than the page is fetched to know
    whether there is a next page; the window runs over those ``size + 1`` rows.  Tasks
    keep as many rows as lie up to the end of the page, which suits a pager: to export
    a whole report, write it in display order instead of walking its pages.
    """
    fetched = report.orderBy(*order).offset((number - 1) * size).limit(size + 1)
    whole = Window.orderBy(*order)
    return (
        fetched.withColumn("_place", F.row_number().over(whole))
        .withColumn("has_next", F.max("_place").over(Window.partitionBy()) > size)
        .where(F.col("_place") <= size)
        .drop("_place")
    )


def page_after(report: DataFrame, order: list[str], after: dict | None, size: int) -> DataFrame:
    """The ``size`` rows that follow the row ``after``, with column ``has_next``.

    ``order`` names columns that order rows fully, ascending with nulls first; ``after`` holds
    their values in the last row shown, None for the first page. The rows before it are left
    out by a filter, which reaches the scan where the columns are stored ones, and a task keeps
    ``size + 1`` rows whichever page it is.
    """
    rest = report
    if after is not None:
        kinds = {f.name: f.dataType for f in report.schema}
        same, later = F.lit(True), F.lit(False)
        for name in order:
            value = F.lit(after[name]).cast(kinds[name])
            greater = F.col(name).isNotNull() if after[name] is None else F.col(name) > value
            later = later | (same & greater)
            same = same & F.col(name).eqNullSafe(value)
        # The first column alone is a bound that a scan can use.
        first = order[0]
        bound = F.lit(True) if after[first] is None else F.col(first) >= F.lit(after[first]).cast(kinds[first])
        rest = report.where(bound).where(F.coalesce(later, F.lit(False)))
    fetched = rest.orderBy(*order).limit(size + 1)
    whole = Window.orderBy(*order)
    return (
        fetched.withColumn("_place", F.row_number().over(whole))
        .withColumn("has_next", F.max("_place").over(Window.partitionBy()) > size)
        .where(F.col("_place") <= size)
        .drop("_place")
    )


def schedule_summary(upcoming: DataFrame) -> DataFrame:
    """Number of upcoming jobs: all, preventive, corrective."""
    kind = F.col("Maintenance_Type")
    return upcoming.agg(
        F.count(F.lit(1)).alias("total_scheduled"),
        F.count_if(kind == "Preventive").alias("preventive_count"),
        F.count_if(kind == "Corrective").alias("corrective_count"),
    )


def schedule_cards(upcoming: DataFrame, count: int = CARDS) -> DataFrame:
    """The first upcoming jobs."""
    return upcoming.orderBy(
        "Scheduled_Date", MACHINE, "Maintenance_Type", "Estimated_Cost", "Estimated_Duration"
    ).limit(count)


def shares(groups: DataFrame, label: str, value: str) -> DataFrame:
    """Each group's part of the total, as pie slices."""
    total = groups.agg(F.sum(value).alias("total")).scalar()
    return groups.select(
        F.col(label).alias("label"),
        F.col(value).alias("value"),
        F.try_divide(F.col(value).cast("double"), total.cast("double")).alias("share"),
    )


def with_gauge_band(report: DataFrame, value: str) -> DataFrame:
    """Adds the gauge band of a 0..100 value."""
    return report.withColumn("band", gauge_band(F.col(value)))


def box_summary(report: DataFrame, value: str) -> DataFrame:
    """Five-number summary of a report column.

    Exact percentiles gather the distinct values, so this is for aggregated reports
    such as one row per hour, not for raw readings.
    """
    quartiles = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return report.agg(
        F.min(value).alias("lowest"), quartiles.alias("_q"), F.max(value).alias("highest")
    ).select(
        "lowest",
        F.col("_q")[0].alias("q1"),
        F.col("_q")[1].alias("median"),
        F.col("_q")[2].alias("q3"),
        "highest",
    )


def calendar_month(schedule: DataFrame, month: AsOf) -> DataFrame:
    """Every day of a month with its first job, if any.

    Jobs of a day are reduced by a minimum, so a busy day is no larger than others.
    """
    first = F.trunc(day(month), "month")
    last = F.last_day(first)
    detail = (MACHINE, "Maintenance_Type", "Estimated_Cost", "Estimated_Duration")
    events = (
        schedule.where(F.col("Scheduled_Date").between(first, last))
        .groupBy("Scheduled_Date")
        .agg(F.min(F.struct(*detail)).alias("_event"))
    )
    days = schedule.sparkSession.range(1).select(
        F.explode(F.sequence(first, last, F.expr("interval 1 day"))).alias("day")
    )
    return days.join(events, F.col("day") == F.col("Scheduled_Date"), "left").select(
        "day",
        F.col("_event").isNotNull().alias("has_event"),
        *[F.col(f"_event.{name}").alias(name) for name in detail],
    )

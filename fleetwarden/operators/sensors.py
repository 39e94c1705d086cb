"""Sensor reports: feeds, trends, summaries of the latest day."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwarden.functions.clock import AsOf, instant
from fleetwarden.functions.risk import is_critical, percent
from fleetwarden.functions.time_buckets import HOUR_KEYS, day_label, hour_keys, hour_label
from fleetwarden.plans.day_filters import latest_day, newest_days, newest_days_with, since
from fleetwarden.plans.joins import MACHINE, rows_matching, with_dimension
from fleetwarden.plans.rollups import hourly_sums, latest_hours, mean
from fleetwarden.tables import Tables

FEED_ROWS = 100
HEALTH_ROWS = 50
TREND_SENSORS = ("Temperature", "Vibration", "Pressure", "Humidity", "Power_Consumption")
MEASURED = (
    "Temperature",
    "Vibration",
    "Pressure",
    "Humidity",
    "Voltage",
    "Current",
    "Power_Consumption",
    "Ambient_Temperature",
    "Ambient_Humidity",
)
COMPARED_SENSORS = ("Pressure", "Temperature", "Vibration")


def _stored_hours(t: Tables) -> DataFrame | None:
    """The hourly sums that loads keep, where the tables come from a warehouse."""
    return t.sensor_hourly


def sensor_recent(t: Tables) -> DataFrame:
    """The latest readings."""
    return (
        newest_days(t.sensor_data, FEED_ROWS)
        .orderBy(F.desc("Timestamp"), F.desc("Sensor_ID"))
        .limit(FEED_ROWS)
        .select(
            MACHINE,
            "Timestamp",
            "Temperature",
            "Vibration",
            "Pressure",
            "Humidity",
            "Power_Consumption",
            "Anomaly_Score",
            "Anomaly_Flag",
        )
    )


def health_indicators_recent(t: Tables) -> DataFrame:
    """The latest health rows of known machines."""
    health = newest_days_with(t.machine_health_indicators, HEALTH_ROWS, t.machines, MACHINE)
    return (
        with_dimension(health, t.machines, ["Machine_Type"])
        .orderBy(F.desc("Timestamp"), F.desc("Health_ID"))
        .limit(HEALTH_ROWS)
        .select(MACHINE, "Machine_Type", "Health_Score", "Failure_Probability", "Timestamp")
    )


def sensor_trends_hourly_failed_machines(t: Tables) -> DataFrame:
    """Hourly sensor averages over machines that ever failed, one row per sensor.

    Readings shrink to one row per machine and hour before they meet the ids.
    """
    failed = t.failure_records.where(is_critical()).select(MACHINE).distinct()
    hours = _stored_hours(t)
    if hours is None:
        hours = hourly_sums(t.sensor_data, TREND_SENSORS)
    measured = hours.join(failed, MACHINE, "left_semi")
    hourly = measured.groupBy(*HOUR_KEYS).agg(*[mean(s).alias(s) for s in TREND_SENSORS])
    return (
        hourly.withColumn("timestamp", hour_label())
        .unpivot("timestamp", list(TREND_SENSORS), "name", "value")
        .select("name", "timestamp", "value")
    )


def temperature_last_day(t: Tables, as_of: AsOf = None) -> DataFrame:
    """Average, lowest and highest temperature of the day up to ``as_of``."""
    start = instant(as_of) - F.expr("interval 1 day")
    return since(t.sensor_data, start).agg(
        F.coalesce(F.avg("Temperature"), F.lit(0.0)).alias("average_temperature"),
        F.coalesce(F.min("Temperature"), F.lit(0.0)).alias("min_temperature"),
        F.coalesce(F.max("Temperature"), F.lit(100.0)).alias("max_temperature"),
    )


def sensor_contribution(t: Tables) -> DataFrame:
    """Average anomaly score in percent per sensor.

    A loaded feed has a column for each sensor instead of a sensor name; there a reading
    counts for every sensor that it has a value of.
    """
    if "Sensor_Name" not in t.sensor_data.columns:
        scored = [F.when(F.col(s).isNotNull(), F.col("Anomaly_Score")) for s in MEASURED]
        means = t.sensor_data.agg(*[percent(F.avg(c)).alias(s) for c, s in zip(scored, MEASURED)])
        return means.unpivot([], list(MEASURED), "x", "y")
    return t.sensor_data.groupBy(F.col("Sensor_Name").alias("x")).agg(
        percent(F.avg("Anomaly_Score")).alias("y")
    )


def temperature_anomaly_impact(t: Tables) -> DataFrame:
    """Average anomaly score in percent per temperature."""
    return t.sensor_data.groupBy(F.col("Temperature").alias("x")).agg(
        percent(F.avg("Anomaly_Score")).alias("y")
    )


def pressure_trend_latest_day(t: Tables) -> DataFrame:
    """Hourly average pressure on the newest date."""
    hours = _stored_hours(t)
    if hours is None:
        means = latest_day(t.sensor_data).groupBy(*hour_keys("Timestamp")).agg(
            F.avg("Pressure").alias("Average_Pressure")
        )
    else:
        means = latest_hours(hours).groupBy(*HOUR_KEYS).agg(mean("Pressure").alias("Average_Pressure"))
    return means.select(hour_label().alias("Hourly_Timestamp"), "Average_Pressure")


def failure_probability_by_temperature(t: Tables) -> DataFrame:
    """Average probability over the (reading, critical record) pairs of a machine.

    Critical records are summed per machine first; each reading then contributes its
    machine's sum and count, which weighs the average as the pairs would.
    """
    failures = (
        t.failure_records.where(is_critical())
        .groupBy(MACHINE)
        .agg(
            F.sum("Predicted_Failure_Probability").alias("_total"),
            F.count("Predicted_Failure_Probability").cast("double").alias("_known"),
        )
    )
    readings = rows_matching(t.sensor_data, failures, [F.col("Temperature")])
    weight = F.col("_rows")
    return readings.groupBy("Temperature").agg(
        F.try_divide(F.sum(weight * F.col("_total")), F.sum(weight * F.col("_known"))).alias(
            "Failure_Probability"
        )
    )


def vibration_heatmap(t: Tables) -> DataFrame:
    """Average vibration by hour and machine type on the newest date; gaps are 0."""
    hours = _stored_hours(t)
    if hours is None:
        readings = latest_day(t.sensor_data).select(MACHINE, "Vibration", *hour_keys("Timestamp"))
        average = F.avg("Vibration")
    else:
        readings, average = latest_hours(hours), mean("Vibration")
    cells = (
        with_dimension(readings, t.machines, ["Machine_Type"])
        .groupBy(*HOUR_KEYS, "Machine_Type")
        .agg(average.alias("_average"), F.lit(True).alias("_present"))
    )
    # Structs keep a NULL machine type in the set of types.
    types = cells.agg(F.collect_set(F.struct("Machine_Type")).alias("types")).scalar()
    grid = cells.select(*HOUR_KEYS).distinct().select(*HOUR_KEYS, F.inline(types))
    same_cell = (
        (F.col("g._day") == F.col("c._day"))
        & (F.col("g._hour") == F.col("c._hour"))
        & F.col("g.Machine_Type").eqNullSafe(F.col("c.Machine_Type"))
    )
    return (
        grid.alias("g")
        .join(cells.alias("c"), same_cell, "left")
        .select("g._day", "g._hour", "g.Machine_Type", "c._average", "c._present")
        .select(
            hour_label().alias("Hourly_Timestamp"),
            "Machine_Type",
            F.when(F.col("_present"), F.col("_average")).otherwise(0.0).alias("Average_Vibration"),
        )
    )


def sensor_feature_means(t: Tables) -> DataFrame:
    """Mean of the compared sensors, one row each, from one scan."""
    return t.sensor_data.agg(*[F.avg(s).alias(s) for s in COMPARED_SENSORS]).unpivot(
        [], list(COMPARED_SENSORS), "feature", "importance"
    )


def temperature_daily(t: Tables) -> DataFrame:
    """Mean temperature per day."""
    hours = _stored_hours(t)
    if hours is None:
        days = t.sensor_data.groupBy(F.to_date("Timestamp").alias("_day")).agg(
            F.avg("Temperature").alias("ForecastedValue")
        )
    else:
        days = hours.groupBy("_day").agg(mean("Temperature").alias("ForecastedValue"))
    return days.select(day_label("_day").alias("Date"), "ForecastedValue")


def anomaly_hourly(t: Tables) -> DataFrame:
    """Mean anomaly score per hour."""
    hours = _stored_hours(t)
    if hours is None:
        scored = t.sensor_data.where(F.col("Anomaly_Score").isNotNull())
        means = scored.groupBy(*hour_keys("Timestamp")).agg(F.avg("Anomaly_Score").alias("anomaly_score"))
    else:
        scored = hours.where("count_Anomaly_Score > 0")
        means = scored.groupBy(*HOUR_KEYS).agg(mean("Anomaly_Score").alias("anomaly_score"))
    return means.select(hour_label().alias("hour"), "anomaly_score")

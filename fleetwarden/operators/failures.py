"""Failure reports: rates, trends, top lists, distributions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwarden.functions.clock import AsOf, day
from fleetwarden.functions.risk import is_critical, is_warning, percent, risk_level
from fleetwarden.functions.time_buckets import day_label, month_label, month_start
from fleetwarden.plans.joins import MACHINE, average_by_dimension, with_dimension
from fleetwarden.tables import Tables

PROBABILITY = "Predicted_Failure_Probability"
FAILURE_TIME = "Predicted_Failure_Time"
TOP = 5


def failure_records_enriched(t: Tables) -> DataFrame:
    """Failure records with the type of their machine."""
    records = t.failure_records.select(
        MACHINE, "Failure_Type", "Downtime", PROBABILITY, FAILURE_TIME
    )
    return with_dimension(records, t.machines, ["Machine_Type"]).select(
        MACHINE, "Machine_Type", "Failure_Type", "Downtime", PROBABILITY, FAILURE_TIME
    )


def failure_trends_monthly(t: Tables) -> DataFrame:
    """Share of records that are failures, in percent, by month of predicted failure."""
    return (
        t.failure_records.where(F.col(FAILURE_TIME).isNotNull())
        .groupBy(month_start(FAILURE_TIME).alias("_month"))
        .agg((F.avg("Failure_Status") * 100).alias("Failure_Rate"))
        .select(month_label("_month").alias("Month"), "Failure_Rate")
    )


def failure_rate_by_machine_type(t: Tables) -> DataFrame:
    rates = average_by_dimension(
        t.failure_records, t.machines, "Failure_Status", F.col("Machine_Type"), "Machine_Type"
    )
    return rates.select(
        F.col("_key").alias("Machine_Type"), percent(F.col("_average")).alias("failure_rate")
    )


def failure_probability_by_days_since_maintenance(t: Tables, as_of: AsOf = None) -> DataFrame:
    """Average failure probability in percent by days since the last maintenance."""
    maintained = t.machines.where(F.col("Last_Maintenance_Date").isNotNull())
    rates = average_by_dimension(
        t.failure_records,
        maintained,
        PROBABILITY,
        F.date_diff(day(as_of), "Last_Maintenance_Date"),
        "Last_Maintenance_Date",
    )
    return rates.select(
        F.col("_key").alias("time_since_maintenance"),
        percent(F.col("_average")).alias("failure_probability"),
    )


def optimal_maintenance_interval(t: Tables, as_of: AsOf = None) -> DataFrame:
    """The same measure as points ``x, y``."""
    return failure_probability_by_days_since_maintenance(t, as_of).toDF("x", "y")


def failures_daily(t: Tables) -> DataFrame:
    """Records per day of predicted failure."""
    return (
        t.failure_records.where(F.col(FAILURE_TIME).isNotNull())
        .groupBy(F.to_date(FAILURE_TIME).alias("_day"))
        .agg(F.count(F.lit(1)).alias("failure_count"))
        .select(day_label("_day").alias("day"), "failure_count")
    )


def mean_failure_probability(t: Tables) -> DataFrame:
    """Mean probability of the critical records in percent; 0 when there are none."""
    return t.failure_records.where(is_critical()).agg(
        F.coalesce(F.avg(PROBABILITY) * 100, F.lit(0.0)).alias("probability")
    )


def at_risk_machines_top5(t: Tables) -> DataFrame:
    """The critical records with the highest probability."""
    return (
        t.failure_records.where(is_critical())
        .orderBy(F.desc(PROBABILITY), "Failure_ID", MACHINE, "Failure_Type", FAILURE_TIME)
        .limit(TOP)
        .select(MACHINE, "Failure_Type", FAILURE_TIME)
    )


def urgent_alerts_top5(t: Tables) -> DataFrame:
    """The critical records with the latest predicted time."""
    return (
        t.failure_records.where(is_critical())
        .orderBy(F.desc(FAILURE_TIME), "Failure_ID", MACHINE, "Failure_Type")
        .limit(TOP)
        .select(MACHINE, "Failure_Type")
    )


def warnings_top5(t: Tables) -> DataFrame:
    """The warnings with the highest probability."""
    return (
        t.failure_records.where(is_warning())
        .orderBy(F.desc(PROBABILITY), "Failure_ID", MACHINE, "Failure_Type")
        .limit(TOP)
        .select(MACHINE, "Failure_Type")
    )


def critical_count(t: Tables) -> DataFrame:
    return t.failure_records.where(is_critical()).agg(F.count(F.lit(1)).alias("critical_count"))


def failure_type_distribution(t: Tables) -> DataFrame:
    """Critical records by failure type; a missing type is its own group."""
    return (
        t.failure_records.where(is_critical())
        .groupBy(F.col("Failure_Type").alias("label"))
        .agg(F.count(F.lit(1)).alias("value"))
    )


def failure_probability_series(t: Tables) -> DataFrame:
    """Known probabilities over predicted time, as points ``x, y``.

    One row per record; see ``presentation.in_display_order`` for the time order.
    """
    return t.failure_records.where(
        F.col(PROBABILITY).isNotNull() & F.col(FAILURE_TIME).isNotNull()
    ).select(F.col(FAILURE_TIME).alias("x"), F.col(PROBABILITY).alias("y"))


def _probability_by(t: Tables, attribute: str) -> DataFrame:
    rates = average_by_dimension(
        t.failure_records, t.machines, PROBABILITY, F.col(attribute), attribute
    )
    return rates.select("_key", percent(F.col("_average")).alias("_percent"))


def failure_probability_by_industry(t: Tables) -> DataFrame:
    return _probability_by(t, "Industry").toDF("x", "y")


def failure_probability_by_workload(t: Tables) -> DataFrame:
    return _probability_by(t, "Workload").toDF("x", "y")


def workload_failure_rates(t: Tables) -> DataFrame:
    """The workload measure under the column names of the workload chart."""
    return _probability_by(t, "Workload").toDF("Workload", "Failure_Rate")


def maintenance_backlog(t: Tables) -> DataFrame:
    """Critical records with machine type and risk level."""
    critical = t.failure_records.where(is_critical()).select(MACHINE, "Failure_Type", PROBABILITY)
    return with_dimension(critical, t.machines, ["Machine_Type"]).select(
        "Machine_Type",
        "Failure_Type",
        percent(F.col(PROBABILITY)).alias(PROBABILITY),
        risk_level(F.col(PROBABILITY)).alias("Risk_Level"),
    )

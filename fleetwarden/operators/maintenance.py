"""Maintenance reports: upcoming work, costs, effects."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwarden.functions.clock import AsOf, day
from fleetwarden.functions.risk import MAINTENANCE_TYPES, NEXT_SCHEDULE_DAYS
from fleetwarden.functions.time_buckets import day_label, month_label, month_start
from fleetwarden.plans.joins import MACHINE, with_dimension
from fleetwarden.tables import Tables


def _upcoming(t: Tables, as_of: AsOf) -> DataFrame:
    return t.maintenance_schedule.where(F.col("Scheduled_Date") >= day(as_of))


def maintenance_schedule_upcoming_enriched(t: Tables, as_of: AsOf = None) -> DataFrame:
    """Scheduled work from ``as_of`` on, with the type of the machine."""
    return with_dimension(_upcoming(t, as_of), t.machines, ["Machine_Type"]).select(
        MACHINE,
        "Machine_Type",
        "Scheduled_Date",
        "Maintenance_Type",
        "Estimated_Cost",
        "Estimated_Duration",
    )


def upcoming_maintenance(t: Tables, as_of: AsOf = None) -> DataFrame:
    """Scheduled work from ``as_of`` on, dates as text."""
    return _upcoming(t, as_of).select(
        MACHINE,
        day_label("Scheduled_Date").alias("Scheduled_Date"),
        "Maintenance_Type",
        "Estimated_Cost",
        "Estimated_Duration",
    )


def maintenance_calendar(t: Tables, as_of: AsOf = None) -> DataFrame:
    """Upcoming work with missing costs and durations as 0."""
    return upcoming_maintenance(t, as_of).fillna(0, ["Estimated_Cost", "Estimated_Duration"])


def maintenance_type_counts(t: Tables) -> DataFrame:
    """Scheduled jobs per known maintenance type, zero counts included; one scan."""
    kinds = F.col("Maintenance_Type")
    return (
        t.maintenance_schedule.where(kinds.isin(*MAINTENANCE_TYPES))
        .agg(*[F.count_if(kinds == kind).alias(kind) for kind in MAINTENANCE_TYPES])
        .unpivot([], list(MAINTENANCE_TYPES), "metric", "value")
    )


def mtbf_monthly(t: Tables) -> DataFrame:
    """Mean time between failures before and after maintenance, by month."""
    return (
        t.maintenance_effectiveness.groupBy(month_start("Scheduled_Date").alias("_month"))
        .agg(F.avg("MTBF_Before").alias("mtbf_before"), F.avg("MTBF_After").alias("mtbf_after"))
        .select(month_label("_month").alias("timestamp"), "mtbf_before", "mtbf_after")
    )


def maintenance_due_count(t: Tables, as_of: AsOf = None) -> DataFrame:
    due = t.maintenance_schedule.where(F.col("Scheduled_Date") < day(as_of))
    return due.agg(F.count(F.lit(1)).alias("due_count"))


def preventive_upcoming_count(t: Tables, as_of: AsOf = None) -> DataFrame:
    preventive = _upcoming(t, as_of).where(F.col("Maintenance_Type") == "Preventive")
    return preventive.agg(F.count(F.lit(1)).alias("preventive_count"))


def maintenance_cost_by_type(t: Tables, as_of: AsOf = None) -> DataFrame:
    return (
        _upcoming(t, as_of)
        .groupBy(F.col("Maintenance_Type").alias("label"))
        .agg(F.sum("Estimated_Cost").alias("value"))
    )


def maintenance_duration_histogram(t: Tables, as_of: AsOf = None) -> DataFrame:
    return (
        _upcoming(t, as_of)
        .groupBy(F.col("Estimated_Duration").alias("label"))
        .agg(F.count(F.lit(1)).alias("value"))
    )


def maintenance_impact(t: Tables) -> DataFrame:
    """Average failure downtime and job duration per maintenance type.

    Both averages run over every (job, failure) pair of a machine.  The pairs are
    never built: sums and counts per machine on each side give the same weights.
    Weights are doubles, since a hot machine's pair count can exceed a long.
    """
    jobs = (
        t.maintenance_schedule.where(F.col("Estimated_Duration").isNotNull())
        .groupBy(MACHINE, "Maintenance_Type")
        .agg(
            F.count(F.lit(1)).cast("double").alias("jobs"),
            F.sum("Estimated_Duration").alias("duration"),
        )
    )
    failures = (
        t.failure_records.where(F.col("Downtime").isNotNull())
        .groupBy(MACHINE)
        .agg(
            F.count(F.lit(1)).cast("double").alias("failures"),
            F.sum("Downtime").alias("downtime"),
        )
    )
    pairs = F.sum(F.col("jobs") * F.col("failures"))
    return (
        jobs.join(failures, MACHINE)
        .groupBy("Maintenance_Type")
        .agg(
            (F.sum(F.col("jobs") * F.col("downtime")) / pairs).alias("avg_downtime_before"),
            (F.sum(F.col("duration") * F.col("failures")) / pairs).alias("avg_downtime_after"),
        )
    )


def cost_benefit(t: Tables, as_of: AsOf = None) -> DataFrame:
    """Failure downtime of the machines behind each upcoming cost.

    A failure counts once for every upcoming job of its machine; downtime is summed
    per machine first, so the join adds one row per job instead of one per pair.
    """
    downtime = t.failure_records.groupBy(MACHINE).agg(F.sum("Downtime").alias("downtime"))
    return (
        _upcoming(t, as_of)
        .select(MACHINE, "Estimated_Cost")
        .join(downtime, MACHINE, "left")
        .groupBy(F.col("Estimated_Cost").alias("cost"))
        .agg(F.coalesce(F.sum("downtime"), F.lit(0.0)).alias("downtime_prevented"))
    )


def next_schedule_dates(t: Tables) -> DataFrame:
    """The next date of each scheduled job; only types with a known interval."""
    kind = F.col("Maintenance_Type")
    days = F.lit(None).cast("int")
    for name, interval in NEXT_SCHEDULE_DAYS.items():
        days = F.when(kind == name, interval).otherwise(days)
    return t.maintenance_schedule.where(
        kind.isin(*NEXT_SCHEDULE_DAYS) & F.col("Scheduled_Date").isNotNull()
    ).select(
        MACHINE,
        day_label(F.date_add("Scheduled_Date", days)).alias("Next_Scheduled_Date"),
        "Maintenance_Type",
    )


def maintenance_cost_monthly(t: Tables, as_of: AsOf = None) -> DataFrame:
    """Cost per month from a year before ``as_of`` on; months without jobs cost 0."""
    monthly = (
        t.maintenance_schedule.where(F.col("Scheduled_Date") >= F.add_months(day(as_of), -12))
        .groupBy(month_start("Scheduled_Date").alias("_month"))
        .agg(F.sum("Estimated_Cost").alias("_cost"))
    )
    # All months with jobs, in one row.
    known = F.map_from_entries(F.collect_list(F.struct("_month", F.struct("_cost"))))
    months = monthly.agg(
        F.min("_month").alias("low"), F.max("_month").alias("high"), known.alias("_known")
    ).select(
        F.explode(F.sequence("low", "high", F.expr("interval 1 month"))).alias("_month"), "_known"
    )
    cost = F.try_element_at("_known", F.col("_month"))
    return months.select(
        month_label("_month").alias("month"),
        F.when(cost.isNull(), 0.0).otherwise(cost["_cost"]).alias("total_cost"),
    )

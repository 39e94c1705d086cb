"""Fleet-wide state: machine list, status per machine, headline counts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwarden.functions.clock import AsOf, day
from fleetwarden.functions.risk import (
    RECOMMENDED_MAINTENANCE_DAYS,
    current_status,
    is_critical,
    is_warning,
    percent,
)
from fleetwarden.plans.joins import MACHINE, with_dimension
from fleetwarden.tables import Tables


def machine_data(t: Tables) -> DataFrame:
    """Descriptive columns of every machine."""
    return t.machines.select(
        MACHINE,
        "Machine_Type",
        "Age",
        "Workload",
        "Production_Rate",
        "Operational_Hours",
        "Last_Maintenance_Date",
    )


def _machines_with_records(t: Tables, records: DataFrame) -> DataFrame:
    """One row per id: how many machines carry it, and counts of its failure records.

    Machines and records are stacked and summed by id, which needs no join; a machine
    with many records is summed where its records are read.
    """
    machines = t.machines.select(
        MACHINE,
        F.lit(1).alias("machines"),
        *[F.lit(0).alias(name) for name in ("records", "warnings", "criticals")],
    )
    counted = records.select(
        MACHINE,
        F.lit(0).alias("machines"),
        F.lit(1).alias("records"),
        F.when(is_warning(), 1).otherwise(0).alias("warnings"),
        F.when(is_critical(), 1).otherwise(0).alias("criticals"),
    )
    return (
        machines.unionByName(counted)
        .groupBy(MACHINE)
        .agg(*[F.sum(n).alias(n) for n in ("machines", "records", "warnings", "criticals")])
    )


def _total(column: Column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0))


def fleet_overview(t: Tables, grain: str = "record") -> DataFrame:
    """Total, warning, critical and normal counts in one row.

    ``grain="record"`` counts a machine once per failure record it has (at least
    once); ``grain="machine"`` counts each machine once, by its worst record.
    """
    ids = _machines_with_records(t, t.failure_records)
    machines = F.col("machines")

    def own(name: str) -> Column:
        """Count of a machine's records; records without an id are no machine's."""
        return F.when(F.col(MACHINE).isNotNull(), F.col(name)).otherwise(0)

    if grain == "machine":
        critical = own("criticals") > 0
        total = machines
        warnings = F.when(~critical & (own("warnings") > 0), machines)
        criticals = F.when(critical, machines)
    else:
        total = machines * F.greatest(own("records"), F.lit(1))
        warnings = machines * own("warnings")
        criticals = machines * own("criticals")
    counts = ids.agg(
        _total(total).alias("total_machines"),
        _total(warnings).alias("warning_machines"),
        _total(criticals).alias("critical_machines"),
    )
    return counts.withColumn(
        "normal_machines",
        F.col("total_machines") - F.col("warning_machines") - F.col("critical_machines"),
    )


def _failures_per_machine(t: Tables) -> DataFrame:
    return t.failure_records.groupBy(MACHINE).agg(
        F.count_if(is_warning()).alias("warnings"),
        F.count_if(is_critical()).alias("criticals"),
        F.max("Predicted_Failure_Probability").alias("probability"),
    )


def machine_status(t: Tables, grain: str = "record") -> DataFrame:
    """Status, last and next maintenance of machines.

    ``grain="record"`` gives a row per failure record and one ``Normal`` row for a
    machine without any.  The outer join is written as an inner join plus the
    machines no record names: the inner join may broadcast the machines or have hot
    ones split, neither of which a left join from the machine side allows.
    ``grain="machine"`` gives one row per machine, by its worst record.
    """
    attributes = ["Machine_Type", "Last_Maintenance_Date"]
    if grain == "machine":
        rows = t.machines.select(MACHINE, *attributes).join(
            _failures_per_machine(t), MACHINE, "left"
        )
        status = (
            F.when(F.col("criticals") > 0, "Critical")
            .when(F.col("warnings") > 0, "Warning")
            .otherwise("Normal")
        )
        probability = F.col("probability")
    else:
        records = t.failure_records.select(
            MACHINE, "Failure_Status", "Predicted_Failure_Probability"
        )
        named = with_dimension(records, t.machines, attributes)
        without_records = t.machines.select(MACHINE, *attributes).join(
            records.select(MACHINE).distinct(), MACHINE, "left_anti"
        )
        rows = named.unionByName(without_records, allowMissingColumns=True)
        status = current_status()
        probability = F.col("Predicted_Failure_Probability")
    return rows.select(
        MACHINE,
        F.col("Machine_Type").alias("Type"),
        status.alias("Current_Status"),
        F.col("Last_Maintenance_Date").alias("Last_Maintenance"),
        percent(probability).alias("Predicted_Failure_Probability"),
        F.date_add("Last_Maintenance_Date", RECOMMENDED_MAINTENANCE_DAYS).alias(
            "Next_Recommended_Maintenance"
        ),
    )


def _critical_summary(t: Tables) -> DataFrame:
    """Operational machines and critical records in one row, from one pass over each table.

    Operational are the machines outside the critical ones, under SQL ``NOT IN`` rules:
    a NULL among the critical ids rules every machine out, no ids at all rule none out,
    and else a machine without an id is not outside.  The anti join Spark plans for
    ``NOT IN`` broadcasts its right side whatever the size; sums by id need no join.
    """
    ids = _machines_with_records(t, t.failure_records.where(is_critical()))
    critical, named = F.col("criticals") > 0, F.col(MACHINE).isNotNull()
    sums = ids.agg(
        F.count_if(critical).alias("ids"),
        F.count_if(critical & ~named).alias("nameless"),
        _total(F.col("machines")).alias("all"),
        _total(F.when(~critical & named, F.col("machines"))).alias("free"),
        _total(F.col("criticals")).alias("critical_count"),
    )
    operational = (
        F.when(F.col("ids") == 0, F.col("all"))
        .when(F.col("nameless") > 0, F.lit(0))
        .otherwise(F.col("free"))
    )
    return sums.select(operational.alias("operational_count"), "critical_count")


def operational_machine_count(t: Tables) -> DataFrame:
    """Machines not in the set of machines with a critical record."""
    return _critical_summary(t).select("operational_count")


def maintenance_page_counts(t: Tables, as_of: AsOf = None) -> DataFrame:
    """Operational, preventive, due and critical counts in one row.

    One pass over the schedule and one over machines and failures.
    """
    today = day(as_of)
    summary = _critical_summary(t)
    schedule = t.maintenance_schedule.agg(
        F.count_if(
            (F.col("Maintenance_Type") == "Preventive") & (F.col("Scheduled_Date") >= today)
        ).alias("preventive_count"),
        F.count_if(F.col("Scheduled_Date") < today).alias("due_count"),
    )
    return schedule.select(
        summary.select("operational_count").scalar().alias("operational_count"),
        "preventive_count",
        "due_count",
        summary.select("critical_count").scalar().alias("critical_count"),
    )

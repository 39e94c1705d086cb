"""Presentation operators over reports, with the SQL each must agree with."""

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.report_checks import FLEET
from checks.sample import CALENDAR_MONTH, READING_INSTANT, SCHEDULE_DAY
from fleetwarden.operators import failures, fleet, maintenance, sensors
from fleetwarden.operators import presentation as screen
from fleetwarden.tables import Tables

_DAY = f"DATE '{SCHEDULE_DAY}'"
_BANDS = """CASE WHEN {v} >= 0 AND {v} < 50 THEN 'low' WHEN {v} >= 50 AND {v} < 80 THEN 'medium'
  WHEN {v} >= 80 AND {v} <= 100 THEN 'high' END AS band"""
_STATUS_ORDER = ["Machine_ID", "Predicted_Failure_Probability", "Type", "Last_Maintenance"]
_UPCOMING_ORDER = [
    "Scheduled_Date",
    "Machine_ID",
    "Maintenance_Type",
    "Estimated_Cost",
    "Estimated_Duration",
]


def _nulls_first(columns: list[str]) -> str:
    return ", ".join(f"{c} NULLS FIRST" for c in columns)


def _shares(select: str) -> str:
    return f""", groups AS ({select}) SELECT label, value, CAST(value AS DOUBLE) /
    CAST((SELECT SUM(value) FROM groups) AS DOUBLE) AS share FROM groups"""


def _second_page(report: DataFrame, order: list[str], size: int) -> DataFrame:
    """The page after the first one, by the key of the first one's last row."""
    shown = screen.page_after(report, order, None, size).orderBy(*order).collect()
    return screen.page_after(report, order, shown[-1].asDict() if shown else None, size)


def _positions(select: str, order: str) -> str:
    return f"""SELECT row_number() OVER (ORDER BY {order}) AS position, * FROM ({select})"""


def _with_nameless_failure(t: Tables) -> Tables:
    """The tables with one more critical record, of a machine that isn't known."""
    one = t.failure_records.where("Failure_Status = 1").orderBy("Failure_ID").limit(1)
    nameless = one.withColumn("Machine_ID", F.lit(None).cast("string"))
    return replace(t, failure_records=t.failure_records.unionByName(nameless))


SCREENS = {
    "operational_machine_count_nameless": (
        lambda t: fleet.operational_machine_count(_with_nameless_failure(t)),
        """SELECT COUNT(*) AS operational_count FROM machines WHERE Machine_ID NOT IN (
        SELECT Machine_ID FROM failure_records WHERE Failure_Status = 1
        UNION ALL SELECT CAST(NULL AS VARCHAR))""",
    ),
    "maintenance_schedule_in_order": (
        lambda t: screen.with_position(
            maintenance.maintenance_schedule_upcoming_enriched(t, SCHEDULE_DAY),
            "maintenance_schedule_upcoming_enriched",
        ),
        _positions(
            f"""SELECT ms.Machine_ID, m.Machine_Type, ms.Scheduled_Date, ms.Maintenance_Type,
            ms.Estimated_Cost, ms.Estimated_Duration FROM maintenance_schedule ms
            JOIN machines m ON ms.Machine_ID = m.Machine_ID WHERE ms.Scheduled_Date >= {_DAY}""",
            _nulls_first(
                "Scheduled_Date Machine_ID Machine_Type Maintenance_Type Estimated_Cost Estimated_Duration".split()
            ),
        ),
    ),
    "failure_records_in_order": (
        lambda t: screen.with_position(
            failures.failure_records_enriched(t), "failure_records_enriched"
        ),
        _positions(
            """SELECT fr.Machine_ID, m.Machine_Type, fr.Failure_Type, fr.Downtime,
            fr.Predicted_Failure_Probability, fr.Predicted_Failure_Time FROM failure_records fr
            JOIN machines m ON fr.Machine_ID = m.Machine_ID""",
            "Predicted_Failure_Time DESC NULLS LAST, "
            + _nulls_first("Machine_ID Machine_Type Failure_Type Downtime Predicted_Failure_Probability".split()),
        ),
    ),
    "sensor_feature_means_in_order": (
        lambda t: screen.with_position(sensors.sensor_feature_means(t), "sensor_feature_means"),
        _positions(
            " UNION ALL ".join(
                f"SELECT '{s}' AS feature, AVG({s}) AS importance FROM sensor_data" for s in sensors.COMPARED_SENSORS
            ),
            "importance DESC NULLS LAST, feature NULLS FIRST",
        ),
    ),
    "machine_status_page": (
        lambda t: _second_page(
            screen.only(fleet.machine_status(t), "Current_Status", "Critical"), _STATUS_ORDER, 10
        ),
        FLEET
        + f""", critical AS (SELECT Machine_ID, Machine_Type AS Type, 'Critical' AS Current_Status,
          Last_Maintenance_Date AS Last_Maintenance,
          ROUND(Predicted_Failure_Probability * 100, 2) AS Predicted_Failure_Probability,
          Last_Maintenance_Date + 30 AS Next_Recommended_Maintenance FROM fleet WHERE state = 2)
        SELECT *, (SELECT COUNT(*) > 20 FROM critical) AS has_next FROM critical
        ORDER BY {_nulls_first(_STATUS_ORDER)} LIMIT 10 OFFSET 10""",
    ),
    "upcoming_maintenance_page": (
        lambda t: screen.page(
            screen.only(
                maintenance.upcoming_maintenance(t, SCHEDULE_DAY), "Maintenance_Type", "Preventive"
            ),
            _UPCOMING_ORDER,
            1,
            5,
        ),
        f""", upcoming AS (SELECT Machine_ID, strftime(Scheduled_Date, '%Y-%m-%d') AS Scheduled_Date,
        Maintenance_Type, Estimated_Cost, Estimated_Duration FROM maintenance_schedule
        WHERE Scheduled_Date >= {_DAY} AND Maintenance_Type = 'Preventive')
        SELECT *, (SELECT COUNT(*) > 5 FROM upcoming) AS has_next FROM upcoming
        ORDER BY {_nulls_first(_UPCOMING_ORDER)} LIMIT 5""",
    ),
    "schedule_summary": (
        lambda t: screen.schedule_summary(maintenance.upcoming_maintenance(t, SCHEDULE_DAY)),
        f"""SELECT COUNT(*) AS total_scheduled,
        COUNT(*) FILTER (WHERE Maintenance_Type = 'Preventive') AS preventive_count,
        COUNT(*) FILTER (WHERE Maintenance_Type = 'Corrective') AS corrective_count
        FROM maintenance_schedule WHERE Scheduled_Date >= {_DAY}""",
    ),
    "schedule_cards_top5": (
        lambda t: screen.schedule_cards(
            maintenance.maintenance_schedule_upcoming_enriched(t, SCHEDULE_DAY)
        ),
        f"""SELECT ms.Machine_ID, m.Machine_Type, ms.Scheduled_Date, ms.Maintenance_Type,
        ms.Estimated_Cost, ms.Estimated_Duration FROM maintenance_schedule ms
        JOIN machines m ON ms.Machine_ID = m.Machine_ID WHERE ms.Scheduled_Date >= {_DAY}
        ORDER BY ms.Scheduled_Date, ms.Machine_ID, ms.Maintenance_Type,
        ms.Estimated_Cost NULLS FIRST, ms.Estimated_Duration LIMIT 5""",
    ),
    "maintenance_type_shares": (
        lambda t: screen.shares(maintenance.maintenance_type_counts(t), "metric", "value"),
        _shares(
            """SELECT Maintenance_Type AS label, COUNT(*) AS value FROM maintenance_schedule
            WHERE Maintenance_Type IN ('Preventive', 'Corrective') GROUP BY 1"""
        ),
    ),
    "failure_type_shares": (
        lambda t: screen.shares(failures.failure_type_distribution(t), "label", "value"),
        _shares(
            """SELECT Failure_Type AS label, COUNT(*) AS value FROM failure_records
            WHERE Failure_Status = 1 GROUP BY 1"""
        ),
    ),
    "maintenance_cost_shares": (
        lambda t: screen.shares(
            maintenance.maintenance_cost_by_type(t, SCHEDULE_DAY), "label", "value"
        ),
        _shares(
            f"""SELECT Maintenance_Type AS label, SUM(Estimated_Cost) AS value
            FROM maintenance_schedule WHERE Scheduled_Date >= {_DAY} GROUP BY 1"""
        ),
    ),
    "failure_probability_gauge": (
        lambda t: screen.with_gauge_band(failures.mean_failure_probability(t), "probability"),
        f"""SELECT probability, {_BANDS.format(v='probability')} FROM (
        SELECT COALESCE(AVG(Predicted_Failure_Probability) * 100, CAST(0 AS DOUBLE)) AS probability
        FROM failure_records WHERE Failure_Status = 1)""",
    ),
    "temperature_gauge": (
        lambda t: screen.with_gauge_band(
            sensors.temperature_last_day(t, READING_INSTANT), "average_temperature"
        ),
        f"""SELECT *, {_BANDS.format(v='average_temperature')} FROM (
        SELECT COALESCE(AVG(Temperature), CAST(0 AS DOUBLE)) AS average_temperature,
        COALESCE(MIN(Temperature), CAST(0 AS DOUBLE)) AS min_temperature,
        COALESCE(MAX(Temperature), CAST(100 AS DOUBLE)) AS max_temperature
        FROM sensor_data WHERE Timestamp >= TIMESTAMP '{READING_INSTANT}' - INTERVAL 1 DAY)""",
    ),
    "anomaly_hourly_box": (
        lambda t: screen.box_summary(sensors.anomaly_hourly(t), "anomaly_score"),
        """SELECT MIN(s) AS lowest, quantile_cont(s, 0.25) AS q1, quantile_cont(s, 0.5) AS median,
        quantile_cont(s, 0.75) AS q3, MAX(s) AS highest FROM (
        SELECT AVG(Anomaly_Score) AS s FROM sensor_data WHERE Anomaly_Score IS NOT NULL
        GROUP BY date_trunc('hour', Timestamp))""",
    ),
    "maintenance_calendar_month": (
        lambda t: screen.calendar_month(t.maintenance_schedule, CALENDAR_MONTH),
        f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY Scheduled_Date
          ORDER BY Machine_ID, Maintenance_Type, Estimated_Cost NULLS FIRST, Estimated_Duration) AS place
          FROM maintenance_schedule)
        SELECT CAST(d.day AS DATE) AS day, r.Machine_ID IS NOT NULL AS has_event, r.Machine_ID,
        r.Maintenance_Type, r.Estimated_Cost, r.Estimated_Duration
        FROM (SELECT unnest(generate_series(TIMESTAMP '{CALENDAR_MONTH}',
          TIMESTAMP '{CALENDAR_MONTH}' + INTERVAL 1 MONTH - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS day) d
        LEFT JOIN ranked r ON r.Scheduled_Date = CAST(d.day AS DATE) AND r.place = 1""",
    ),
}

"""Empty tables, NULLs and limits."""

from datetime import date, datetime

import pytest

from checks.report_checks import REPORTS
from fleetwarden import Tables, schemas
from fleetwarden.functions.risk import gauge_band
from fleetwarden.operators import evaluation, failures, fleet, maintenance, presentation, sensors


def _failures(spark, rows):
    """(machine, status, probability) rows."""
    full = [(i, m, status, None, 1.0, p, None) for i, (m, status, p) in enumerate(rows)]
    return spark.createDataFrame(full, schemas.FAILURE_RECORDS)


def _machines(spark, *ids):
    full = [(m, "Press", *[None] * 10) for m in ids]
    return spark.createDataFrame(full, schemas.MACHINES)


@pytest.mark.parametrize("name", REPORTS)
def test_empty_tables(spark, name):
    operator, _ = REPORTS[name]
    operator(Tables.empty(spark)).collect()


def test_empty_tables_have_defaults(spark, rows):
    t = Tables.empty(spark)
    assert rows(failures.mean_failure_probability(t)) == [(0.0,)]
    assert rows(sensors.temperature_last_day(t, "2024-01-01")) == [(0.0, 0.0, 100.0)]
    assert rows(fleet.fleet_overview(t)) == [(0, 0, 0, 0)]
    assert rows(fleet.maintenance_page_counts(t)) == [(0, 0, 0, 0)]
    assert rows(maintenance.maintenance_type_counts(t)) == [("Corrective", 0), ("Preventive", 0)]


@pytest.mark.parametrize(
    "critical, expected",
    [([], 3), (["a"], 1), (["a", None], 0), (["c"], 2)],
)
def test_operational_follows_not_in(spark, critical, expected):
    """A NULL machine is outside no set but the empty one; a NULL id rules all out."""
    t = Tables.empty(
        spark,
        machines=_machines(spark, "a", "b", None),
        failure_records=_failures(spark, [(m, 1, 0.9) for m in critical]),
    )
    assert fleet.operational_machine_count(t).first()[0] == expected
    t.machines.createOrReplaceTempView("edge_machines")
    t.failure_records.createOrReplaceTempView("edge_failures")
    plain = spark.sql(
        """SELECT count(*) FROM edge_machines WHERE Machine_ID NOT IN
        (SELECT Machine_ID FROM edge_failures WHERE Failure_Status = 1)"""
    )
    assert plain.first()[0] == expected


def test_status_limits(spark, rows):
    t = Tables.empty(
        spark,
        machines=_machines(spark, "a", "b", "c", "d", "e"),
        failure_records=_failures(
            spark,
            [("a", 0, 0.7), ("b", 0, 0.71), ("c", 0, None), ("d", 1, None), ("b", 1, 0.1), ("x", 1, 1.0)],
        ),
    )
    assert rows(fleet.machine_status(t), "Machine_ID", "Current_Status") == [
        ("a", "Normal"),
        ("b", "Critical"),
        ("b", "Warning"),
        ("c", "Normal"),
        ("d", "Critical"),
        ("e", "Normal"),
    ]
    assert rows(fleet.machine_status(t, "machine"), "Machine_ID", "Current_Status") == [
        ("a", "Normal"),
        ("b", "Critical"),
        ("c", "Normal"),
        ("d", "Critical"),
        ("e", "Normal"),
    ]
    assert rows(fleet.fleet_overview(t)) == [(6, 1, 2, 3)]
    assert rows(fleet.fleet_overview(t, "machine")) == [(5, 0, 2, 3)]
    assert [r["Risk_Level"] for r in failures.maintenance_backlog(t).collect()] == ["Low", "Low"]


def test_cost_window_starts_at_month_end(spark, rows):
    days = [date(2023, 2, 27), date(2023, 2, 28)]
    jobs = [(i, "a", d, "Preventive", 1.0, 1.0) for i, d in enumerate(days)]
    t = Tables.empty(
        spark, maintenance_schedule=spark.createDataFrame(jobs, schemas.MAINTENANCE_SCHEDULE)
    )
    # A year before the 29th of February is the 28th.
    assert rows(maintenance.maintenance_cost_monthly(t, "2024-02-29")) == [("2023-02", 1.0)]


def test_month_with_unknown_cost_stays_unknown(spark, rows):
    jobs = [(1, "a", date(2024, 1, 5), "Preventive", None, 1.0)]
    t = Tables.empty(
        spark, maintenance_schedule=spark.createDataFrame(jobs, schemas.MAINTENANCE_SCHEDULE)
    )
    assert rows(maintenance.maintenance_cost_monthly(t, "2024-01-01")) == [("2024-01", None)]


def test_heatmap_keeps_unknown_types_and_fills_gaps(spark, rows):
    at = [datetime(2024, 1, 2, 5), datetime(2024, 1, 2, 6), datetime(2024, 1, 1, 6)]
    columns = schemas.SENSOR_DATA.names

    def reading(machine, when, vibration):
        given = {"Machine_ID": machine, "Timestamp": when, "Vibration": vibration}
        return tuple(given.get(c) for c in columns)

    data = [reading("a", at[0], 2.0), reading("b", at[1], 4.0), reading("a", at[2], 99.0)]
    machines = [("a", None, *[None] * 10), ("b", "Press", *[None] * 10)]
    t = Tables.empty(
        spark,
        sensor_data=spark.createDataFrame(data, schemas.SENSOR_DATA),
        machines=spark.createDataFrame(machines, schemas.MACHINES),
    )
    assert rows(sensors.vibration_heatmap(t)) == [
        ("2024-01-02 05:00:00", "Press", 0.0),
        ("2024-01-02 05:00:00", None, 2.0),
        ("2024-01-02 06:00:00", "Press", 4.0),
        ("2024-01-02 06:00:00", None, 0.0),
    ]


def test_gauge_limits(spark):
    values = [-1.0, 0.0, 49.9, 50.0, 79.9, 80.0, 100.0, 100.1]
    frame = spark.createDataFrame([(v,) for v in values], "v double").select("v", gauge_band(_v()))
    bands = {v: band for v, band in frame.collect()}
    assert [bands[v] for v in values] == [None, "low", "low", "medium", "medium", "high", "high", None]


def _v():
    from pyspark.sql import functions as F

    return F.col("v")


def test_pages(spark):
    frame = spark.range(12)
    pages = [presentation.page(frame, ["id"], n, 5).collect() for n in (1, 2, 3, 4)]
    assert [[r["id"] for r in p] for p in pages] == [
        [0, 1, 2, 3, 4],
        [5, 6, 7, 8, 9],
        [10, 11],
        [],
    ]
    assert [p[0]["has_next"] for p in pages[:3]] == [True, True, False]
    assert presentation.only(frame, "id").count() == 12


def test_calendar_lists_every_day(spark):
    jobs = [
        (1, "b", date(2024, 2, 29), "Preventive", 5.0, 1.0),
        (2, "a", date(2024, 2, 29), "Corrective", None, 1.0),
        (3, "a", date(2024, 3, 1), "Corrective", 1.0, 1.0),
    ]
    schedule = spark.createDataFrame(jobs, schemas.MAINTENANCE_SCHEDULE)
    days = presentation.calendar_month(schedule, "2024-02-10").orderBy("day").collect()
    assert len(days) == 29
    assert [d["has_event"] for d in days] == [False] * 28 + [True]
    assert days[-1]["Machine_ID"] == "a"


def test_display_order(spark):
    frame = spark.createDataFrame([("b", 1.0), ("a", 3.0), ("c", 2.0)], "feature string, importance double")
    shown = presentation.in_display_order(frame, "sensor_feature_means").collect()
    assert [r["feature"] for r in shown] == ["a", "c", "b"]
    assert presentation.in_display_order(frame, "machine_data") is frame


def test_evaluation_of_nothing(spark):
    empty = spark.createDataFrame([], "label int, prediction int, score double")
    assert [tuple(r) for r in evaluation.roc_curve(empty).collect()] == [(0.0, 0.0)]
    assert [tuple(r) for r in evaluation.confusion_matrix(empty).collect()] == [
        ("Normal", 0, 0),
        ("Failure", 0, 0),
    ]

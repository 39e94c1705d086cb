"""Small hand-checked row sets."""

from datetime import date, datetime

import pytest

from fleetwarden import Tables, schemas
from fleetwarden.operators import failures, maintenance, sensors


def _named(schema, rows, *columns):
    """Rows given for some columns of a schema; the others are NULL."""
    return [tuple(dict(zip(columns, row)).get(name) for name in schema.names) for row in rows]


def _id(number):
    return f"Machine_{number:03d}"


@pytest.fixture(scope="module")
def schedule(spark):
    given = [
        (1, date(2025, 4, 25), "Preventive", 500.0, 2.5),
        (2, date(2025, 5, 10), "Corrective", 800.0, 3.0),
        (3, date(2025, 5, 20), "Preventive", 450.0, 2.0),
        (4, date(2025, 6, 5), "Corrective", 700.0, 3.5),
        (5, date(2025, 6, 15), "Preventive", 600.0, 2.8),
    ]
    schema = schemas.MAINTENANCE_SCHEDULE
    rows = [(n, _id(n), *rest) for n, *rest in given]
    return Tables.empty(spark, maintenance_schedule=spark.createDataFrame(rows, schema))


@pytest.fixture(scope="module")
def records(spark):
    critical = [
        (5, "Bearing Failure", 0.87, datetime(2024, 3, 20, 14, 39, 28)),
        (9, "Electrical Failure", 0.85, datetime(2024, 3, 14, 14, 58)),
        (21, "Overheating", 0.90, datetime(2024, 3, 13, 4, 14, 22)),
        (11, "Motor Failure", 0.88, datetime(2024, 3, 22, 10)),
        (12, "Overheating", 0.92, datetime(2024, 3, 21, 15, 30)),
        (13, "Electrical Failure", 0.85, datetime(2024, 3, 20, 12, 45)),
        (14, "Bearing Failure", 0.89, datetime(2024, 3, 19, 9, 15)),
        (15, "Overheating", 0.91, datetime(2024, 3, 18, 14)),
    ]
    warnings = [(15, 0.75), (27, 0.72), (37, 0.78), (16, 0.74), (17, 0.73), (18, 0.76), (19, 0.75), (20, 0.77)]
    rows = [(_id(n), 1, kind, p, at) for n, kind, p, at in critical]
    rows += [(_id(n), 0, None, p, None) for n, p in warnings]
    numbered = [(i, *row) for i, row in enumerate(rows)]
    schema = schemas.FAILURE_RECORDS
    columns = ("Failure_ID", "Machine_ID", "Failure_Status", "Failure_Type")
    columns += ("Predicted_Failure_Probability", "Predicted_Failure_Time")
    frame = spark.createDataFrame(_named(schema, numbered, *columns), schema)
    machines = [(_id(n), "Press") for n in range(1, 38)]
    fleet = spark.createDataFrame(
        _named(schemas.MACHINES, machines, "Machine_ID", "Machine_Type"), schemas.MACHINES
    )
    return Tables.empty(spark, failure_records=frame, machines=fleet)


@pytest.fixture(scope="module")
def readings(spark):
    given = [
        (15, datetime(2024, 3, 10, 10), 85.0, 5.0, 120.0, 0.78),
        (27, datetime(2024, 3, 10, 11), 90.0, 6.0, 125.0, 0.72),
        (37, datetime(2024, 3, 10, 12), 88.0, 4.5, 130.0, 0.75),
        (16, datetime(2024, 3, 11, 10), 87.0, 5.5, 122.0, 0.74),
        (17, datetime(2024, 3, 11, 11), 88.0, 6.0, 125.0, 0.73),
        (18, datetime(2024, 3, 11, 12), 89.0, 4.8, 130.0, 0.76),
        (19, datetime(2024, 3, 11, 13), 86.0, 5.2, 128.0, 0.75),
        (20, datetime(2024, 3, 11, 14), 85.0, 5.0, 126.0, 0.77),
    ]
    columns = ("Machine_ID", "Timestamp", "Temperature", "Vibration", "Pressure", "Anomaly_Score")
    schema = schemas.SENSOR_DATA
    rows = _named(schema, [(_id(n), *rest) for n, *rest in given], *columns)
    return Tables.empty(spark, sensor_data=spark.createDataFrame(rows, schema))


def test_schedule_reports(schedule, rows):
    assert rows(maintenance.maintenance_cost_by_type(schedule, "2025-04-01")) == [
        ("Corrective", 1500.0),
        ("Preventive", 1550.0),
    ]
    assert rows(maintenance.maintenance_duration_histogram(schedule, "2025-04-01")) == [
        (2.0, 1),
        (2.5, 1),
        (2.8, 1),
        (3.0, 1),
        (3.5, 1),
    ]
    assert rows(maintenance.maintenance_cost_monthly(schedule, "2025-06-30")) == [
        ("2025-04", 500.0),
        ("2025-05", 1250.0),
        ("2025-06", 1300.0),
    ]
    assert rows(maintenance.next_schedule_dates(schedule), "Machine_ID", "Next_Scheduled_Date") == [
        ("Machine_001", "2025-05-25"),
        ("Machine_002", "2025-07-09"),
        ("Machine_003", "2025-06-19"),
        ("Machine_004", "2025-08-04"),
        ("Machine_005", "2025-07-15"),
    ]
    assert rows(maintenance.maintenance_type_counts(schedule)) == [("Corrective", 2), ("Preventive", 3)]


def test_months_without_jobs_cost_nothing(schedule, rows):
    gap = schedule.maintenance_schedule.where("month(Scheduled_Date) <> 5")
    tables = Tables.empty(gap.sparkSession, maintenance_schedule=gap)
    assert rows(maintenance.maintenance_cost_monthly(tables, "2025-06-30")) == [
        ("2025-04", 500.0),
        ("2025-05", 0.0),
        ("2025-06", 1300.0),
    ]


def _ids(frame):
    return [row["Machine_ID"] for row in frame.collect()]


def test_failure_reports(records, rows):
    assert _ids(failures.at_risk_machines_top5(records)) == [_id(n) for n in (12, 15, 21, 14, 11)]
    assert _ids(failures.urgent_alerts_top5(records)) == [_id(n) for n in (11, 12, 5, 13, 14)]
    assert _ids(failures.warnings_top5(records)) == [_id(n) for n in (37, 20, 18, 15, 19)]
    assert rows(failures.failure_type_distribution(records)) == [
        ("Bearing Failure", 2),
        ("Electrical Failure", 2),
        ("Motor Failure", 1),
        ("Overheating", 3),
    ]
    mean = failures.mean_failure_probability(records).first()[0]
    assert mean == pytest.approx(88.375, abs=1e-9)
    daily = dict(rows(failures.failures_daily(records)))
    assert daily == {
        f"2024-03-{d}": n for d, n in ((13, 1), (14, 1), (18, 1), (19, 1), (20, 2), (21, 1), (22, 1))
    }
    assert rows(failures.failure_trends_monthly(records)) == [("2024-03", 100.0)]


def test_risk_level_at_its_limit(records):
    backlog = failures.maintenance_backlog(records).where("Predicted_Failure_Probability = 85")
    assert [row["Risk_Level"] for row in backlog.collect()] == ["Medium", "Medium"]


def test_sensor_reports(readings, rows):
    assert rows(sensors.temperature_last_day(readings, "2024-03-11 14:00:00")) == [(87.0, 85.0, 89.0)]
    daily = dict(rows(sensors.temperature_daily(readings)))
    assert daily == {"2024-03-10": pytest.approx(87.6667, abs=1e-4), "2024-03-11": 87.0}
    assert rows(sensors.pressure_trend_latest_day(readings)) == [
        (f"2024-03-11 {hour}:00:00", value)
        for hour, value in ((10, 122.0), (11, 125.0), (12, 130.0), (13, 128.0), (14, 126.0))
    ]
    means = dict(rows(sensors.sensor_feature_means(readings)))
    assert means == {"Pressure": 125.75, "Temperature": 87.25, "Vibration": pytest.approx(5.25)}
    impact = dict(rows(sensors.temperature_anomaly_impact(readings)))
    assert impact == {85.0: 77.5, 86.0: 75.0, 87.0: 74.0, 88.0: 74.0, 89.0: 76.0, 90.0: 72.0}

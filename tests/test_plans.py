"""Shape of the physical plans, and results with one machine owning most rows."""

import re
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from checks.presentation_checks import SCREENS
from checks.report_checks import REPORTS
from fleetwarden import Tables, schemas
from fleetwarden.operators import evaluation, failures, fleet, maintenance, presentation, sensors
from fleetwarden.plans.day_filters import newest_days, newest_days_with

AS_OF = "2000-01-01"


def plan(frame):
    return frame._jdf.queryExecution().explainString(
        frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


@pytest.fixture(scope="module")
def stored(spark, small, tmp_path_factory):
    """The sample tables written as fleet tables, readings by day."""
    root = str(tmp_path_factory.mktemp("stored"))
    for name in ("machines", "failure_records", "maintenance_schedule", "maintenance_effectiveness"):
        getattr(small, name).write.parquet(f"{root}/{name}")
    for name in ("sensor_data", "machine_health_indicators"):
        dated = getattr(small, name).selectExpr("*", "to_date(Timestamp) AS event_date")
        dated.write.partitionBy("event_date").parquet(f"{root}/{name}")
    return Tables.from_parquet(spark, root)


@pytest.mark.parametrize("name", [*REPORTS, *SCREENS])
def test_no_pairs_are_built(small, name):
    """No report needs a nested loop or a product of two tables."""
    operator, _ = (REPORTS | SCREENS)[name]
    text = plan(operator(small))
    assert "CartesianProduct" not in text
    assert "NestedLoop" not in text


@pytest.mark.parametrize("name", [*REPORTS, *SCREENS])
def test_nothing_large_is_broadcast(small, no_broadcast, name):
    operator, _ = (REPORTS | SCREENS)[name]
    assert "BroadcastExchange" not in plan(operator(small))


@pytest.mark.parametrize(
    "operator, filters",
    [
        (failures.critical_count, ["EqualTo(Failure_Status,1)"]),
        (failures.maintenance_backlog, ["EqualTo(Failure_Status,1)", "IsNotNull(Machine_ID)"]),
        (failures.warnings_top5, ["GreaterThan(Predicted_Failure_Probability,0.7)"]),
        (failures.failures_daily, ["IsNotNull(Predicted_Failure_Time)"]),
        (lambda t: maintenance.upcoming_maintenance(t, AS_OF), ["GreaterThanOrEqual(Scheduled_Date,2000-01-01)"]),
        (maintenance.maintenance_type_counts, ["In(Maintenance_Type, [Corrective,Preventive])"]),
        (lambda t: sensors.temperature_last_day(t, "2024-01-30 12:00:00"), ["GreaterThanOrEqual(Timestamp,2024-01-29T12:00)"]),
    ],
)
def test_filters_reach_the_scan(stored, operator, filters):
    text = plan(operator(stored))
    for expected in filters:
        assert expected in text


@pytest.mark.parametrize(
    "operator, columns",
    [
        (failures.failure_rate_by_machine_type, {"Machine_ID", "Failure_Status", "Machine_Type"}),
        (failures.critical_count, {"Failure_Status"}),
        (sensors.temperature_anomaly_impact, {"Temperature", "Anomaly_Score"}),
        (sensors.pressure_trend_latest_day, {"Timestamp", "Pressure"}),
        (
            sensors.failure_probability_by_temperature,
            {"Machine_ID", "Temperature", "Failure_Status", "Predicted_Failure_Probability"},
        ),
    ],
)
def test_only_needed_columns_are_read(stored, operator, columns):
    read = set()
    for schema in re.findall(r"ReadSchema: struct<(.*?)>", plan(operator(stored))):
        read |= {part.split(":")[0] for part in schema.split(",") if part}
    assert read == columns


def test_latest_day_prunes_partitions(stored):
    text = plan(sensors.pressure_trend_latest_day(stored))
    assert re.search(r"PartitionFilters: \[.*event_date#\d+ = Subquery", text)
    day = plan(sensors.temperature_last_day(stored, "2024-01-30 12:00:00"))
    assert re.search(r"PartitionFilters: \[.*event_date#\d+ >= 2024-01-29", day)


def test_latest_rows_come_from_the_newest_days(stored):
    recent = plan(sensors.sensor_recent(stored))
    assert re.search(r"PartitionFilters: \[.*event_date#\d+ >= Subquery", recent)
    read = newest_days(stored.sensor_data, 40)
    days = [r[0].day for r in read.select("event_date").distinct().collect()]
    newest = stored.sensor_data.groupBy("event_date").count().orderBy("event_date", ascending=False)
    total, expected = 0, []
    for day, count in newest.collect():
        if total < 40:
            expected.append(day.day)
        total += count
    assert sorted(days) == sorted(expected)
    assert newest_days(stored.sensor_data, 10**9).count() == stored.sensor_data.count()


def test_recent_health_opens_the_newest_days_only(stored):
    """Every read of the health rows is bounded by a plain day near the newest one."""
    health = stored.machine_health_indicators
    newest = health.agg({"event_date": "max"}).first()[0]
    filters = re.findall(r"PartitionFilters: \[(.*?)\]", plan(sensors.health_indicators_recent(stored)))
    bounds = [re.search(r"event_date#\d+ >= (\d{4}-\d\d-\d\d)", f) for f in filters if "event_date" in f]
    assert bounds and all(bounds)
    assert all(str(newest - timedelta(days=8)) < b.group(1) <= str(newest) for b in bounds)


def test_health_walk_widens_to_known_machines(spark, stored):
    health = stored.machine_health_indicators
    known = health.orderBy("Timestamp").limit(3).select("Machine_ID")
    found = newest_days_with(health, 2, known, "Machine_ID")
    newest_rows = health.join(known, "Machine_ID", "left_semi").orderBy(F.desc("Timestamp")).limit(2)
    kept = found.join(known, "Machine_ID", "left_semi").orderBy(F.desc("Timestamp")).limit(2)
    assert [r["Timestamp"] for r in kept.collect()] == [r["Timestamp"] for r in newest_rows.collect()]
    none = known.where("Machine_ID = 'nobody'")
    assert newest_days_with(health, 2, none, "Machine_ID").count() == health.count()


def test_running_totals_deal_once(small):
    """One grouping and one range exchange in the plan, used twice, and no job before it runs."""
    spark = small.failure_records.sparkSession
    rows = small.failure_records.selectExpr("Failure_Status AS label", "Predicted_Failure_Probability AS score")
    spark.sparkContext.setJobGroup("roc", "roc")
    try:
        curve = evaluation.roc_curve(rows)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("roc")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan(evaluation.roc_curve(rows))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert text.count("Arguments: rangepartitioning(threshold") == 1
    assert "ReusedExchange" in text
    curve.collect()


def test_a_page_after_a_key_reads_from_the_key_on(stored):
    order = ["Scheduled_Date", "Machine_ID", "Maintenance_ID"]
    jobs = stored.maintenance_schedule.select(*order)
    every = [r.asDict() for r in jobs.orderBy(*order).limit(35).collect()]
    shown, after = [], None
    for _ in range(3):
        rows = presentation.page_after(jobs, order, after, 10).orderBy(*order).collect()
        shown += [{c: r[c] for c in order} for r in rows]
        assert all(r["has_next"] for r in rows)
        after = shown[-1]
    assert shown == every[:30]
    text = plan(presentation.page_after(jobs, order, after, 10))
    assert f"GreaterThanOrEqual(Scheduled_Date,{after['Scheduled_Date']})" in text
    assert "TakeOrderedAndProject" in text and "Arguments: 11, [" in text


def test_pages_after_nulls(spark):
    rows = [(None, 1), (None, 2), ("a", None), ("a", 3), ("b", None)]
    frame = spark.createDataFrame(rows, "x string, y int")
    shown, after = [], None
    while True:
        page = presentation.page_after(frame, ["x", "y"], after, 2).orderBy("x", "y").collect()
        shown += [(r["x"], r["y"]) for r in page]
        if not page or not page[-1]["has_next"]:
            break
        after = page[-1].asDict()
    assert shown == rows


def test_positions_over_many_ranges(spark, small):
    report = maintenance.maintenance_schedule_upcoming_enriched(small, AS_OF)
    name = "maintenance_schedule_upcoming_enriched"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = presentation.with_position(report, name).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    placed.sort(key=lambda r: r["position"])
    assert [r["position"] for r in placed] == list(range(1, report.count() + 1))
    dates = [r["Scheduled_Date"] for r in placed]
    assert dates == sorted(dates)


def test_partitioned_and_plain_readings_agree(stored, small, rows):
    for operator in (
        sensors.pressure_trend_latest_day,
        sensors.vibration_heatmap,
        sensors.sensor_recent,
        sensors.health_indicators_recent,
        lambda t: sensors.temperature_last_day(t, "2024-01-30 12:00:00"),
    ):
        assert rows(operator(stored)) == rows(operator(small))


def test_top_lists_are_not_sorted_whole(stored):
    for operator in (sensors.sensor_recent, failures.at_risk_machines_top5, sensors.health_indicators_recent):
        assert "TakeOrderedAndProject" in plan(operator(stored))


def test_reports_are_lazy(small, no_broadcast, spark):
    """No job runs while a report is built."""
    group = "reports-are-lazy"
    spark.sparkContext.setJobGroup(group, group)
    try:
        for operator in (
            lambda t: maintenance.cost_benefit(t, AS_OF),
            sensors.failure_probability_by_temperature,
            sensors.sensor_trends_hourly_failed_machines,
            failures.failure_rate_by_machine_type,
        ):
            operator(small)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


HOT = "Machine_0"


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of all readings, failures and jobs belong to one machine."""
    start = datetime(2024, 1, 1)
    owner = [HOT if i % 2 else f"Machine_{i % 40}" for i in range(2000)]

    def frame(schema, make, count):
        names = schema.names
        data = [tuple(make(i).get(n) for n in names) for i in range(count)]
        return spark.createDataFrame(data, schema)

    machines = frame(
        schemas.MACHINES,
        lambda i: {
            "Machine_ID": f"Machine_{i}",
            "Machine_Type": ("Press", "Lathe", None)[i % 3],
            "Workload": ("Low", "High")[i % 2],
        },
        30,
    )
    readings = frame(
        schemas.SENSOR_DATA,
        lambda i: {
            "Sensor_ID": i,
            "Machine_ID": owner[i],
            "Timestamp": start + timedelta(minutes=7 * i),
            "Temperature": float(60 + i % 5),
            "Vibration": float(i % 8),
            "Pressure": float(i % 16),
            "Humidity": 50.0,
            "Power_Consumption": 1.0,
        },
        2000,
    )
    records = frame(
        schemas.FAILURE_RECORDS,
        lambda i: {
            "Failure_ID": i,
            "Machine_ID": owner[i],
            "Failure_Status": int(i % 3 == 0),
            "Downtime": None if i % 11 == 0 else float(i % 4),
            "Predicted_Failure_Probability": None if i % 13 == 0 else (i % 65) / 64,
        },
        600,
    )
    jobs = frame(
        schemas.MAINTENANCE_SCHEDULE,
        lambda i: {
            "Maintenance_ID": i,
            "Machine_ID": owner[i],
            "Scheduled_Date": start.date() + timedelta(days=i % 50),
            "Maintenance_Type": ("Preventive", "Corrective")[i % 2],
            "Estimated_Cost": float(i % 6),
            "Estimated_Duration": None if i % 17 == 0 else float(1 + i % 3),
        },
        300,
    )
    return Tables.empty(
        spark, machines=machines, sensor_data=readings, failure_records=records, maintenance_schedule=jobs
    )


def _mean(values):
    known = [v for v in values if v is not None]
    return sum(known) / len(known) if known else None


@pytest.mark.parametrize("broadcast", [True, False])
def test_hot_machine_against_brute_force(skewed, request, rows, broadcast):
    if not broadcast:
        request.getfixturevalue("no_broadcast")
    readings, records = skewed.sensor_data.collect(), skewed.failure_records.collect()
    jobs, machines = skewed.maintenance_schedule.collect(), skewed.machines.collect()

    by_temperature, trend = defaultdict(list), defaultdict(list)
    failed = {r.Machine_ID for r in records if r.Failure_Status == 1}
    for s in readings:
        for f in records:
            if f.Machine_ID == s.Machine_ID and f.Failure_Status == 1:
                by_temperature[s.Temperature].append(f.Predicted_Failure_Probability)
        if s.Machine_ID in failed:
            trend[s.Timestamp.strftime("%Y-%m-%d %H:00:00")].append(s.Pressure)
    found = dict(rows(sensors.failure_probability_by_temperature(skewed)))
    assert found == {t: _mean(p) for t, p in by_temperature.items()}

    hourly = sensors.sensor_trends_hourly_failed_machines(skewed).where("name = 'Pressure'")
    assert dict(rows(hourly, "timestamp", "value")) == {h: _mean(v) for h, v in trend.items()}

    before, after, benefit = defaultdict(list), defaultdict(list), defaultdict(float)
    for j in jobs:
        mine = [f for f in records if f.Machine_ID == j.Machine_ID]
        benefit[j.Estimated_Cost] += sum(f.Downtime or 0 for f in mine)
        for f in mine:
            if f.Downtime is not None and j.Estimated_Duration is not None:
                before[j.Maintenance_Type].append(f.Downtime)
                after[j.Maintenance_Type].append(j.Estimated_Duration)
    impact = {k: (pytest.approx(_mean(before[k])), pytest.approx(_mean(after[k]))) for k in before}
    assert {k: (b, a) for k, b, a in rows(maintenance.maintenance_impact(skewed))} == impact
    assert dict(rows(maintenance.cost_benefit(skewed, "2024-01-01"))) == dict(benefit)

    kinds = {m.Machine_ID: m.Machine_Type for m in machines}
    rates = defaultdict(list)
    for f in records:
        if f.Machine_ID in kinds:
            rates[kinds[f.Machine_ID]].append(f.Failure_Status)
    found = dict(rows(failures.failure_rate_by_machine_type(skewed)))
    assert found == {k: pytest.approx(100 * _mean(v), abs=0.0051) for k, v in rates.items()}

    total = sum(max(1, sum(f.Machine_ID == m.Machine_ID for f in records)) for m in machines)
    assert fleet.fleet_overview(skewed).first()["total_machines"] == total
    assert fleet.machine_status(skewed).count() == total
    assert fleet.operational_machine_count(skewed).first()[0] == sum(
        m.Machine_ID not in failed for m in machines
    )


def test_upsert_query_joins_each_failed_machine_once(spark):
    from checks.pipeline_checks import machines_upsert

    plan = machines_upsert(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    (at,) = [i for i, line in enumerate(lines) if "Join LeftSemi" in line]
    depth = lines[at].index("Join LeftSemi")
    below = []
    for line in lines[at + 1 :]:
        if len(line) - len(line.lstrip(" :+-")) <= depth:
            break
        below.append(line)
    assert any("Aggregate [Machine_ID" in line for line in below)

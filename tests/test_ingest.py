"""CSV reading and the load into the fleet tables."""

import os
from concurrent.futures import ThreadPoolExecutor
from datetime import date

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import pipeline_checks
from fleetwarden import Tables, schemas
from fleetwarden.operators import fleet, ingest, maintenance, sensors
from fleetwarden.sources import telemetry_csv
from fleetwarden.sources.bucketed import BucketedTable
from fleetwarden.sources.commit_log import Files
from fleetwarden.sources.loads import PARTITION_IDS, LoadLog
from fleetwarden.sources.telemetry_csv import CORRUPT, SOURCE_ORDER, read_telemetry_csv

DEFAULTS = {
    "Machine_Type": "Hydraulic Press",
    "Installation_Date": "2020-01-31",
    "Age": "4.5",
    "Workload": "High",
    "Production_Rate": "1500.0",
    "Operational_Hours": "2000",
    "Last_Maintenance_Date": "2024-01-05",
    "Maintenance_Type": "Preventive",
    "Maintenance_Cost ($)": "100.5",
    "Maintenance_Duration (hrs)": "2",
    "Temperature (°C)": "70.5",
    "Vibration (mm/s)": "1.5",
    "Pressure (psi)": "120",
    "Humidity (%)": "50",
    "Voltage (V)": "220",
    "Current (A)": "10",
    "Power_Consumption (kW)": "3",
    "Ambient_Temperature (°C)": "25",
    "Ambient_Humidity (%)": "60",
    "Anomaly_Score": "0.25",
    "Anomaly_Flag": "0",
    "Failure_Status": "0",
    "Predicted_Failure_Probability": "0.5",
}


def write_csv(path, rows, header=None):
    header = header or list(schemas.TELEMETRY_HEADERS)
    lines = [",".join(header)]
    for row in rows:
        lines.append(row if isinstance(row, str) else ",".join((DEFAULTS | row).get(h, "") for h in header))
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def reading(machine, at, **columns):
    return {"Machine_ID": machine, "Timestamp": at} | columns


def test_columns_are_matched_by_name(spark, tmp_path):
    header = ["Extra", *reversed(schemas.TELEMETRY_HEADERS)]
    path = write_csv(tmp_path / "t.csv", [reading("m", "2024-01-01 10:00:00.25")], header)
    row = read_telemetry_csv(spark, path).first()
    assert (row["Machine_ID"], row["Temperature"], row["Production_Rate"]) == ("m", 70.5, 1500)
    assert row["Timestamp"].microsecond == 250000
    assert row[CORRUPT] is None


def test_missing_columns_are_named(spark, tmp_path):
    header = [h for h in schemas.TELEMETRY_HEADERS if h != "Workload"]
    path = write_csv(tmp_path / "t.csv", [reading("m", "2024-01-01")], header)
    with pytest.raises(ValueError, match="Workload"):
        read_telemetry_csv(spark, path)


def test_values_are_cleaned(spark, tmp_path):
    path = write_csv(
        tmp_path / "t.csv",
        [
            reading("m", "2024-01-01", Workload=" high ", Maintenance_Type="CORRECTIVE"),
            reading("m", "2024-01-01", **{"Temperature (°C)": "NaN", "Machine_Type": " Lathe "}),
        ],
    )
    first, second = read_telemetry_csv(spark, path).orderBy("Reading_ID").collect()
    assert (first["Workload"], first["Maintenance_Type"]) == ("High", "Corrective")
    assert (second["Temperature"], second["Machine_Type"]) == (None, "Lathe")


def test_last_row_in_file_order_wins(spark, tmp_path, monkeypatch):
    """The file is read in many pieces, so position is not the order tasks finish in."""
    path = write_csv(
        tmp_path / "t.csv",
        [reading(f"m{i % 7}", "2024-01-01", Operational_Hours=str(i)) for i in range(3000)],
    )
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        feed = read_telemetry_csv(spark, path)
        assert feed.select(F.spark_partition_id()).distinct().count() > 3
        last = ingest.latest_rows(feed, list(SOURCE_ORDER))
        hours = {r["Machine_ID"]: r["Operational_Hours"] for r in last.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert hours == {f"m{i % 7}": i for i in range(2993, 3000)}


def test_upsert_replaces_all_but_the_industry(spark):
    known = [("a", "Old", *[None] * 9, "Energy"), ("b", "Kept", *[None] * 9, "General")]
    existing = spark.createDataFrame(known, schemas.MACHINES)
    columns = [*schemas.MACHINES.names[:-1], "place"]
    incoming = spark.createDataFrame(
        [
            ("a", "Middle", *[None] * 6, "Preventive", None, None, 1),
            ("a", None, *[None] * 6, "Corrective", None, None, 2),
            ("c", "New", *[None] * 9, 3),
            (None, "Nameless", *[None] * 9, 4),
        ],
        "Machine_ID string, Machine_Type string, Installation_Date date, Age double, Workload string,"
        "Production_Rate int, Operational_Hours int, Last_Maintenance_Date date,"
        "Maintenance_Type string, Maintenance_Cost double, Maintenance_Duration double, place bigint",
    )
    assert incoming.columns == columns
    merged = ingest.upsert_machines(existing, incoming, ["place"])
    assert merged.columns == schemas.MACHINES.names
    found = {r["Machine_ID"]: (r["Machine_Type"], r["Maintenance_Type"], r["Industry"]) for r in merged.collect()}
    assert found == {
        "a": (None, "Corrective", "Energy"),
        "b": ("Kept", None, "General"),
        "c": ("New", None, None),
    }


def test_industry_rule(spark, rows):
    ids = ["Machine_001", "Machine_10", "Machine_2", "Machine_3", "MachineX1", "Press"]
    machines = spark.createDataFrame([(i,) for i in ids], "Machine_ID string")
    assert dict(rows(ingest.assign_industry(machines))) == {
        "Machine_001": "Manufacturing",
        "Machine_10": "Energy",
        "Machine_2": "Automotive",
        "Machine_3": "General",
        "MachineX1": "Energy",
        "Press": "General",
    }


def _report(frame):
    return {r["table"]: (r["status"], r["rows"]) for r in frame.collect()}


def test_load_is_repeatable_and_keeps_other_loads(spark, tmp_path, rows):
    root = str(tmp_path / "warehouse")
    first = write_csv(
        tmp_path / "first.csv",
        [
            reading("a", "2024-01-01 10:00:00", Failure_Status="1", Failure_Type="Overheating"),
            reading("a", "2024-01-02 11:00:00", Last_Maintenance_Date="", Maintenance_Type=""),
            reading("b", "2024-01-02 12:00:00", Maintenance_Type="", Predicted_Failure_Probability=""),
            reading("b", "2024-01-02 12:30:00", **{"Temperature (°C)": "hot"}),
            "too,short",
        ],
    )
    expected = {
        "machines": ("loaded", 2),
        "sensor_data": ("loaded", 3),
        "failure_records": ("loaded", 1),
        "maintenance_schedule": ("loaded", 2),
        "anomaly_detection": ("loaded", 3),
        "machine_health_indicators": ("loaded", 3),
        "failure_trends": ("loaded", 2),
        "sensor_hourly": ("loaded", 3),
        "quarantine": ("loaded", 2),
    }
    assert _report(ingest.run_etl(spark, first, root)) == expected
    assert _report(ingest.run_etl(spark, first, root)) == expected
    t = Tables.from_warehouse(spark, root)
    assert t.sensor_data.count() == 3
    assert t.machines.count() == 2

    second = write_csv(tmp_path / "second.csv", [reading("b", "2024-01-03 01:00:00", Age="9")])
    ingest.run_etl(spark, second, root)
    t = Tables.from_warehouse(spark, root)
    assert t.sensor_data.count() == 4
    assert t.sensor_data.select("Sensor_ID").distinct().count() == 4
    assert rows(t.machines, "Machine_ID", "Age") == [("a", 4.5), ("b", 9.0)]
    assert rows(t.maintenance_schedule, "Machine_ID", "Maintenance_Type", "Estimated_Cost") == [
        ("a", "Preventive", 100.5),
        ("b", "Preventive", 100.5),
        ("b", "Unknown", 100.5),
    ]
    assert rows(t.machine_health_indicators, "Health_Score", "Failure_Probability") == [
        (0.75, 0.0),
        (0.75, 0.5),
        (0.75, 0.5),
        (0.75, 0.5),
    ]
    # Reports run on what was loaded.
    assert rows(sensors.pressure_trend_latest_day(t)) == [("2024-01-03 01:00:00", 120.0)]
    assert fleet.machine_status(t).count() == 2
    assert {r["Industry"] for r in t.machines.collect()} == {"General"}
    shares = dict(rows(sensors.sensor_contribution(t)))
    assert set(shares) == set(sensors.MEASURED) and set(shares.values()) == {25.0}
    assert maintenance.mtbf_monthly(t).count() == 0
    measured = spark.createDataFrame([(date(2024, 1, 5), 1.0, 2.0)], schemas.MAINTENANCE_EFFECTIVENESS)
    measured.write.parquet(f"{root}/maintenance_effectiveness")
    t = Tables.from_warehouse(spark, root)
    assert rows(maintenance.mtbf_monthly(t)) == [("2024-01", 1.0, 2.0)]


def test_rerun_of_an_old_load_keeps_newer_machines(spark, tmp_path, rows):
    root = str(tmp_path / "warehouse")
    first = write_csv(tmp_path / "first.csv", [reading(m, "2024-01-01", Age="1") for m in "ab"])
    second = write_csv(tmp_path / "second.csv", [reading("b", "2024-01-02", Age="2")])
    for path in (first, second):
        ingest.run_etl(spark, path, root)
    write_csv(tmp_path / "first.csv", [reading(m, "2024-01-01", Age="3") for m in "abc"])
    ingest.run_etl(spark, first, root)
    t = Tables.from_warehouse(spark, root)
    assert rows(t.machines, "Machine_ID", "Age") == [("a", 3.0), ("b", 2.0), ("c", 3.0)]
    assert t.machines.columns == schemas.MACHINES.names
    assert t.sensor_data.count() == 4
    assert t.sensor_data.select("Sensor_ID").distinct().count() == 4
    loads = {r["load_id"]: (r["load_order"], r["runs"], r["status"]) for r in LoadLog(spark, root).loads().collect()}
    assert loads == {"first.csv": (1, 2, "loaded"), "second.csv": (2, 1, "loaded")}


def test_loads_at_once_get_their_own_ids(spark, tmp_path):
    root = str(tmp_path / "w")
    with ThreadPoolExecutor(8) as pool:
        begun = list(pool.map(lambda i: LoadLog(spark, root).begin(f"load {i}", 3), range(8)))
    ranges = sorted((b.first_id, b.last_id) for b in begun)
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    assert all(last - first + 1 == 3 * PARTITION_IDS for first, last in ranges)
    assert sorted(b.order for b in begun) == list(range(1, 9))
    entries = LoadLog(spark, root).log.entries()
    assert [e["n"] for e in entries] == list(range(1, 9))


def test_log_entries_are_never_replaced(spark, tmp_path):
    files = Files(spark, str(tmp_path))
    assert files.write_new(f"{tmp_path}/1.json", b"one")
    assert not files.write_new(f"{tmp_path}/1.json", b"two")
    assert (tmp_path / "1.json").read_bytes() == b"one"
    assert [n for n in os.listdir(tmp_path) if "json-" in n and not n.endswith(".crc")] == []


KEYED = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.IntegerType())])


def _stamps(folder):
    return {str(f): f.stat().st_mtime_ns for f in folder.rglob("*.parquet")}


def _put(table, spark, rows):
    new = spark.createDataFrame(rows, KEYED)
    return table.merge(new, lambda old: old.join(new, "key", "left_anti").unionByName(new))


def test_merge_leaves_other_buckets_alone(spark, tmp_path, rows):
    table = BucketedTable(spark, str(tmp_path / "t"), KEYED, "key", buckets=16)
    assert table.read().count() == 0
    assert _put(table, spark, [(f"k{i}", i) for i in range(200)]) == 200
    before = _stamps(tmp_path / "t")
    written = _put(table, spark, [("k7", -7), ("k7 new", 1)])
    after = _stamps(tmp_path / "t")
    assert written < 200 / 16 * 2 * 3
    assert {f: t for f, t in after.items() if f in before} == before
    assert 1 <= len({f.rsplit("/", 2)[1] for f in set(after) - set(before)}) <= 2
    found = dict(rows(table.read()))
    assert found == {**{f"k{i}": i for i in range(200)}, "k7": -7, "k7 new": 1}
    assert _put(table, spark, []) == 0


def test_old_versions_of_a_bucket_go(spark, tmp_path, rows):
    table = BucketedTable(spark, str(tmp_path / "t"), KEYED, "key", buckets=1)
    for i in range(4):
        _put(table, spark, [("a", i)])
    assert len({f.rsplit("/", 3)[1] for f in _stamps(tmp_path / "t")}) == 2
    assert rows(BucketedTable(spark, str(tmp_path / "t"), KEYED, "key", buckets=5).read()) == [("a", 3)]


def test_a_merge_overtaken_by_another_starts_again(spark, tmp_path, rows):
    table = BucketedTable(spark, str(tmp_path / "t"), KEYED, "key", buckets=1)
    _put(table, spark, [("a", 1)])
    other = BucketedTable(spark, str(tmp_path / "t"), KEYED, "key")
    calls = []
    new = spark.createDataFrame([("b", 2)], KEYED)

    def merged(old):
        calls.append(1)
        if len(calls) == 1:
            _put(other, spark, [("c", 3)])
        return old.unionByName(new)

    table.merge(new, merged)
    assert len(calls) == 2 and rows(table.read()) == [("a", 1), ("b", 2), ("c", 3)]


def test_overrides_hold_for_the_loads_before_them(spark, tmp_path, rows):
    root = str(tmp_path / "warehouse")
    first = write_csv(tmp_path / "first.csv", [reading(m, "2024-01-01") for m in "ab"])
    ingest.run_etl(spark, first, root)
    dates = [("a", date(2025, 1, 1)), ("a", date(2025, 3, 3)), (None, date(2025, 1, 1)), ("b", None)]
    ingest.keep_overrides(spark, root, spark.createDataFrame(dates, schemas.SCHEDULE_OVERRIDES))
    second = write_csv(tmp_path / "second.csv", [reading("a", "2024-02-01")])
    for path in (second, first):  # a later load, and the first one again
        ingest.run_etl(spark, path, root)
    schedule = Tables.from_warehouse(spark, root).maintenance_schedule
    assert rows(schedule, "Machine_ID", "Scheduled_Date") == [
        ("a", date(2024, 1, 5)),
        ("a", date(2025, 3, 3)),
        ("b", date(2024, 1, 5)),
    ]
    again = spark.createDataFrame([("a", date(2026, 6, 6))], schemas.SCHEDULE_OVERRIDES)
    ingest.keep_overrides(spark, root, again)
    schedule = Tables.from_warehouse(spark, root).maintenance_schedule
    assert {r["Scheduled_Date"] for r in schedule.where("Machine_ID = 'a'").collect()} == {date(2026, 6, 6)}


def test_all_failures_can_be_loaded(spark, tmp_path):
    path = write_csv(tmp_path / "f.csv", [reading("a", "2024-01-01"), reading("b", "2024-01-01", Failure_Status="1")])
    report = ingest.run_etl(spark, path, str(tmp_path / "w"), include_all=True)
    assert _report(report)["failure_records"] == ("loaded", 2)


def test_failed_load_does_not_stop_the_next(spark, tmp_path, monkeypatch):
    def broken(*_):
        raise RuntimeError("disk full")

    monkeypatch.setattr(ingest, "to_anomaly_detection", broken)
    path = write_csv(tmp_path / "x.csv", [reading("a", "2024-01-01")])
    report = {r["table"]: r for r in ingest.run_etl(spark, path, str(tmp_path / "w")).collect()}
    assert (report["anomaly_detection"]["status"], report["anomaly_detection"]["error"]) == ("failed", "disk full")
    assert report["machine_health_indicators"]["status"] == "loaded"


def test_overrides_reach_every_row_of_a_machine(spark, rows):
    schedule = spark.sql(
        """SELECT * FROM VALUES (1L, 'a', DATE '2024-01-01'), (2L, 'a', DATE '2024-02-01'),
        (3L, 'b', DATE '2024-03-01') AS s(Maintenance_ID, Machine_ID, Scheduled_Date)"""
    )
    dates = spark.sql("SELECT 'a' AS Machine_ID, DATE '2025-05-05' AS Scheduled_Date")
    moved = ingest.apply_schedule_overrides(schedule, dates)
    assert moved.columns == schedule.columns
    assert [str(d) for _, d in rows(moved, "Maintenance_ID", "Scheduled_Date")] == [
        "2025-05-05",
        "2025-05-05",
        "2024-03-01",
    ]


def test_last_override_counts_once(spark, rows):
    schedule = spark.sql("SELECT 1L AS Maintenance_ID, 'a' AS Machine_ID, DATE '2024-01-01' AS Scheduled_Date")
    dates = spark.sql(
        """SELECT * FROM VALUES ('a', DATE '2025-05-05', 1), ('a', DATE '2025-01-01', 2)
        AS o(Machine_ID, Scheduled_Date, given)"""
    )
    moved = ingest.apply_schedule_overrides(schedule, dates, "given")
    assert [str(r["Scheduled_Date"]) for r in moved.collect()] == ["2025-01-01"]


def test_written_csv_reads_back(spark, tmp_path):
    path = write_csv(tmp_path / "t.csv", [reading("a", "2024-01-01 10:00:00.123456", Failure_Type="x")])
    feed = read_telemetry_csv(spark, path).select(*schemas.TELEMETRY.names)
    telemetry_csv.write_telemetry_csv(feed, str(tmp_path / "out"))
    again = read_telemetry_csv(spark, str(tmp_path / "out")).select(*schemas.TELEMETRY.names)
    assert again.collect() == feed.collect()


def test_written_csv_is_compressed_in_bounded_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(telemetry_csv, "FILE_ROWS", 3)
    rows = [reading(f"m{i}", "2024-01-01 10:00:00") for i in range(10)]
    feed = read_telemetry_csv(spark, write_csv(tmp_path / "t.csv", rows))
    dealt = feed.withColumn("load", F.when(F.col("Machine_ID") < "m4", "a").otherwise("b"))
    telemetry_csv.write_telemetry_csv(dealt.coalesce(1), str(tmp_path / "out"), "load")
    for load, files in (("a", 2), ("b", 2)):
        names = [n for n in os.listdir(tmp_path / "out" / f"load={load}") if n.endswith(".csv.gz")]
        assert len(names) == files
        again = read_telemetry_csv(spark, str(tmp_path / "out" / f"load={load}"))
        own = [r[0] for r in again.orderBy(*SOURCE_ORDER).select("Machine_ID").collect()]
        assert own == [f"m{i}" for i in (range(4) if load == "a" else range(4, 10))]


def test_staged_files_have_bounded_rows(spark, tmp_path, monkeypatch):
    """Readers pack files by bytes, so rows that compress well would make tasks of any size."""
    monkeypatch.setattr(ingest.warehouse, "FILE_ROWS", 3)
    rows = [reading(f"m{i}", "2024-01-01 10:00:00") for i in range(10)]
    ingest.run_etl(spark, write_csv(tmp_path / "t.csv", rows), str(tmp_path / "w")).collect()
    folder = f"{tmp_path}/w/telemetry"
    files = spark.read.option("recursiveFileLookup", True).parquet(folder)
    sizes = [r[0] for r in files.groupBy("_metadata.file_path").count().select("count").collect()]
    assert sum(sizes) == 10 and max(sizes) <= 3
    # Loads of before lie in folders of days.
    files.drop("event_date").write.parquet(f"{folder}/load_id=a old/event_date=2024-01-01")
    staged = ingest.staged_telemetry(spark, str(tmp_path / "w"))
    assert staged.schema.names[-2:] == ["event_date", "load_id"]
    found = {tuple(map(str, r)) for r in staged.groupBy("load_id", "event_date").count().collect()}
    assert found == {("t.csv", "2024-01-01", "10"), ("a old", "2024-01-01", "10")}


def test_two_loads_come_from_one_pass_over_the_feed(spark, monkeypatch):
    passes = []
    plain = pipeline_checks.write_telemetry_csv

    def counted(*given):
        passes.append(given)
        plain(*given)

    monkeypatch.setattr(pipeline_checks, "write_telemetry_csv", counted)
    assert pipeline_checks.etl_rerun_order(spark, "/root/testdata/sf0.001").count() == 200
    assert len(passes) == 1

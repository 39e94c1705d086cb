"""Streams over files, run to the end of what is there."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from checks.sample import wide_telemetry
from fleetwarden import schemas
from fleetwarden.operators import sensors
from fleetwarden.streaming import alerts, hourly
from fleetwarden.streaming import ingest as stream_ingest

START = datetime(2024, 1, 1)


def _readings(spark, rows):
    """(machine, minutes after the start, temperature) rows."""
    columns = schemas.SENSOR_DATA.names
    full = [
        tuple(
            {"Machine_ID": m, "Timestamp": START + timedelta(minutes=at), "Temperature": v}.get(c)
            for c in columns
        )
        for m, at, v in rows
    ]
    return spark.createDataFrame(full, schemas.SENSOR_DATA)


def _run(stream, folder):
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def _source(spark, folder, schema):
    os.makedirs(f"{folder}/in", exist_ok=True)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def _drop(frame, folder):
    frame.coalesce(1).write.mode("append").parquet(f"{folder}/in")


def test_closed_hours_equal_the_batch_report(spark, small, tmp_path):
    _drop(small.sensor_data, tmp_path)
    stream = _source(spark, tmp_path, small.sensor_data.schema)
    streamed = _run(hourly.hourly_sensor_averages(stream, ["Anomaly_Score"]), tmp_path)
    found = {
        r["hour"].strftime("%Y-%m-%d %H:00:00"): r["Anomaly_Score"] for r in streamed.collect()
    }
    batch = dict(tuple(r) for r in sensors.anomaly_hourly(small).collect())
    last = max(batch)
    assert found.items() <= batch.items()
    assert set(batch) - set(found) <= {h for h in batch if h >= last[:11] + "00"}
    assert len(batch) - len(found) <= 3


def test_late_rows_within_the_watermark_count(spark, tmp_path):
    stream = _source(spark, tmp_path, schemas.SENSOR_DATA)
    averages = hourly.hourly_sensor_averages(stream, ["Temperature"])
    _drop(_readings(spark, [("a", 10, 10.0), ("a", 90, 20.0)]), tmp_path)
    assert _run(averages, tmp_path).count() == 0  # the watermark is at 00:30
    _drop(_readings(spark, [("b", 50, 30.0), ("a", 200, 0.0)]), tmp_path)  # late, but in time
    closed = _run(averages, tmp_path).orderBy("hour").collect()
    assert [(r["hour"].hour, r["Temperature"], r["readings"]) for r in closed] == [(0, 20.0, 2), (1, 20.0, 1)]
    _drop(_readings(spark, [("b", 55, 99.0), ("a", 400, 0.0)]), tmp_path)  # too late for hour 0
    again = {r["hour"].hour: r["Temperature"] for r in _run(averages, tmp_path).collect()}
    assert again[0] == 20.0


def test_averages_per_machine_type(spark, tmp_path):
    machines = spark.createDataFrame([("a", "Press"), ("b", "Lathe")], "Machine_ID string, Machine_Type string")
    stream = _source(spark, tmp_path, schemas.SENSOR_DATA)
    averages = hourly.hourly_sensor_averages(stream, ["Temperature"], machines)
    _drop(_readings(spark, [("a", 1, 10.0), ("a", 2, 20.0), ("b", 3, 7.0), ("z", 4, 1.0), ("a", 600, 0.0)]), tmp_path)
    found = {r["Machine_Type"]: r["Temperature"] for r in _run(averages, tmp_path).collect()}
    assert found == {"Press": 15.0, "Lathe": 7.0}


def test_alerts_need_no_state(spark, small, tmp_path, rows):
    telemetry = wide_telemetry(spark, small).select(*schemas.TELEMETRY.names)
    _drop(telemetry, tmp_path)
    stream = _source(spark, tmp_path, telemetry.schema)
    assert rows(_run(alerts.classify_alerts(stream), tmp_path)) == rows(alerts.classify_alerts(telemetry))


@pytest.fixture
def telemetry_rows(spark, small):
    return wide_telemetry(spark, small).select(*schemas.TELEMETRY.names)


def test_repeated_delivery_is_loaded_once(spark, small, tmp_path, telemetry_rows):
    _drop(telemetry_rows, tmp_path)
    late = telemetry_rows.agg(F.max("Timestamp")).first()[0] - timedelta(minutes=30)
    _drop(telemetry_rows.where(F.col("Timestamp") >= F.lit(late).cast("timestamp_ntz")), tmp_path)
    stream = _source(spark, tmp_path, telemetry_rows.schema)
    root = f"{tmp_path}/warehouse"
    query = (
        stream_ingest.load_stream(stream, root)
        .option("checkpointLocation", f"{tmp_path}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    for table in stream_ingest.TABLES:
        loaded = spark.read.parquet(f"{root}/{table}")
        assert loaded.count() == telemetry_rows.count()
        assert loaded.select("Machine_ID", "Timestamp").distinct().count() == loaded.count()


def test_new_queries_and_equal_instants_keep_every_row(spark, tmp_path, telemetry_rows):
    """A second query adds to what the first one loaded; readings of one instant differ."""
    first = telemetry_rows.where("Timestamp < '2024-01-10'")
    other = first.withColumn("Temperature", F.col("Temperature") + 1)
    root, total = f"{tmp_path}/warehouse", 0
    for n, part in enumerate((first.unionAll(other), telemetry_rows.where("Timestamp >= '2024-01-10'"))):
        folder = f"{tmp_path}/{n}"
        _drop(part, folder)
        query = (
            stream_ingest.load_stream(_source(spark, folder, telemetry_rows.schema), root)
            .option("checkpointLocation", f"{folder}/state")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        total += part.count()
    for table, key in stream_ingest.KEYS.items():
        loaded = spark.read.parquet(f"{root}/{table}")
        assert loaded.count() == total and loaded.where(F.col(key).isNull()).count() == 0
    assert spark.read.parquet(f"{root}/sensor_data").select("Sensor_ID").distinct().count() == total


def test_machine_table_of_the_hourly_stream_is_not_broadcast(spark, tmp_path):
    _drop(_readings(spark, [("a", 10, 10.0), ("b", 20, 30.0), ("a", 400, 0.0)]), tmp_path)
    machines = spark.createDataFrame([("a", "X"), ("b", "X")], "Machine_ID string, Machine_Type string")
    stream = _source(spark, tmp_path, schemas.SENSOR_DATA)
    averages = hourly.hourly_sensor_averages(stream, ["Temperature"], machines)
    query = (
        averages.writeStream.format("memory").queryName("typed_hours")
        .option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    plan = query._jsq.explainInternal(False)
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    found = spark.table("typed_hours").select("Machine_Type", "Temperature", "readings").collect()
    assert [tuple(r) for r in found] == [("X", 20.0, 2)]


def test_state_of_repeats_is_a_digest_that_sees_where_nulls_are(spark, tmp_path, telemetry_rows):
    source, state = f"{tmp_path}/in", f"{tmp_path}/state"
    row = telemetry_rows.limit(1).withColumns({"Temperature": F.lit(5.0), "Vibration": F.lit(None).cast("double")})
    moved = row.withColumns({"Temperature": F.lit(None).cast("double"), "Vibration": F.lit(5.0)})
    _drop(row.unionByName(row).unionByName(moved), source)
    writer = stream_ingest.load_stream(_source(spark, source, telemetry_rows.schema), f"{tmp_path}/w")
    writer.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/w/sensor_data").count() == 2
    keys = spark.read.format("statestore").load(state).schema["key"].dataType
    assert [f.dataType.simpleString() for f in keys] == ["bigint", "bigint"]

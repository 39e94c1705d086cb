"""The jobs one after the other, from a feed to scores."""

import json

import pytest

from checks.report_checks import REPORTS
from checks.sample import wide_telemetry
from fleetwarden import Tables, catalog, jobs
from fleetwarden.operators import training
from fleetwarden.operators.presentation import DISPLAY_ORDER
from fleetwarden.sources.telemetry_csv import write_telemetry_csv
from tests.test_model import COMPLETE


def test_catalog_has_every_report():
    names = {*catalog.TIMELESS, *catalog.CLOCKED}
    assert {n for n in REPORTS if not n.endswith("_by_machine")} == names
    assert set(DISPLAY_ORDER) <= names


def test_feed_to_scores(spark, small, tmp_path):
    feed, root, model, out = (str(tmp_path / n) for n in ("feed.csv", "warehouse", "model", "scores"))
    write_telemetry_csv(wide_telemetry(spark, small), feed)
    jobs.run(spark, ["load", feed, root])
    report = str(tmp_path / "report")
    jobs.run(spark, ["report", root, "machine_status", report])
    assert spark.read.parquet(report).count() > 0
    jobs.run(spark, ["report", root, "maintenance_due_count", report, "--as-of", "2030-01-01"])
    assert spark.read.parquet(report).first()["due_count"] > 0
    jobs.run(spark, ["train", root, model, "--rounds", "2", "--depth", "2"])
    jobs.run(spark, ["train", root, model, "--rounds", "1", "--depth", "1"])
    measured = str(tmp_path / "measured")
    jobs.run(spark, ["evaluate", model, measured, "--version", "1"])
    report = {r["class"]: r for r in spark.read.parquet(f"{measured}/report").collect()}
    matrix = spark.read.parquet(f"{measured}/confusion_matrix").collect()
    assert report["accuracy"]["support"] == sum(r["Normal"] + r["Failure"] for r in matrix) > 0
    assert spark.read.parquet(f"{measured}/roc_curve").count() >= 2
    versions = training.model_versions(spark, model).orderBy("version").collect()
    assert [v["version"] for v in versions] == [1, 2]
    assert versions[0]["held_out_rows"] == report["accuracy"]["support"]
    assert versions[0]["accuracy"] == report["accuracy"]["precision"]
    dates = tmp_path / "dates.csv"
    machine = spark.read.parquet(f"{root}/maintenance_schedule").first()["Machine_ID"]
    dates.write_text(f"Machine_ID,Scheduled_Date\n{machine},2031-02-03\n")
    jobs.run(spark, ["override", root, str(dates)])
    schedule = Tables.from_warehouse(spark, root).maintenance_schedule.where(f"Machine_ID = '{machine}'")
    assert {str(r["Scheduled_Date"]) for r in schedule.collect()} == {"2031-02-03"}
    requests = tmp_path / "requests.jsonl"
    requests.write_text("\n".join(json.dumps(r) for r in (COMPLETE, {"age": 1})) + "\n")
    jobs.run(spark, ["score", model, str(requests), out])
    scores = spark.read.parquet(out).collect()
    assert sorted(r["error"] is None for r in scores) == [False, True]


def test_unknown_report_is_refused(spark, tmp_path):
    with pytest.raises(SystemExit):
        jobs.run(spark, ["report", str(tmp_path), "nothing", str(tmp_path)])

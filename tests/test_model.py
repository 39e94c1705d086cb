"""Features, requests, training and evaluation."""

import json
import random

import pytest
from pyspark.sql import functions as F

from checks.sample import sample_tables, wide_telemetry
from fleetwarden.operators import evaluation, features, scoring, training, trees
from fleetwarden.operators.features import FeatureSpec, fit_features

COMPLETE = {
    "age": 3, "temperature": 60, "vibration": 1, "pressure": 100, "humidity": 40, "voltage": 220,
    "current": 10, "power_consumption": 3, "downtime": 0, "production_rate": 100,
    "operational_hours": 500, "ambient_temperature": 20, "ambient_humidity": 50,
    "anomaly_score": 0.1, "anomaly_flag": 0, "predicted_failure_probability": 0.2,
    "machine_type": "Conveyor Belt", "workload": "Low", "maintenance_type": "Preventive",
}


def _parsed(spark, *requests):
    texts = [r if isinstance(r, str) else json.dumps(r) for r in requests]
    lines = spark.createDataFrame([(i, text) for i, text in enumerate(texts)], "id int, value string")
    parsed = scoring.parse_requests(lines).withColumn("reasons", scoring.request_reasons())
    return parsed.orderBy("id").collect()


def _without(name):
    return {k: v for k, v in COMPLETE.items() if k != name}


@pytest.mark.parametrize(
    "change, reasons",
    [
        ({}, ["No specific reasons."]),
        (
            {"temperature": 81, "vibration": 2.1, "anomaly_flag": 1},
            ["High temperature.", "Excessive vibration.", "Anomaly detected."],
        ),
        ({"temperature": 80}, ["No specific reasons."]),
        (
            {"pressure": 151, "humidity": 71, "downtime": 6, "anomaly_score": 0.51},
            ["High pressure.", "High humidity.", "Extended downtime.", "High anomaly score."],
        ),
    ],
)
def test_reasons(spark, change, reasons):
    (row,) = _parsed(spark, COMPLETE | change)
    assert (row["error"], row["reasons"]) == (None, reasons)


@pytest.mark.parametrize(
    "request_, error",
    [
        (_without("age"), "Missing fields: age"),
        ({"age": 1}, "Missing fields: " + ", ".join(n for n in COMPLETE if n != "age")),
        (COMPLETE | {"pressure": -1}, "Invalid value for pressure: Must be non-negative"),
        (
            COMPLETE | {"humidity": "wet", "pressure": -1, "voltage": -2},
            "Invalid value for pressure: Must be non-negative",
        ),
        (COMPLETE | {"humidity": "wet"}, "Invalid value for humidity: Must be a number"),
        ("not json", "Request must be JSON"),
        ("[1, 2]", "Request must be JSON"),
    ],
)
def test_rejected_requests(spark, request_, error):
    (row,) = _parsed(spark, request_)
    assert (row["error"], row["reasons"]) == (error, None)


def test_defaults_and_categories(spark):
    first, second = _parsed(
        spark,
        COMPLETE | {"machine_type": "Robot", "workload": None, "age": None, "anomaly_flag": None},
        COMPLETE | {"temperature": "81.5"},
    )
    assert first["error"] is None
    assert (first["machine_type"], first["workload"], first["maintenance_type"]) == (
        "Unknown",
        "Unknown",
        "Preventive",
    )
    assert (first["age"], first["anomaly_flag"]) == (0.0, 0.0)
    assert second["temperature"] == 81.5


def _telemetry(spark, kinds):
    columns = {name: 1.0 for name in features.NUMERIC}
    data = [
        {**columns, "Machine_Type": m, "Workload": w, "Maintenance_Type": t, "Failure_Status": 0}
        for m, w, t in kinds
    ]
    return spark.createDataFrame(data)


def test_lowest_level_is_left_out(spark):
    spec = fit_features(_telemetry(spark, [("B", "Low", None), ("A", "High", "Preventive")]))
    assert spec.levels == {
        "Machine_Type": ("B",),
        "Workload": ("Low",),
        "Maintenance_Type": ("Preventive",),
    }
    assert spec.columns[-3:] == ["Machine_Type_B", "Workload_Low", "Maintenance_Type_Preventive"]


def test_gaps_and_negatives_count_as_zero(spark):
    frame = _telemetry(spark, [("A", "Low", "x"), ("B", "Low", "y")])
    spec = fit_features(frame)
    dirty = frame.withColumn("Voltage", F.lit(-5.0)).withColumn("Age", F.lit(None).cast("double"))
    row = features.prepare_features(dirty, spec).first()
    assert (row["Voltage"], row["Age"], row["Current"]) == (0.0, 0.0, 1.0)


def test_many_levels_are_encoded_sparsely(spark):
    kinds = [(f"kind {k:05}", "Low", "x") for k in range(3000)]
    frame = _telemetry(spark, kinds)
    spec = fit_features(frame)
    assert [len(found) for found in spec.levels.values()] == [2999, 0, 0]
    rows = features.training_rows(frame, spec, "Machine_Type").collect()
    width = len(features.NUMERIC)
    for row in rows:
        hot = int(row["Machine_Type"].removeprefix("kind ")) - 1  # the lowest level has no entry
        assert row["features"].size == width + 2999
        entries = [int(i) - width for i in row["features"].indices if i >= width]
        assert entries == ([hot] if hot >= 0 else [])


def test_vector_equals_columns(spark):
    frame = _telemetry(spark, [("B", "Low", None), ("A", "High", "Preventive"), ("C", "Low", "x")])
    spec = fit_features(frame)
    other = _telemetry(spark, [("Z", None, "Preventive"), ("B", "Low", "unseen")])
    both = frame.unionByName(other).withColumn("Voltage", F.lit(-3.0))
    vectors = [r["features"].toArray().tolist() for r in features.training_rows(both, spec).collect()]
    columns = [list(r) for r in both.select(*spec.expressions()).collect()]
    assert sorted(vectors) == sorted(columns)


@pytest.fixture(scope="module")
def trained(spark, small, tmp_path_factory):
    telemetry = wide_telemetry(spark, small)
    root = str(tmp_path_factory.mktemp("model"))
    report = training.train_and_keep(telemetry, root, "Sensor_ID", rounds=3, depth=3)
    assert {r["class"] for r in report.collect()} == {"0", "1", "accuracy", "macro avg", "weighted avg"}
    model, spec = training.load_model(spark, root)
    assert spec == fit_features(telemetry)
    return model, spec, root


def test_split_is_whole_and_stable(spark, small, trained):
    root = trained[2]
    train, held_out = (training.kept_rows(spark, root, part) for part in (False, True))
    everyone = wide_telemetry(spark, small).select("Sensor_ID")
    assert train.count() + held_out.count() == everyone.count()
    assert train.join(held_out, "Sensor_ID").count() == 0
    assert 0.7 < train.count() / everyone.count() < 0.9
    again, _ = training.train_test_split(everyone.repartition(7), "Sensor_ID")
    assert again.exceptAll(train.select("Sensor_ID")).count() == 0
    assert again.count() == train.count()


def test_saved_model_scores_the_same(spark, trained):
    model, _, root = trained
    held_out = training.kept_rows(spark, root, held_out=True)
    loaded, _ = training.load_model(spark, root)
    ours = {r["Sensor_ID"]: r["score"] for r in training.scored(model, held_out).collect()}
    theirs = {r["Sensor_ID"]: r["score"] for r in training.scored(loaded, held_out).collect()}
    assert ours == theirs
    assert all(0 <= score <= 1 for score in ours.values())


def test_trees_as_a_table_score_as_the_model_does(spark, small, trained):
    model, spec, root = trained
    telemetry = wide_telemetry(spark, small)
    table = training.load_trees(spark, root)
    assert table.where("node = 0").count() == table.select("tree").distinct().count() == 3
    walked = trees.with_margin(telemetry, table, features.NUMERIC)
    ours = walked.select("Sensor_ID", trees.failure_probability(F.col("margin")).alias("ours"))
    theirs = training.scored(model, features.training_rows(telemetry, spec, "Sensor_ID"))
    both = ours.join(theirs.select("Sensor_ID", "score"), "Sensor_ID").collect()
    assert len(both) == telemetry.count()
    assert all(abs(r["ours"] - r["score"]) < 1e-12 for r in both)


def test_trees_ask_for_levels_and_gaps(spark):
    rows = [("a", None, 1.0), ("b", "High", None), (None, "Low", -5.0)]
    frame = spark.createDataFrame(rows, "Machine_Type string, Workload string, Age double")
    frame = frame.withColumn("Maintenance_Type", F.lit(None).cast("string"))
    nodes = [
        (0, 1.0, 0, "Machine_Type", "b", 0.5, 1, 2, None, 2),
        (0, 1.0, 1, "Age", None, 0.0, 3, 4, None, 2),
        (0, 1.0, 2, None, None, None, -1, -1, 8.0, 2),
        (0, 1.0, 3, None, None, None, -1, -1, 2.0, 2),
        (0, 1.0, 4, None, None, None, -1, -1, 4.0, 2),
        (1, 0.5, 0, None, None, None, -1, -1, 1.0, 2),
    ]
    kinds = "tree int, weight double, node int, source string, level string, threshold double, left int, right int, leaf double, depth int"
    table = spark.createDataFrame(nodes, kinds)
    found = trees.with_margin(frame, table, ("Age",)).select("Machine_Type", "margin").collect()
    assert {r["Machine_Type"]: r["margin"] for r in found} == {"a": 4.5, "b": 8.5, None: 2.5}


def test_trees_written_out_give_the_margins_of_the_arrays(spark, small, trained, monkeypatch):
    table = training.load_trees(spark, trained[2])
    rows = wide_telemetry(spark, small).withColumn("Age", F.when(F.col("Sensor_ID") % 7 > 0, F.col("Age")))
    rows = rows.withColumn("Humidity", F.when(F.col("Sensor_ID") % 5 > 0, F.col("Humidity")).otherwise("NaN"))

    def margins(nodes):
        found = trees.with_margin(rows, nodes, features.NUMERIC)
        assert found.columns == [*rows.columns, "margin"]
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        return {r["Sensor_ID"]: r["margin"] for r in found.collect()}, "array_repeat" in plan or "scalar-subquery" in plan

    written, by_arrays = margins(table)
    assert not by_arrays and len(written) == rows.count()
    none, _ = margins(table.where("false"))
    assert set(none.values()) == {0.0}
    monkeypatch.setattr(trees, "WRITTEN_OUT", 2)
    walked, by_arrays = margins(table)
    assert by_arrays and walked == written


def test_a_step_of_a_tree_computes_no_column_of_the_row_again(spark, small, trained):
    table = training.load_trees(spark, trained[2])
    walked = trees.with_margin(wide_telemetry(spark, small), table, features.NUMERIC)
    plan = walked.select("margin")._jdf.queryExecution().optimizedPlan().toString()
    (line,) = [text for text in plan.splitlines() if "aggregate(" in text]
    assert "Age#" in line
    assert "Age#" not in line[line.index("aggregate(") :]


def test_training_keeps_no_table_of_node_ids(spark, trained):
    model, spec, _ = trained
    rows = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0)], "Age double, label double")
    vectors = FeatureSpec(("Age",), {}).with_vector(rows, "label")
    kept = training.train_failure_classifier(vectors, rounds=1, depth=1)
    assert not kept.stages[-1].getCacheNodeIds()
    assert not model.stages[-1].getCacheNodeIds()


def test_a_half_written_version_is_not_seen(spark, small, trained, tmp_path):
    root = str(tmp_path / "models")
    telemetry = wide_telemetry(spark, small)
    training.train_and_keep(telemetry, root, "Sensor_ID", rounds=1, depth=1)
    first = training.model_folder(spark, root)

    def broken(*_):
        raise RuntimeError("lost")

    with pytest.MonkeyPatch.context() as patch, pytest.raises(RuntimeError):
        patch.setattr(training, "save_model", broken)
        training.train_and_keep(telemetry, root, "Sensor_ID", rounds=1, depth=1)
    assert training.model_folder(spark, root) == first
    assert training.model_versions(spark, root).count() == 1
    with pytest.raises(ValueError, match="no model version"):
        training.model_folder(spark, root, 7)


def test_held_out_accuracy_without_the_leaking_columns(spark, tmp_path):
    """Above that of always naming the larger class, without what gives the label away."""
    telemetry = wide_telemetry(spark, sample_tables(spark, "/root/testdata/sf0.01"))
    leaking = ("Downtime", "Predicted_Failure_Probability")
    numeric = tuple(n for n in features.NUMERIC if n not in leaking)
    root = str(tmp_path / "model")
    training.train_and_keep(telemetry, root, "Sensor_ID", numeric=numeric, rounds=20, depth=5)
    asked = {r["source"] for r in training.load_trees(spark, root).select("source").distinct().collect()}
    assert not asked & set(leaking)
    scored = training.held_out_scored(spark, root).select("label", "prediction").collect()
    larger = max(sum(r["label"] == k for r in scored) for k in (0, 1)) / len(scored)
    right = sum(r["label"] == r["prediction"] for r in scored) / len(scored)
    assert right > larger


def test_batch_scores_every_request(spark, trained):
    model, spec, _ = trained
    requests = [COMPLETE, _without("age"), COMPLETE | {"temperature": 95}]
    lines = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(requests)], "id int, value string")
    good, bad, hot = scoring.batch_score(lines, model, spec).orderBy("id").collect()
    assert good["prediction"] in (0, 1) and 0 <= good["probability"] <= 100
    assert (bad["prediction"], bad["probability"], bad["reasons"]) == (None, None, None)
    assert bad["error"] == "Missing fields: age"
    assert hot["reasons"] == ["High temperature."]


def test_encoding_is_shared_by_training_and_scoring(spark):
    spec = FeatureSpec((), {"Machine_Type": ("Hydraulic Press",), "Workload": (), "Maintenance_Type": ()})
    frame = spark.createDataFrame([("Hydraulic Press",), ("Unknown",), (None,)], "Machine_Type string")
    assert [r[0] for r in frame.select(*spec.expressions()).collect()] == [1.0, 0.0, 0.0]


def test_small_roc_and_confusion(spark):
    rows = spark.createDataFrame(
        [(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "label int, score double"
    ).withColumn("prediction", (F.col("score") > 0.5).cast("int"))
    points = sorted(tuple(r) for r in evaluation.roc_curve(rows).collect())
    assert points == [(0.0, 0.0), (0.0, 0.5), (0.5, 0.5), (0.5, 1.0), (1.0, 1.0)]
    matrix = [tuple(r) for r in evaluation.confusion_matrix(rows).collect()]
    assert matrix == [("Normal", 2, 0), ("Failure", 1, 1)]
    report = {r["class"]: r for r in evaluation.classification_report(rows).collect()}
    assert report["accuracy"]["f1_score"] == 0.75
    assert report["1"]["precision"] == 1.0 and report["1"]["recall"] == 0.5
    assert report["0"]["support"] == 2


def _plain_roc(pairs):
    """The curve by walking the sorted rows."""
    counts = {}
    for label, score in pairs:
        hit = counts.setdefault(score, [0, 0])
        hit[label] += 1
    fp, tp = [0], [0]
    for score in sorted(counts, reverse=True):
        fp.append(fp[-1] + counts[score][0])
        tp.append(tp[-1] + counts[score][1])
    fps, tps = fp[1:], tp[1:]
    keep = [
        i
        for i in range(len(fps))
        if i in (0, len(fps) - 1)
        or fps[i + 1] - 2 * fps[i] + fps[i - 1] != 0
        or tps[i + 1] - 2 * tps[i] + tps[i - 1] != 0
    ]
    return sorted([(0.0, 0.0), *[(fps[i] / fps[-1], tps[i] / tps[-1]) for i in keep]])


@pytest.mark.parametrize("kind", ["spread", "crowded", "copies"])
def test_roc_against_a_plain_walk(spark, kind):
    chance = random.Random(7)
    pairs = []
    for _ in range(5000):
        score = chance.random()
        if kind == "crowded" and chance.random() < 0.5:
            score = score / 1e6  # half of all distinct scores in a sliver near 0
        if kind == "copies" and chance.random() < 0.5:
            score = 0.25
        pairs.append((int(chance.random() < 0.2 + 0.6 * score), score))
    frame = spark.createDataFrame(pairs, "label int, score double")
    assert sorted(tuple(r) for r in evaluation.roc_curve(frame).collect()) == _plain_roc(pairs)

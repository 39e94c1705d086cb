"""Ingest, model and streaming operators, with the SQL each must agree with.

Each takes ``(spark, sf_dir)``.  The SQL of queries with a trained model walks the trees that
the query left in a local folder, so it runs after the query, on the same machine and scale.
"""

import tempfile
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.sample import last_failures, sample_tables, sample_views, whole_feed, wide_telemetry
from fleetwarden.functions.risk import failure_reasons
from fleetwarden.operators import evaluation, features, ingest, scoring, sensors, training, trees
from fleetwarden.plans.workspace import fresh_folder
from fleetwarden.sources.scoring_requests import read_scoring_requests
from fleetwarden.sources.telemetry_csv import CORRUPT, read_telemetry_csv, write_telemetry_csv
from fleetwarden.streaming import alerts, hourly
from fleetwarden.streaming import ingest as stream_ingest
from fleetwarden.tables import Tables

# --- ingest ---------------------------------------------------------------------


def _telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_telemetry(spark, sample_tables(spark, sf_dir))


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole_feed(spark, sample_tables(spark, sf_dir))


def _over_feed(operator):
    return lambda spark, sf_dir: operator(_feed(spark, sf_dir))


def _feed_csv(spark: SparkSession, sf_dir: str) -> str:
    path = fresh_folder(spark, "telemetry") + "/machine_telemetry"
    write_telemetry_csv(_feed(spark, sf_dir), path)
    return path


def _two_feeds(
    spark: SparkSession, feed: DataFrame, in_second: Column, *order: str
) -> dict[str, str]:
    """The folders of a first and a second feed, which one pass writes, each in ``order``."""
    path = fresh_folder(spark, "telemetry")
    load = F.when(in_second, "second").otherwise("first").alias("load")
    rows = feed.select("*", load)
    if order:
        rows = rows.repartitionByRange("load", *order).sortWithinPartitions("load", *order)
    write_telemetry_csv(rows, path, "load")
    return {name: f"{path}/load={name}" for name in ("first", "second")}


def machines_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Machines that failed before are known; telemetry updates them and adds others."""
    t = sample_tables(spark, sf_dir)
    # Failure records are many to a machine: its id is enough, in the join and in a task's memory.
    failed = t.failure_records.select("Machine_ID").distinct()
    known = t.machines.join(failed, "Machine_ID", "left_semi")
    return ingest.upsert_machines(known, whole_feed(spark, t), ["Sensor_ID"])


def schedule_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of maintained machines move to the day of the last maintenance."""
    t = sample_tables(spark, sf_dir)
    dates = t.machines.where(F.col("Last_Maintenance_Date").isNotNull()).select(
        "Machine_ID", F.col("Last_Maintenance_Date").alias("Scheduled_Date")
    )
    return ingest.apply_schedule_overrides(t.maintenance_schedule, dates)


def csv_sensor_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = read_telemetry_csv(spark, _feed_csv(spark, sf_dir))
    return ingest.to_sensor_data(feed.where(F.col(CORRUPT).isNull()))


def etl_run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole load, from a CSV to every table."""
    csv, root = _feed_csv(spark, sf_dir), fresh_folder(spark, "warehouse")
    return ingest.run_etl(spark, csv, root).select("step", "table", "status", "rows")


def etl_rerun_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Machines after two loads of which the first is run again: the second one's rows stay."""
    feed, root = _feed(spark, sf_dir), fresh_folder(spark, "warehouse")
    paths = _two_feeds(spark, feed, F.col("Sensor_ID") % 3 == 1, "Sensor_ID")
    for name in ("first", "second", "first"):
        ingest.run_etl(spark, paths[name], root, load_id=name)
    return Tables.from_warehouse(spark, root).machines.drop("Industry")


def etl_rollup_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly and daily reports of a warehouse of two loads, from the hours that loads keep."""
    feed, root = _feed(spark, sf_dir), fresh_folder(spark, "warehouse")
    for name, path in _two_feeds(spark, feed, F.col("Sensor_ID") % 2 == 0).items():
        ingest.run_etl(spark, path, root, load_id=name)
    t = Tables.from_warehouse(spark, root)
    parts = [
        sensors.sensor_trends_hourly_failed_machines(t).select("name", "timestamp", "value"),
        sensors.pressure_trend_latest_day(t).select(F.lit("pressure"), "Hourly_Timestamp", "Average_Pressure"),
        sensors.vibration_heatmap(t).select("Machine_Type", "Hourly_Timestamp", "Average_Vibration"),
        sensors.temperature_daily(t).select(F.lit("daily"), "Date", "ForecastedValue"),
        sensors.anomaly_hourly(t).select(F.lit("anomaly"), "hour", "anomaly_score"),
    ]
    names = ("report", "moment", "value")
    return reduce(DataFrame.unionAll, [p.toDF(*names) for p in parts])


_SENSORS = """Machine_ID, Timestamp, Temperature, Vibration, Pressure, Humidity, Voltage, Current,
  Power_Consumption, Ambient_Temperature, Ambient_Humidity, Anomaly_Score, Anomaly_Flag"""

INGEST = {
    "etl_machines_upsert": (
        machines_upsert,
        """, latest AS (SELECT * FROM feed QUALIFY
          row_number() OVER (PARTITION BY Machine_ID ORDER BY Sensor_ID DESC) = 1),
        known AS (SELECT * FROM machines
          WHERE Machine_ID IN (SELECT Machine_ID FROM failure_records))
        SELECT coalesce(k.Machine_ID, n.Machine_ID) AS Machine_ID, """
        + ", ".join(
            f"CASE WHEN n.Machine_ID IS NOT NULL THEN n.{c} ELSE k.{c} END AS {c}"
            for c in ingest.REPLACED
        )
        + """, k.Industry
        FROM known k FULL JOIN latest n ON k.Machine_ID = n.Machine_ID""",
    ),
    "etl_rerun_order": (
        etl_rerun_order,
        f"""SELECT Machine_ID, {", ".join(ingest.REPLACED)} FROM feed
        QUALIFY row_number() OVER (PARTITION BY Machine_ID ORDER BY Sensor_ID % 3 = 1 DESC, Sensor_ID DESC) = 1""",
    ),
    "etl_rollup_reports": (
        etl_rollup_reports,
        """, hours AS (SELECT *, strftime(Timestamp, '%Y-%m-%d %H:00:00') AS hour,
          CAST(Timestamp AS DATE) = (SELECT CAST(MAX(Timestamp) AS DATE) FROM feed) AS newest FROM feed),
        failed AS (SELECT * FROM hours
          WHERE Machine_ID IN (SELECT Machine_ID FROM feed WHERE Failure_Status = 1)),
        cells AS (SELECT Machine_Type, hour, AVG(Vibration) AS v FROM hours WHERE newest GROUP BY 1, 2),
        grid AS (SELECT Machine_Type, hour FROM (SELECT DISTINCT Machine_Type FROM cells),
          (SELECT DISTINCT hour FROM cells))
        """
        + " UNION ALL ".join(
            f"SELECT '{s}' AS report, hour AS moment, AVG({s}) AS value FROM failed GROUP BY 2"
            for s in sensors.TREND_SENSORS
        )
        + """ UNION ALL SELECT 'pressure', hour, AVG(Pressure) FROM hours WHERE newest GROUP BY 2
        UNION ALL SELECT g.Machine_Type, g.hour, CASE WHEN c.hour IS NULL THEN 0 ELSE c.v END
          FROM grid g LEFT JOIN cells c USING (Machine_Type, hour)
        UNION ALL SELECT 'daily', strftime(Timestamp, '%Y-%m-%d'), AVG(Temperature) FROM hours GROUP BY 2
        UNION ALL SELECT 'anomaly', hour, AVG(Anomaly_Score) FROM hours
          WHERE Anomaly_Score IS NOT NULL GROUP BY 2""",
    ),
    "etl_sensor_data": (_over_feed(ingest.to_sensor_data), f"SELECT {_SENSORS} FROM feed"),
    "etl_csv_sensor_data": (csv_sensor_data, f"SELECT {_SENSORS} FROM feed"),
    "etl_failure_records": (
        _over_feed(ingest.to_failure_records),
        """SELECT Machine_ID, Failure_Status, Failure_Type,
        COALESCE(Downtime, CAST(0 AS DOUBLE)) AS Downtime, Predicted_Failure_Probability,
        Predicted_Failure_Time FROM feed WHERE Failure_Status = 1""",
    ),
    "etl_failure_records_all": (
        _over_feed(lambda feed: ingest.to_failure_records(feed, include_all=True)),
        """SELECT Machine_ID, Failure_Status, Failure_Type,
        COALESCE(Downtime, CAST(0 AS DOUBLE)) AS Downtime, Predicted_Failure_Probability,
        Predicted_Failure_Time FROM feed""",
    ),
    "etl_maintenance_schedule": (
        _over_feed(ingest.to_maintenance_schedule),
        """SELECT Machine_ID, Last_Maintenance_Date AS Scheduled_Date,
        COALESCE(Maintenance_Type, 'Unknown') AS Maintenance_Type,
        COALESCE(Maintenance_Cost, CAST(0 AS DOUBLE)) AS Estimated_Cost,
        COALESCE(Maintenance_Duration, CAST(0 AS DOUBLE)) AS Estimated_Duration
        FROM feed WHERE Last_Maintenance_Date IS NOT NULL""",
    ),
    "etl_anomaly_detection": (
        _over_feed(ingest.to_anomaly_detection),
        "SELECT Machine_ID, Timestamp, Anomaly_Score, Anomaly_Flag FROM feed",
    ),
    "etl_health_indicators": (
        _over_feed(ingest.to_health_indicators),
        """SELECT Machine_ID, Timestamp, 1 - Anomaly_Score AS Health_Score,
        COALESCE(Predicted_Failure_Probability, CAST(0 AS DOUBLE)) AS Failure_Probability
        FROM feed""",
    ),
    "etl_failure_trends": (
        _over_feed(ingest.to_failure_trends),
        """SELECT Machine_Type, CAST(Timestamp AS DATE) AS Timestamp,
        AVG(Failure_Status) AS Failure_Rate FROM feed
        WHERE Machine_Type IS NOT NULL AND Timestamp IS NOT NULL GROUP BY 1, 2""",
    ),
    "etl_assign_industry": (
        lambda spark, sf_dir: ingest.assign_industry(
            sample_tables(spark, sf_dir).machines.select("Machine_ID")
        ),
        "SELECT Machine_ID, Industry FROM machines",
    ),
    "etl_schedule_overrides": (
        schedule_overrides,
        """SELECT ms.Maintenance_ID, ms.Machine_ID,
        COALESCE(m.Last_Maintenance_Date, ms.Scheduled_Date) AS Scheduled_Date, ms.Maintenance_Type,
        ms.Estimated_Cost, ms.Estimated_Duration
        FROM maintenance_schedule ms LEFT JOIN machines m ON ms.Machine_ID = m.Machine_ID""",
    ),
    "etl_run_report": (
        etl_run_report,
        """, counts AS (
        SELECT 1 AS step, 'machines' AS "table", COUNT(DISTINCT Machine_ID) AS rows FROM feed
        UNION ALL SELECT 2, 'sensor_data', COUNT(*) FROM feed
        UNION ALL SELECT 3, 'failure_records', COUNT(*) FROM feed WHERE Failure_Status = 1
        UNION ALL SELECT 4, 'maintenance_schedule', COUNT(*) FROM feed
          WHERE Last_Maintenance_Date IS NOT NULL
        UNION ALL SELECT 5, 'anomaly_detection', COUNT(*) FROM feed
        UNION ALL SELECT 6, 'machine_health_indicators', COUNT(*) FROM feed
        UNION ALL SELECT 7, 'failure_trends', COUNT(*) FROM
          (SELECT DISTINCT Machine_Type, CAST(Timestamp AS DATE) FROM feed
            WHERE Machine_Type IS NOT NULL AND Timestamp IS NOT NULL)
        UNION ALL SELECT 8, 'sensor_hourly', COUNT(*) FROM
          (SELECT DISTINCT Machine_ID, date_trunc('hour', Timestamp) FROM feed)
        UNION ALL SELECT 9, 'quarantine', 0)
        SELECT step, "table", 'loaded' AS status, rows FROM counts""",
    ),
}

# --- features, requests, evaluation -------------------------------------------------


def _reasons_text() -> Column:
    readings = {name: F.col(column) for name, column in scoring.NUMBERS.items()}
    return F.concat_ws(" ", failure_reasons(readings, F.col("Anomaly_Flag")))


_REASONS_SQL = """COALESCE(NULLIF(concat_ws(' ',
  CASE WHEN Temperature > 80 THEN 'High temperature.' END,
  CASE WHEN Vibration > 2 THEN 'Excessive vibration.' END,
  CASE WHEN Pressure > 150 THEN 'High pressure.' END,
  CASE WHEN Humidity > 70 THEN 'High humidity.' END,
  CASE WHEN Downtime > 5 THEN 'Extended downtime.' END,
  CASE WHEN Anomaly_Score > 0.5 THEN 'High anomaly score.' END,
  CASE WHEN Anomaly_Flag = 1 THEN 'Anomaly detected.' END), ''), 'No specific reasons.')"""


_BAD_VOLTAGE = "(Anomaly_Flag = 1 AND Current > 14)"
_BAD_HUMIDITY = "(Ambient_Humidity = 72)"


def sample_requests(telemetry: DataFrame) -> DataFrame:
    """Requests as JSON text: some fields absent, null, negative or not a number."""
    fields = {
        name: F.col(column)
        for name, column in scoring.NUMBERS.items()
        if name != "predicted_failure_probability"
    }
    fields["voltage"] = F.when(F.expr(_BAD_VOLTAGE), -F.col("Voltage")).otherwise(F.col("Voltage"))
    fields["humidity"] = F.when(F.expr(_BAD_HUMIDITY), "n/a").otherwise(F.col("Humidity").cast("string"))
    fields["machine_type"] = (
        F.when(F.col("Machine_Type") == "STANDARD", "Conveyor Belt")
        .when(F.col("Machine_Type") == "LARGE", "Hydraulic Press")
        .otherwise(F.col("Machine_Type"))
    )
    fields["request_id"] = F.col("Sensor_ID")
    fields["workload"] = F.col("Workload")
    fields["maintenance_type"] = F.col("Maintenance_Type")
    known = [column.alias(name) for name, column in fields.items()]
    probability = F.col("Predicted_Failure_Probability")
    keep_nulls = {"ignoreNullFields": "false"}
    value = F.when(probability.isNull(), F.to_json(F.struct(*known), keep_nulls)).otherwise(
        F.to_json(F.struct(*known, probability.alias("predicted_failure_probability")), keep_nulls)
    )
    return telemetry.select("Sensor_ID", value.alias("value"))


@lru_cache(maxsize=4)
def _request_lines(spark: SparkSession, sf_dir: str) -> str:
    """A folder with the requests as lines of text, written once a session."""
    folder = fresh_folder(spark, "requests")
    sample_requests(_telemetry(spark, sf_dir)).select("value").write.text(folder)
    return folder


def _stored_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_scoring_requests(spark, _request_lines(spark, sf_dir))


def requests_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored lines, through the reader."""
    parsed = scoring.parse_requests(_stored_requests(spark, sf_dir))
    return parsed.select(
        F.regexp_extract("value", '"request_id":([0-9]+)', 1).cast("bigint").alias("Sensor_ID"),
        "error",
        *scoring.NUMBERS,
        *scoring.CATEGORIES,
        F.concat_ws(" ", scoring.request_reasons()).alias("reasons"),
    )


def prepared_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    telemetry = _telemetry(spark, sf_dir)
    return features.prepare_features(telemetry, features.fit_features(telemetry), "Sensor_ID")


def _thresholded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failure records with a known probability, predicted to fail above one half."""
    score = F.col("Predicted_Failure_Probability")
    return (
        sample_tables(spark, sf_dir)
        .failure_records.where(score.isNotNull())
        .select(
            F.col("Failure_Status").alias("label"),
            (score > 0.5).cast("int").alias("prediction"),
            score.alias("score"),
        )
    )


_RULED = """, ruled AS (SELECT Failure_Status AS label, Predicted_Failure_Probability AS score,
  CASE WHEN Predicted_Failure_Probability > 0.5 THEN 1 ELSE 0 END AS prediction
  FROM failure_records WHERE Predicted_Failure_Probability IS NOT NULL)
"""
_CELLS = """, c AS (SELECT
  CAST(COUNT(*) FILTER (WHERE label = 0 AND prediction = 0) AS DOUBLE) AS tn,
  CAST(COUNT(*) FILTER (WHERE label = 0 AND prediction = 1) AS DOUBLE) AS fp,
  CAST(COUNT(*) FILTER (WHERE label = 1 AND prediction = 0) AS DOUBLE) AS fn,
  CAST(COUNT(*) FILTER (WHERE label = 1 AND prediction = 1) AS DOUBLE) AS tp FROM ruled)
, m AS (SELECT tn / (tn + fn) AS p0, tn / (tn + fp) AS r0, tn + fp AS s0,
  tp / (tp + fp) AS p1, tp / (tp + fn) AS r1, tp + fn AS s1,
  (tn + tp) / (tn + fp + fn + tp) AS acc, tn + fp + fn + tp AS n FROM c)
, f AS (SELECT *, 2 * p0 * r0 / (p0 + r0) AS f0, 2 * p1 * r1 / (p1 + r1) AS f1 FROM m)
"""
_CONFUSION_SQL = """SELECT CASE k WHEN 0 THEN 'Normal' ELSE 'Failure' END AS actual,
  COUNT(*) FILTER (WHERE label = k AND prediction = 0) AS "Normal",
  COUNT(*) FILTER (WHERE label = k AND prediction = 1) AS "Failure"
  FROM (SELECT unnest([0, 1]) AS k) CROSS JOIN ruled GROUP BY k"""
_REPORT_SQL = (
    _CELLS
    + """SELECT '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1_score,
    CAST(s0 AS BIGINT) AS support FROM f
  UNION ALL SELECT '1', p1, r1, f1, CAST(s1 AS BIGINT) FROM f
  UNION ALL SELECT 'accuracy', acc, acc, acc, CAST(n AS BIGINT) FROM f
  UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, CAST(n AS BIGINT) FROM f
  UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n,
    (f0 * s0 + f1 * s1) / n, CAST(n AS BIGINT) FROM f"""
)
_ROC_SQL = """, steps AS (SELECT score, COUNT(*) FILTER (WHERE label = 1) AS p,
  COUNT(*) FILTER (WHERE label = 0) AS n FROM ruled GROUP BY score),
walked AS (SELECT SUM(p) OVER w AS tp, SUM(n) OVER w AS fp,
  row_number() OVER w AS place FROM steps WINDOW w AS (ORDER BY score DESC)),
around AS (SELECT *, lag(tp) OVER w AS tp0, lag(fp) OVER w AS fp0, lead(tp) OVER w AS tp2,
  lead(fp) OVER w AS fp2 FROM walked WINDOW w AS (ORDER BY place)),
kept AS (SELECT * FROM around WHERE tp0 IS NULL OR tp2 IS NULL
  OR tp2 - 2 * tp + tp0 <> 0 OR fp2 - 2 * fp + fp0 <> 0)
SELECT CAST(0 AS DOUBLE) AS fpr, CAST(0 AS DOUBLE) AS tpr UNION ALL
SELECT CAST(fp AS DOUBLE) / CAST((SELECT MAX(fp) FROM walked) AS DOUBLE),
CAST(tp AS DOUBLE) / CAST((SELECT MAX(tp) FROM walked) AS DOUBLE) FROM kept"""


_LEVELS = {
    "Machine_Type": ["LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"],
    "Workload": ["Low", "Medium"],
    "Maintenance_Type": ["Corrective", "Preventive"],
}


def _feature_sql() -> str:
    numeric = [
        f"greatest(coalesce(CAST({c} AS DOUBLE), 0), 0) AS {c}" for c in features.NUMERIC
    ]
    encoded = [
        f"CAST(CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS DOUBLE) AS {c}_{v}"
        for c, found in _LEVELS.items()
        for v in found
    ]
    return f"SELECT Sensor_ID, {', '.join(numeric + encoded)}, Failure_Status FROM telemetry"


def _request_sql(before: str = "", after: str = "") -> str:
    error = f"""CASE WHEN Predicted_Failure_Probability IS NULL
      THEN 'Missing fields: predicted_failure_probability'
      WHEN {_BAD_VOLTAGE} THEN 'Invalid value for voltage: Must be non-negative'
      WHEN {_BAD_HUMIDITY} THEN 'Invalid value for humidity: Must be a number' END"""
    plain = [
        f"COALESCE(CAST({c} AS DOUBLE), 0) AS {n}"
        for n, c in scoring.NUMBERS.items()
        if n not in ("voltage", "humidity")
    ]
    return f"""{before}SELECT Sensor_ID, {error} AS error, {', '.join(plain)},
    CASE WHEN {_BAD_VOLTAGE} THEN -Voltage ELSE Voltage END AS voltage,
    CASE WHEN {_BAD_HUMIDITY} THEN CAST(0 AS DOUBLE) ELSE Humidity END AS humidity,
    CASE Machine_Type WHEN 'STANDARD' THEN 'Conveyor Belt' WHEN 'LARGE' THEN 'Hydraulic Press'
      ELSE 'Unknown' END AS machine_type,
    Workload AS workload, COALESCE(Maintenance_Type, 'Unknown') AS maintenance_type,
    CASE WHEN {error} IS NULL THEN {_REASONS_SQL} ELSE '' END AS reasons FROM telemetry{after}"""


MODEL = {
    "failure_reasons": (
        _over_feed(lambda feed: feed.select("Sensor_ID", _reasons_text().alias("reasons"))),
        f"SELECT Sensor_ID, {_REASONS_SQL} AS reasons FROM feed",
    ),
    "scoring_requests_checked": (requests_checked, _request_sql()),
    "prepared_features": (prepared_features, _feature_sql()),
    "train_test_split": (
        lambda spark, sf_dir: sample_tables(spark, sf_dir).sensor_data.select(
            "Sensor_ID", training.in_training_part("Sensor_ID").alias("in_training")
        ),
        """SELECT Sensor_ID, CAST('0x' || substr(md5('42|' || CAST(Sensor_ID AS STRING)), 1, 8)
        AS BIGINT) % 100 < 80 AS in_training FROM sensor_data""",
    ),
    "evaluation_confusion_matrix": (
        lambda spark, sf_dir: evaluation.confusion_matrix(_thresholded(spark, sf_dir)),
        _RULED + _CONFUSION_SQL,
    ),
    "evaluation_report": (
        lambda spark, sf_dir: evaluation.classification_report(_thresholded(spark, sf_dir)),
        _RULED + _REPORT_SQL,
    ),
    "evaluation_roc_curve": (
        lambda spark, sf_dir: evaluation.roc_curve(_thresholded(spark, sf_dir)),
        _RULED + _ROC_SQL,
    ),
}


# --- the kept model -----------------------------------------------------------------

#: Where a local session leaves the trees of the model it scored with last, for the SQL.
CHECKED_TREES = f"{tempfile.gettempdir()}/fleetwarden-checked-trees"


@lru_cache(maxsize=4)
def _trained_model(spark: SparkSession, sf_dir: str) -> str:
    """Train on the telemetry, with the package's settings, and keep it; returns the folder."""
    root = fresh_folder(spark, "model")
    training.train_and_keep(_telemetry(spark, sf_dir), root, "Sensor_ID")
    return root


def _kept_model(spark: SparkSession, sf_dir: str) -> str:
    root = _trained_model(spark, sf_dir)
    if spark.sparkContext.master.startswith("local"):
        nodes = training.load_trees(spark, root)
        nodes.coalesce(1).write.mode("overwrite").parquet(CHECKED_TREES)
    return root


def _held_out_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.held_out_scored(spark, _kept_model(spark, sf_dir))


def model_batch_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, spec = training.load_model(spark, _kept_model(spark, sf_dir))
    scored = scoring.batch_score(_stored_requests(spark, sf_dir), model, spec)
    return scored.select(
        F.regexp_extract("value", '"request_id":([0-9]+)', 1).cast("bigint").alias("Sensor_ID"),
        "prediction",
        "probability",
        F.concat_ws(" ", "reasons").alias("reasons"),
        "error",
    )


def model_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every row of the telemetry, by the trees as a table."""
    root = _kept_model(spark, sf_dir)
    walked = trees.with_margin(
        _telemetry(spark, sf_dir), training.load_trees(spark, root), features.NUMERIC
    )
    score = F.round(trees.failure_probability(F.col("margin")), 9)
    return walked.select("Sensor_ID", "margin", score.alias("score"))


def model_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.kept_features(spark, _kept_model(spark, sf_dir))


def model_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two small models kept one after the other: both stay, the second is the newest."""
    root = fresh_folder(spark, "models")
    for rounds in (1, 2):
        training.train_and_keep(_telemetry(spark, sf_dir), root, "Sensor_ID", rounds=rounds, depth=2)
    return training.model_versions(spark, root).select("version", "training_rows", "held_out_rows")


def _cleaned_sql(column: str) -> str:
    return f"greatest(coalesce(CAST({column} AS DOUBLE), 0), 0)"


def _walk_sql(rows: str, key: str, numbers: dict[str, str], texts: dict[str, str]) -> str:
    """CTE ``scores`` (key, margin) of the relation ``rows``: the trees walked from their roots.

    ``numbers`` and ``texts`` give the SQL of each column that a node may ask for.
    """
    number = " ".join(f"WHEN '{name}' THEN {sql}" for name, sql in numbers.items())
    text = " ".join(f"WHEN '{name}' THEN {sql}" for name, sql in texts.items())
    return f""", trees AS (SELECT * FROM read_parquet('{CHECKED_TREES}/*.parquet')),
    walk AS (SELECT r.*, t.* FROM {rows} r, trees t WHERE t.node = 0
      UNION ALL SELECT w.* EXCLUDE (tree, weight, node, source, level, threshold, "left", "right", leaf, depth), t.*
      FROM walk w JOIN trees t ON t.tree = w.tree AND t.node = CASE WHEN
        CASE WHEN w.level IS NULL THEN CASE w.source {number} END
          ELSE CASE WHEN CASE w.source {text} END = w.level THEN 1 ELSE 0 END END <= w.threshold
        THEN w.left ELSE w.right END
      WHERE w.leaf IS NULL),
    scores AS (SELECT {key}, list_reduce(list_prepend(CAST(0 AS DOUBLE), list(weight * leaf ORDER BY tree)),
      lambda a, b: a + b) AS margin FROM walk WHERE leaf IS NOT NULL GROUP BY {key})"""


_HELD_OUT = """, held AS (SELECT * FROM telemetry WHERE
  CAST('0x' || substr(md5('42|' || CAST(Sensor_ID AS STRING)), 1, 8) AS BIGINT) % 100 >= 80)"""
_WALK_TELEMETRY = {
    "key": "Sensor_ID",
    "numbers": {c: _cleaned_sql(c) for c in features.NUMERIC},
    "texts": {c: c for c in features.CATEGORICAL},
}
# The last bits of a score depend on the order in which trees are added up, so ties are those of
# nine digits.
_HELD_OUT_SCORES = (
    _HELD_OUT
    + _walk_sql("held", **_WALK_TELEMETRY)
    + """, ruled AS (SELECT coalesce(Failure_Status, 0) AS label, ROUND(1 / (1 + exp(-2 * margin)), 9) AS score,
      CASE WHEN margin > 0 THEN 1 ELSE 0 END AS prediction FROM held JOIN scores USING (Sensor_ID))"""
)


def _batch_score_sql() -> str:
    asked = {c: _cleaned_sql(n) for n, c in scoring.NUMBERS.items()}
    numbers = {c: asked.get(c, "0") for c in features.NUMERIC}
    texts = {c: n for n, (c, _) in scoring.CATEGORIES.items()}
    return f"""{_request_sql(", requests AS (", ")")}
      {_walk_sql("requests", "Sensor_ID", numbers, texts)}
      SELECT Sensor_ID, CASE WHEN error IS NULL THEN CASE WHEN margin > 0 THEN 1 ELSE 0 END END AS prediction,
        CASE WHEN error IS NULL THEN ROUND(100 / (1 + exp(-2 * margin)), 2) END AS probability, reasons, error
      FROM requests JOIN scores USING (Sensor_ID)"""


def _features_sql() -> str:
    """The numeric columns, then the levels found in the telemetry but for the lowest of each."""
    numeric = " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS source, CAST(NULL AS VARCHAR) AS level"
        for i, c in enumerate(features.NUMERIC)
    )
    found = " UNION ALL ".join(
        f"""SELECT {i} AS place, '{c}' AS source, {c} AS level, bool_or({c} IS NULL) OVER () AS gaps,
        dense_rank() OVER (ORDER BY {c} NULLS LAST) AS nth FROM (SELECT DISTINCT {c} FROM telemetry)"""
        for i, c in enumerate(features.CATEGORICAL)
    )
    return f""", levels AS ({found})
    {numeric} UNION ALL
    SELECT CAST({len(features.NUMERIC) - 1} + row_number() OVER (ORDER BY place, level) AS INT), source, level
    FROM levels WHERE level IS NOT NULL AND (gaps OR nth > 1)"""


TRAINED = {
    "model_batch_score": (model_batch_score, _batch_score_sql()),
    "model_tree_scores": (
        model_tree_scores,
        _walk_sql("telemetry", **_WALK_TELEMETRY)
        + " SELECT Sensor_ID, margin, ROUND(1 / (1 + exp(-2 * margin)), 9) AS score FROM scores",
    ),
    "model_confusion_matrix": (
        lambda spark, sf_dir: evaluation.confusion_matrix(_held_out_scored(spark, sf_dir)),
        _HELD_OUT_SCORES + _CONFUSION_SQL,
    ),
    "model_report": (
        lambda spark, sf_dir: evaluation.classification_report(_held_out_scored(spark, sf_dir)),
        _HELD_OUT_SCORES + _REPORT_SQL,
    ),
    "model_roc_curve": (
        lambda spark, sf_dir: evaluation.roc_curve(
            _held_out_scored(spark, sf_dir).withColumn("score", F.round("score", 9))
        ),
        _HELD_OUT_SCORES + _ROC_SQL,
    ),
    "model_features": (model_features, _features_sql()),
    "model_versions": (
        model_versions,
        _HELD_OUT
        + """SELECT CAST(version AS BIGINT) AS version, (SELECT COUNT(*) FROM telemetry) - COUNT(*) AS training_rows,
        COUNT(*) AS held_out_rows FROM held, (SELECT unnest([1, 2]) AS version) GROUP BY version""",
    ),
}

# --- streaming ------------------------------------------------------------------


def _reading_stream(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The sample views with readings as a stream and the rest as tables."""
    names = ("part", "lineitem", "orders")
    raw = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw["events"] = (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    )
    return sample_views(spark, raw)


def _telemetry_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide telemetry of a stream of readings.

    Failure records are reduced to the last of each machine once, not in every batch; no
    broadcast, since a stream would pick it on the size of compressed files.
    """
    stream = _reading_stream(spark, sf_dir)["sensor_data"]
    t = sample_tables(spark, sf_dir)
    path, last = fresh_folder(spark, "last-failures"), last_failures(spark, t)
    last.write.parquet(path)
    stored = spark.read.schema(last.schema).parquet(path).hint("merge")
    return wide_telemetry(
        spark, type(t)(**{**t.__dict__, "sensor_data": stream}), stored
    )


def _run_to_end(writer, folder: str) -> None:
    query = (
        writer.option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _streamed(spark: SparkSession, stream: DataFrame, purpose: str) -> DataFrame:
    folder = fresh_folder(spark, purpose)
    writer = stream.writeStream.outputMode("append").format("parquet")
    _run_to_end(writer.option("path", f"{folder}/rows"), folder)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


_STREAM_SENSORS = ["Temperature", "Vibration", "Pressure", "Anomaly_Score"]


def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings = _reading_stream(spark, sf_dir)["sensor_data"]
    return _streamed(
        spark, hourly.hourly_sensor_averages(readings, _STREAM_SENSORS), "stream-hourly"
    )


def stream_hourly_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = _reading_stream(spark, sf_dir)
    averages = hourly.hourly_sensor_averages(
        views["sensor_data"], _STREAM_SENSORS, views["machines"]
    )
    return _streamed(spark, averages, "stream-hourly-type")


def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    classified = alerts.classify_alerts(_telemetry_stream(spark, sf_dir))
    return _streamed(spark, classified, "stream-alerts").withColumn(
        "reasons", F.concat_ws(" ", "reasons")
    )


def stream_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the three tables the stream fills, in long form."""
    folder = fresh_folder(spark, "stream-tables")
    _run_to_end(stream_ingest.load_stream(_telemetry_stream(spark, sf_dir), folder), folder)
    value = {
        "sensor_data": "Temperature",
        "anomaly_detection": "Anomaly_Score",
        "machine_health_indicators": "Health_Score",
    }
    parts = [
        spark.read.parquet(f"{folder}/{table}").select(
            F.lit(table).alias("table"), "Machine_ID", "Timestamp", F.col(column).alias("value")
        )
        for table, column in value.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_AVERAGES = ", ".join(f"AVG(s.{s}) AS {s}" for s in _STREAM_SENSORS)
_CLOSED = """date_trunc('hour', s.Timestamp) + INTERVAL 1 HOUR
  <= (SELECT date_trunc('millisecond', MAX(Timestamp)) FROM sensor_data) - INTERVAL 1 HOUR"""

STREAMS = {
    "stream_sensor_hourly": (
        stream_hourly,
        f"""SELECT CAST(date_trunc('hour', s.Timestamp) AS TIMESTAMP) AS hour, {_AVERAGES},
        COUNT(*) AS readings FROM sensor_data s WHERE {_CLOSED} GROUP BY 1""",
    ),
    "stream_sensor_hourly_by_type": (
        stream_hourly_by_type,
        f"""SELECT CAST(date_trunc('hour', s.Timestamp) AS TIMESTAMP) AS hour, m.Machine_Type,
        {_AVERAGES}, COUNT(*) AS readings
        FROM sensor_data s JOIN machines m ON s.Machine_ID = m.Machine_ID
        WHERE {_CLOSED} GROUP BY 1, 2""",
    ),
    "stream_alerts": (
        stream_alerts,
        f"""SELECT Machine_ID, Timestamp, CASE WHEN Failure_Status = 1 THEN 'Critical'
          WHEN Failure_Status = 0 AND Predicted_Failure_Probability > 0.7 THEN 'Warning'
          ELSE 'Normal' END AS Current_Status,
        CASE WHEN Predicted_Failure_Probability > 0.85 THEN 'High'
          WHEN Predicted_Failure_Probability > 0.7 THEN 'Medium' ELSE 'Low' END AS Risk_Level,
        {_REASONS_SQL} AS reasons FROM telemetry""",
    ),
    "stream_tables": (
        stream_tables,
        """SELECT 'sensor_data' AS "table", Machine_ID, Timestamp, Temperature AS value FROM telemetry
        UNION ALL SELECT 'anomaly_detection', Machine_ID, Timestamp, Anomaly_Score FROM telemetry
        UNION ALL SELECT 'machine_health_indicators', Machine_ID, Timestamp, 1 - Anomaly_Score
        FROM telemetry""",
    ),
}

"""Jobs for ``spark-submit``: load a feed, correct it, write a report, train, evaluate, score.

    spark-submit --py-files fleetwarden.zip jobs.py load FEED.csv WAREHOUSE
    ... jobs.py report WAREHOUSE machine_status OUT [--as-of 2024-04-01]
    ... jobs.py train WAREHOUSE MODEL
    ... jobs.py override WAREHOUSE DATES.csv
    ... jobs.py evaluate MODEL OUT [--version 3]
    ... jobs.py score MODEL REQUESTS OUT
"""

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fleetwarden import catalog, schemas
from fleetwarden.operators import evaluation, ingest, scoring, training
from fleetwarden.sources.scoring_requests import read_scoring_requests
from fleetwarden.sources.telemetry_csv import CORRUPT
from fleetwarden.tables import Tables


def _arguments(given: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)
    load = jobs.add_parser("load")
    load.add_argument("feed")
    load.add_argument("warehouse")
    load.add_argument("--load-id")
    load.add_argument("--include-all", action="store_true")
    override = jobs.add_parser("override")
    override.add_argument("warehouse")
    override.add_argument("dates")
    report = jobs.add_parser("report")
    report.add_argument("warehouse")
    report.add_argument("name", choices=[*catalog.TIMELESS, *catalog.CLOCKED])
    report.add_argument("out")
    report.add_argument("--as-of")
    train = jobs.add_parser("train")
    train.add_argument("warehouse")
    train.add_argument("model")
    train.add_argument("--rounds", type=int, default=training.ROUNDS)
    train.add_argument("--depth", type=int, default=training.DEPTH)
    evaluate = jobs.add_parser("evaluate")
    evaluate.add_argument("model")
    evaluate.add_argument("out")
    evaluate.add_argument("--version", type=int)
    score = jobs.add_parser("score")
    score.add_argument("model")
    score.add_argument("requests")
    score.add_argument("out")
    return parser.parse_args(given)


def run(spark: SparkSession, given: list[str] | None = None) -> None:
    a = _arguments(given)
    if a.job == "load":
        ingest.run_etl(spark, a.feed, a.warehouse, a.load_id, a.include_all).show(truncate=False)
    elif a.job == "override":
        dates = spark.read.schema(schemas.SCHEDULE_OVERRIDES).option("header", True).csv(a.dates)
        ingest.keep_overrides(spark, a.warehouse, dates)
    elif a.job == "report":
        tables = Tables.from_warehouse(spark, a.warehouse)
        catalog.report(tables, a.name, a.as_of).write.mode("overwrite").parquet(a.out)
    elif a.job == "train":
        telemetry = ingest.staged_telemetry(spark, a.warehouse).where(F.col(CORRUPT).isNull())
        settings = {"rounds": a.rounds, "depth": a.depth}
        training.train_and_keep(telemetry, a.model, "Reading_ID", **settings).show()
    elif a.job == "evaluate":
        rows = training.held_out_scored(spark, a.model, a.version)
        for name, measure in (
            ("report", evaluation.classification_report),
            ("confusion_matrix", evaluation.confusion_matrix),
            ("roc_curve", evaluation.roc_curve),
        ):
            measure(rows).write.mode("overwrite").parquet(f"{a.out}/{name}")
    elif a.job == "score":
        model, spec = training.load_model(spark, a.model)
        requests = read_scoring_requests(spark, a.requests)
        scoring.batch_score(requests, model, spec).write.mode("overwrite").parquet(a.out)


if __name__ == "__main__":
    run(SparkSession.builder.appName("fleetwarden").getOrCreate())

"""Train and keep the failure classifier."""

import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetwarden.operators.evaluation import classification_report
from fleetwarden.operators.features import NUMERIC, FeatureSpec, fit_features, training_rows
from fleetwarden.operators.trees import tree_table
from fleetwarden.sources.commit_log import CommitLog, Files

# Fixed values.
TRAIN_PERCENT = 80
SEED = 42
ROUNDS = 100
DEPTH = 6
LEARNING_RATE = 0.3


def in_training_part(
    *key: str, percent: int = TRAIN_PERCENT, seed: int = SEED
) -> Column:
    """Whether a row belongs to the training part, by a hash of its key.

    Unlike a random split this does not depend on how rows are partitioned, so the
    parts stay disjoint when a lost task is run again.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(name).cast("string") for name in key])
    bucket = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % 100
    return bucket < percent


def train_test_split(
    rows: DataFrame, *key: str, percent: int = TRAIN_PERCENT, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """Training and held-out rows; ``key`` must identify a row."""
    chosen = in_training_part(*key, percent=percent, seed=seed)
    return rows.where(chosen), rows.where(~chosen)


def train_failure_classifier(
    training: DataFrame,
    rounds: int = ROUNDS,
    depth: int = DEPTH,
    learning_rate: float = LEARNING_RATE,
    seed: int = SEED,
) -> PipelineModel:
    """Gradient-boosted trees with log loss on columns ``features`` and ``label``.

    Node ids of rows are not cached: that keeps, and at times writes, a table as long as the
    rows for each level of each tree, while finding the node again takes ``depth`` comparisons.
    The trees are the same.
    """
    trees = GBTClassifier(
        lossType="logistic",
        maxIter=rounds,
        maxDepth=depth,
        stepSize=learning_rate,
        seed=seed,
    )
    return Pipeline(stages=[trees]).fit(training)


def scored(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` with the predicted class and ``score``, the probability of a failure."""
    return (
        model.transform(rows)
        .withColumn("prediction", F.col("prediction").cast("int"))
        .withColumn("score", vector_to_array("probability")[1])
        .drop("rawPrediction", "probability")
    )


def keep_rows(telemetry: DataFrame, spec: FeatureSpec, root: str, *key: str) -> None:
    """Write feature rows once, split into ``held_out=false`` and ``held_out=true``.

    Training goes over its rows many times; they are read back from this table instead
    of being derived from the telemetry again each time.
    """
    rows = training_rows(telemetry, spec, *key).withColumn("held_out", ~in_training_part(*key))
    rows.write.mode("overwrite").partitionBy("held_out").parquet(f"{root}/rows")


def _rows(spark: SparkSession, folder: str, held_out: bool) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/rows")
    return rows.where(F.col("held_out") == F.lit(held_out)).drop("held_out")


def kept_rows(
    spark: SparkSession, root: str, held_out: bool, version: int | None = None
) -> DataFrame:
    """The training or held-out rows of a kept model."""
    return _rows(spark, model_folder(spark, root, version), held_out)


REGISTRY = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("folder", T.StringType()),
        T.StructField("training_rows", T.LongType()),
        T.StructField("held_out_rows", T.LongType()),
        T.StructField("accuracy", T.DoubleType()),
    ]
)


def _registry(spark: SparkSession, root: str) -> CommitLog:
    return CommitLog(spark, f"{root}/_versions", REGISTRY)


def model_versions(spark: SparkSession, root: str) -> DataFrame:
    """The versions of a model kept below ``root``: number, rows trained on and held out, accuracy."""
    return _registry(spark, root).rows().withColumnRenamed("n", "version").drop("folder")


def model_folder(spark: SparkSession, root: str, version: int | None = None) -> str:
    """Where a version lies, by default the newest. It is whole: its entry is written last."""
    entries = _registry(spark, root).entries()
    chosen = [e for e in entries if version is None or e["n"] == version]
    if not chosen:
        raise ValueError(f"no model version {version or ''} below {root}")
    return f"{root}/{chosen[-1]['folder']}"


def save_model(spark: SparkSession, folder: str, model: PipelineModel, spec: FeatureSpec) -> None:
    """Write the model, its feature list and its trees as a table to a new folder."""
    spec.save(spark, f"{folder}/features")
    model.write().overwrite().save(f"{folder}/model")
    (stage,) = [s for s in Files(spark, folder).names(f"{folder}/model/stages") if not s.startswith((".", "_"))]
    features = spark.read.parquet(f"{folder}/features")
    depth = model.stages[-1].getMaxDepth()
    trees = tree_table(spark, f"{folder}/model/stages/{stage}", features, depth)
    trees.write.mode("overwrite").parquet(f"{folder}/trees")


def load_model(
    spark: SparkSession, root: str, version: int | None = None
) -> tuple[PipelineModel, FeatureSpec]:
    folder = model_folder(spark, root, version)
    return PipelineModel.load(f"{folder}/model"), FeatureSpec.load(spark, f"{folder}/features")


def load_trees(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The trees of a kept model as a table, a row for each node."""
    return spark.read.parquet(f"{model_folder(spark, root, version)}/trees")


def kept_features(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The feature columns of a kept model, in order: position, source, level."""
    return spark.read.parquet(f"{model_folder(spark, root, version)}/features")


def held_out_scored(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The held-out rows of a kept model with its predictions, for evaluation."""
    model, _ = load_model(spark, root, version)
    return scored(model, kept_rows(spark, root, True, version))


def train_and_keep(
    telemetry: DataFrame,
    root: str,
    *key: str,
    numeric: tuple[str, ...] = NUMERIC,
    rounds: int = ROUNDS,
    depth: int = DEPTH,
) -> DataFrame:
    """Train on telemetry rows identified by ``key`` and keep everything below ``root``.

    What is kept is a new version: rows, features, model and trees lie in a folder of their own,
    which the registry names once all of it is written. Returns the classification report of the
    held-out rows.
    """
    spark = telemetry.sparkSession
    name = f"model-{uuid.uuid4().hex}"
    folder = f"{root}/{name}"
    spec = fit_features(telemetry, numeric)
    keep_rows(telemetry, spec, folder, *key)
    training = _rows(spark, folder, False)
    model = train_failure_classifier(training, rounds, depth)
    save_model(spark, folder, model, spec)
    report = classification_report(scored(model, _rows(spark, folder, True)))
    lines = report.collect()
    (overall,) = [r for r in lines if r["class"] == "accuracy"]
    trained = training.count()
    _registry(spark, root).append(
        lambda _: {
            "folder": name,
            "training_rows": trained,
            "held_out_rows": overall["support"],
            "accuracy": overall["precision"],
        }
    )
    return spark.createDataFrame(lines, report.schema)

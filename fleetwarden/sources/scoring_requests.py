"""Prediction requests: one JSON object per line."""

from pyspark.sql import DataFrame, SparkSession


def read_scoring_requests(spark: SparkSession, path: str) -> DataFrame:
    """Request lines as text in column ``value``.

    The text is kept: a typed read cannot tell an absent field from a null one.
    """
    return spark.read.text(path)

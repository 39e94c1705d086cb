"""Alert classification of a stream of telemetry rows; no state."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwarden.functions.risk import current_status, failure_reasons, risk_level
from fleetwarden.operators.scoring import NUMBERS
from fleetwarden.plans.joins import MACHINE


def classify_alerts(telemetry: DataFrame) -> DataFrame:
    """Status, risk level and reasons of every telemetry row."""
    readings = {name: F.col(column) for name, column in NUMBERS.items()}
    return telemetry.select(
        MACHINE,
        "Timestamp",
        current_status().alias("Current_Status"),
        risk_level(F.col("Predicted_Failure_Probability")).alias("Risk_Level"),
        failure_reasons(readings, F.col("Anomaly_Flag")).alias("reasons"),
    )

"""Batch scoring of prediction requests."""

from functools import reduce
from operator import or_

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwarden.functions.risk import (
    MACHINE_TYPES,
    MAINTENANCE_TYPES,
    WORKLOADS,
    failure_reasons,
    known_or_unknown,
    percent,
)
from fleetwarden.operators.features import FeatureSpec
from fleetwarden.operators.training import scored

# Required request fields in the order they are checked, with the table column each
# fills (fixed values).
NUMBERS = {
    "age": "Age",
    "temperature": "Temperature",
    "vibration": "Vibration",
    "pressure": "Pressure",
    "humidity": "Humidity",
    "voltage": "Voltage",
    "current": "Current",
    "power_consumption": "Power_Consumption",
    "downtime": "Downtime",
    "production_rate": "Production_Rate",
    "operational_hours": "Operational_Hours",
    "ambient_temperature": "Ambient_Temperature",
    "ambient_humidity": "Ambient_Humidity",
    "anomaly_score": "Anomaly_Score",
    "anomaly_flag": "Anomaly_Flag",
    "predicted_failure_probability": "Predicted_Failure_Probability",
}
CATEGORIES = {
    "machine_type": ("Machine_Type", MACHINE_TYPES),
    "workload": ("Workload", WORKLOADS),
    "maintenance_type": ("Maintenance_Type", MAINTENANCE_TYPES),
}
REQUIRED = (*NUMBERS, *CATEGORIES)
NOT_JSON = "Request must be JSON"


_FIELDS = ", ".join(f"{name} string" for name in REQUIRED)


def _names(names) -> Column:
    return F.array(*[F.lit(name) for name in names])


def _first_invalid(tests: dict[str, Column], problem: str) -> Column:
    """Message for the first field whose test is true; NULL when there is none."""
    return F.coalesce(
        *[
            F.when(test, F.lit(f"Invalid value for {name}: {problem}"))
            for name, test in tests.items()
        ]
    )


def parse_requests(lines: DataFrame, text: str = "value") -> DataFrame:
    """Checked requests: ``error``, the numeric fields and the categories.

    A field that is absent, negative or not a number puts a message in ``error``; a
    null field takes its default (0 or ``Unknown``) and an unlisted category becomes
    ``Unknown``.  Nothing raises.  Other columns of ``lines`` are carried along.

    Fields are read as text: a typed read cannot tell text from an absent number.  Nor
    can it tell absent from null, so a request with an empty field also has its keys
    listed; one with every field filled is parsed once.
    """
    parsed = lines.select(*lines.columns, F.from_json(text, _FIELDS).alias("_request"))
    entry = {name: F.col("_request")[name] for name in REQUIRED}
    some_empty = reduce(or_, [entry[name].isNull() for name in REQUIRED])
    typed = parsed.select(
        *lines.columns,
        "_request",
        some_empty.alias("_incomplete"),
        F.when(some_empty, F.json_object_keys(text)).alias("_keys"),
        *[entry[name].try_cast("double").alias(name) for name in NUMBERS],
    ).withColumn("_absent", F.array_except(_names(REQUIRED), "_keys"))
    negative = {name: F.col(name) < 0 for name in NUMBERS}
    unreadable = {
        name: (entry[name].isNotNull() & F.col(name).isNull()) | F.isnan(name) for name in NUMBERS
    }
    error = (
        F.when(F.col("_incomplete") & F.col("_keys").isNull(), NOT_JSON)
        .when(F.size("_absent") > 0, F.concat(F.lit("Missing fields: "), F.array_join("_absent", ", ")))
        .otherwise(
            F.coalesce(
                _first_invalid(negative, "Must be non-negative"),
                _first_invalid(unreadable, "Must be a number"),
            )
        )
    )
    return typed.select(
        *lines.columns,
        error.alias("error"),
        *[F.coalesce(name, F.lit(0.0)).alias(name) for name in NUMBERS],
        *[
            known_or_unknown(entry[name], known).alias(name)
            for name, (_, known) in CATEGORIES.items()
        ],
    )


def request_reasons() -> Column:
    """Reasons of a parsed request; NULL for a rejected one."""
    readings = {name: F.col(name) for name in NUMBERS}
    return F.when(F.col("error").isNull(), failure_reasons(readings, F.col("anomaly_flag")))


def batch_score(
    lines: DataFrame, model: PipelineModel, spec: FeatureSpec, text: str = "value"
) -> DataFrame:
    """Prediction, probability in percent and reasons for every request.

    Rejected requests keep their row, with ``error`` set and no prediction.
    Maintenance cost and duration are not part of a request and count as 0.
    """
    requests = parse_requests(lines, text)
    named = {column: F.col(name) for name, column in NUMBERS.items()}
    named |= {column: F.col(name) for name, (column, _) in CATEGORIES.items()}
    for column in spec.numeric:
        named.setdefault(column, F.lit(0.0))
    inputs = requests.select(
        *lines.columns,
        "error",
        request_reasons().alias("reasons"),
        *[column.alias(name) for name, column in named.items()],
    )
    accepted = F.col("error").isNull()
    vectors = spec.with_vector(inputs, *lines.columns, "error", "reasons")
    return scored(model, vectors).select(
        *lines.columns,
        F.when(accepted, F.col("prediction")).alias("prediction"),
        F.when(accepted, percent(F.col("score"))).alias("probability"),
        "reasons",
        "error",
    )

"""Business rules of the fleet: status, risk bands, reasons, categories."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
WARNING_PROBABILITY = 0.7
HIGH_RISK_PROBABILITY = 0.85
MEDIUM_RISK_PROBABILITY = 0.7
RECOMMENDED_MAINTENANCE_DAYS = 30
NEXT_SCHEDULE_DAYS = {"Preventive": 30, "Corrective": 60}
GAUGE_LIMITS = (50, 80, 100)
MACHINE_TYPES = ("Conveyor Belt", "Hydraulic Press")
WORKLOADS = ("Low", "Medium", "High")
MAINTENANCE_TYPES = ("Preventive", "Corrective")
UNKNOWN = "Unknown"
INDUSTRY_PATTERNS = (
    ("Machine_0%", "Manufacturing"),
    ("Machine_1%", "Energy"),
    ("Machine_2%", "Automotive"),
)
OTHER_INDUSTRY = "General"
REASON_LIMITS = (
    ("temperature", 80, "High temperature."),
    ("vibration", 2.0, "Excessive vibration."),
    ("pressure", 150, "High pressure."),
    ("humidity", 70, "High humidity."),
    ("downtime", 5, "Extended downtime."),
    ("anomaly_score", 0.5, "High anomaly score."),
)
ANOMALY_REASON = "Anomaly detected."
NO_REASON = "No specific reasons."


def is_critical() -> Column:
    return F.col("Failure_Status") == 1


def is_warning() -> Column:
    return (F.col("Failure_Status") == 0) & (
        F.col("Predicted_Failure_Probability") > WARNING_PROBABILITY
    )


def current_status() -> Column:
    """Critical, Warning or Normal; a machine without failures is Normal."""
    return F.when(is_critical(), "Critical").when(is_warning(), "Warning").otherwise("Normal")


def risk_level(probability: Column) -> Column:
    """High, Medium or Low; a missing probability is Low."""
    return (
        F.when(probability > HIGH_RISK_PROBABILITY, "High")
        .when(probability > MEDIUM_RISK_PROBABILITY, "Medium")
        .otherwise("Low")
    )


def percent(share: Column) -> Column:
    """A 0..1 value as a percentage with two decimals."""
    return F.round(share * 100, 2)


def industry(machine_id: Column) -> Column:
    """Industry by the shape of the id; ``_`` is a LIKE wildcard, first match wins."""
    (first_pattern, first_name), *others = INDUSTRY_PATTERNS
    rule = F.when(machine_id.like(first_pattern), first_name)
    for pattern, name in others:
        rule = rule.when(machine_id.like(pattern), name)
    return rule.otherwise(OTHER_INDUSTRY)


def gauge_band(value: Column) -> Column:
    """Band of a 0..100 gauge: low below 50, medium below 80, high up to 100."""
    low, medium, top = GAUGE_LIMITS
    return (
        F.when((value >= 0) & (value < low), "low")
        .when((value >= low) & (value < medium), "medium")
        .when((value >= medium) & (value <= top), "high")
    )


def failure_reasons(readings: dict[str, Column], anomaly_flag: Column) -> Column:
    """Ordered array of the reasons that apply, or the single "no reason" text.

    ``readings`` maps the names used in ``REASON_LIMITS`` to columns.
    """
    checks = [F.when(readings[name] > limit, text) for name, limit, text in REASON_LIMITS]
    checks.append(F.when(anomaly_flag == 1, ANOMALY_REASON))
    found = F.array_compact(F.array(*checks))
    return F.when(F.size(found) == 0, F.array(F.lit(NO_REASON))).otherwise(found)


def known_or_unknown(category: Column, known: tuple[str, ...]) -> Column:
    """The category when it is a known one, else ``Unknown``."""
    return F.when(category.isin(*known), category).otherwise(UNKNOWN)


def canonical_category(category: Column, known: tuple[str, ...]) -> Column:
    """Trimmed category, spelled like the known one it equals ignoring case."""
    trimmed = F.trim(category)
    rule = F.when(F.lower(trimmed) == known[0].lower(), known[0])
    for name in known[1:]:
        rule = rule.when(F.lower(trimmed) == name.lower(), name)
    return rule.otherwise(trimmed)

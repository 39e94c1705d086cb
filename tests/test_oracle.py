"""Every query with SQL against DuckDB; every other query returns rows."""

import pytest

from checks import registry
from checks.compare import difference

SMALL = "/root/testdata/sf0.001"
# Encoded columns depend on the categories present; the smallest scale lacks some.
LARGER = {"prepared_features": "/root/testdata/sf0.01"}
ORACLES = registry.oracle_sql()


@pytest.mark.parametrize("name", ORACLES)
def test_agrees_with_sql(spark, name):
    assert difference(name, spark, LARGER.get(name, SMALL)) is None


@pytest.mark.parametrize("name", [n for n in registry.queries() if n not in ORACLES])
def test_returns_rows(spark, name):
    assert registry.queries()[name](spark, SMALL).count() > 0


def test_entry_point(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns[0] == "Machine_ID"
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


SHAPED = [
    "failure_rate_by_machine_type",
    "failure_probability_by_days_since_maintenance",
    "failure_probability_by_industry",
    "failure_records_enriched",
    "fleet_overview",
    "machine_status",
    "operational_machine_count",
    "maintenance_impact",
    "cost_benefit",
    "sensor_trends_hourly_failed_machines",
    "failure_probability_by_temperature",
    "vibration_heatmap",
    "health_indicators_recent",
    "etl_machines_upsert",
    "etl_schedule_overrides",
]


@pytest.mark.parametrize("name", SHAPED)
def test_agrees_when_nothing_may_be_broadcast(spark, no_broadcast, name):
    assert difference(name, spark, SMALL) is None

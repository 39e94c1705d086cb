"""Every report by name, for jobs that pick one."""

from collections.abc import Callable

from pyspark.sql import DataFrame

from fleetwarden.functions.clock import AsOf
from fleetwarden.operators import failures, fleet, maintenance, sensors
from fleetwarden.tables import Tables

# Reports of the tables as they are.
TIMELESS: dict[str, Callable[[Tables], DataFrame]] = {
    "machine_data": fleet.machine_data,
    "fleet_overview": fleet.fleet_overview,
    "machine_status": fleet.machine_status,
    "operational_machine_count": fleet.operational_machine_count,
    "failure_records_enriched": failures.failure_records_enriched,
    "failure_trends_monthly": failures.failure_trends_monthly,
    "failure_rate_by_machine_type": failures.failure_rate_by_machine_type,
    "failures_daily": failures.failures_daily,
    "mean_failure_probability": failures.mean_failure_probability,
    "at_risk_machines_top5": failures.at_risk_machines_top5,
    "urgent_alerts_top5": failures.urgent_alerts_top5,
    "warnings_top5": failures.warnings_top5,
    "critical_count": failures.critical_count,
    "failure_type_distribution": failures.failure_type_distribution,
    "failure_probability_series": failures.failure_probability_series,
    "failure_detection_series": failures.failure_probability_series,
    "failure_probability_by_industry": failures.failure_probability_by_industry,
    "failure_probability_by_workload": failures.failure_probability_by_workload,
    "workload_failure_rates": failures.workload_failure_rates,
    "maintenance_backlog": failures.maintenance_backlog,
    "maintenance_type_counts": maintenance.maintenance_type_counts,
    "mtbf_monthly": maintenance.mtbf_monthly,
    "maintenance_impact": maintenance.maintenance_impact,
    "next_schedule_dates": maintenance.next_schedule_dates,
    "sensor_recent": sensors.sensor_recent,
    "health_indicators_recent": sensors.health_indicators_recent,
    "sensor_trends_hourly_failed_machines": sensors.sensor_trends_hourly_failed_machines,
    "sensor_contribution": sensors.sensor_contribution,
    "temperature_anomaly_impact": sensors.temperature_anomaly_impact,
    "pressure_trend_latest_day": sensors.pressure_trend_latest_day,
    "failure_probability_by_temperature": sensors.failure_probability_by_temperature,
    "vibration_heatmap": sensors.vibration_heatmap,
    "sensor_feature_means": sensors.sensor_feature_means,
    "temperature_daily": sensors.temperature_daily,
    "anomaly_hourly": sensors.anomaly_hourly,
}

# Reports that compare dates with a clock.
CLOCKED: dict[str, Callable[[Tables, AsOf], DataFrame]] = {
    "maintenance_page_counts": fleet.maintenance_page_counts,
    "failure_probability_by_days_since_maintenance": (
        failures.failure_probability_by_days_since_maintenance
    ),
    "optimal_maintenance_interval": failures.optimal_maintenance_interval,
    "maintenance_schedule_upcoming_enriched": maintenance.maintenance_schedule_upcoming_enriched,
    "upcoming_maintenance": maintenance.upcoming_maintenance,
    "maintenance_calendar": maintenance.maintenance_calendar,
    "maintenance_due_count": maintenance.maintenance_due_count,
    "preventive_upcoming_count": maintenance.preventive_upcoming_count,
    "maintenance_cost_by_type": maintenance.maintenance_cost_by_type,
    "maintenance_duration_histogram": maintenance.maintenance_duration_histogram,
    "cost_benefit": maintenance.cost_benefit,
    "maintenance_cost_monthly": maintenance.maintenance_cost_monthly,
    "temperature_last_day": sensors.temperature_last_day,
}


def report(t: Tables, name: str, as_of: AsOf = None) -> DataFrame:
    """The report called ``name``; ``as_of`` matters to the clocked ones only."""
    return CLOCKED[name](t, as_of) if name in CLOCKED else TIMELESS[name](t)

"""Every checked query by name, and the SQL it is compared with."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks.pipeline_checks import INGEST, MODEL, STREAMS, TRAINED
from checks.presentation_checks import SCREENS
from checks.report_checks import REPORTS
from checks.sample import oracle_prefix, sample_tables

Query = Callable[[SparkSession, str], DataFrame]


def _over_tables(operator) -> Query:
    return lambda spark, sf_dir: operator(sample_tables(spark, sf_dir))


def queries() -> dict[str, Query]:
    found = {name: _over_tables(operator) for name, (operator, _) in (REPORTS | SCREENS).items()}
    found |= {name: query for name, (query, _) in (INGEST | MODEL | TRAINED | STREAMS).items()}
    return found


def oracle_sql() -> dict[str, str]:
    prefix = oracle_prefix()
    texts = REPORTS | SCREENS | INGEST | MODEL | TRAINED | STREAMS
    return {name: prefix + text for name, (_, text) in texts.items()}

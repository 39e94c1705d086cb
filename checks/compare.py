"""Run queries in Spark and their SQL in DuckDB and compare the rows.

    python -m checks.compare [--sf 0.01] [name ...]
"""

import argparse
import math
import time

import duckdb
from pyspark.sql import SparkSession

from checks import registry

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def local_session(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("fleetwarden-checks")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _canonical(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if isinstance(v, float):
            return "NaN" if math.isnan(v) else repr(v + 0.0)
        if isinstance(v, (list, tuple)):
            return repr([value(x) for x in v])
        return f"{type(v).__name__}:{v}"

    return sorted(tuple(value(row[i]) for i in order) for row in rows)


def difference(name: str, spark: SparkSession, sf_dir: str) -> str | None:
    """None when Spark and SQL agree on columns and rows, else what differs."""
    frame = registry.queries()[name](spark, sf_dir)
    result = duck(sf_dir).execute(registry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(columns)}"
    ours = _canonical(frame.columns, frame.collect())
    theirs = _canonical(columns, result.fetchall())
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)} rows"
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(wrong)} of {len(ours)} rows differ, first {wrong[0]}" if wrong else None


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    options = parser.parse_args()
    sf_dir = f"/root/testdata/sf{options.sf}"
    spark = local_session()
    oracles = registry.oracle_sql()
    bad = 0
    for name in options.names or registry.queries():
        start = time.time()
        try:
            if name in oracles:
                problem = difference(name, spark, sf_dir)
            else:
                rows = len(registry.queries()[name](spark, sf_dir).collect())
                problem = None if rows else "no rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        kind = "sql" if name in oracles else "rows only"
        print(f"{'FAIL' if problem else 'ok  '} {name} [{kind}] {time.time() - start:.2f}s {problem or ''}", flush=True)
    print(f"{bad} failed")


if __name__ == "__main__":
    main()

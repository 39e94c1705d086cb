"""Exact running totals over a global order without putting all rows in one task.

Rows are dealt into ranges of the order by Spark, once.  Totals inside a range are a window
over it; the totals of the ranges before it come from a summary with a row for each range.
Both read the one exchange, which Spark reuses, so what lies before it is worked out once and
nothing runs until the result is asked for.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def descending_totals(rows: DataFrame, order: str, values: list[str]) -> DataFrame:
    """For rows unique in ``order`` (a non-null double), walking it from high to low.

    ``rows`` has these columns and no others.  Adds ``total_<v>`` (sum up to and including the
    row), ``next_<v>`` (value of the following row) and ``all_<v>`` (sum over all rows) for each
    ``v`` in ``values``.
    """
    spark = rows.sparkSession
    if spark.conf.get("spark.sql.exchange.reuse") != "true":
        raise ValueError("running totals need spark.sql.exchange.reuse, so that ranges are dealt once")
    # A number of ranges given here stays as it is; adaptive execution doesn't merge them.
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(n, F.desc(order)).withColumn("_range", F.spark_partition_id())

    summary = ranged.groupBy("_range").agg(
        *[F.sum(v).alias(f"_sum_{v}") for v in values],
        *[F.max_by(v, order).alias(f"_first_{v}") for v in values],
    )
    # One row per range: the windows below see few rows.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    following = Window.orderBy("_range")
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = summary.select(
        "_range",
        *[F.coalesce(F.sum(f"_sum_{v}").over(before), F.lit(0)).alias(f"_before_{v}") for v in values],
        *[F.lead(f"_first_{v}").over(following).alias(f"_after_{v}") for v in values],
        *[F.sum(f"_sum_{v}").over(whole).alias(f"all_{v}") for v in values],
    )

    inside = Window.partitionBy("_range").orderBy(F.desc(order))
    up_to_here = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged
    for v in values:
        local = local.withColumn(f"_local_{v}", F.sum(v).over(up_to_here)).withColumn(
            f"_lead_{v}", F.lead(v).over(inside)
        )
    # Every range has its offsets; as a left join both branches read the same rows and
    # Spark reuses them.
    return local.join(F.broadcast(offsets), "_range", "left").select(
        *rows.columns,
        *[(F.col(f"_local_{v}") + F.col(f"_before_{v}")).alias(f"total_{v}") for v in values],
        *[F.coalesce(f"_lead_{v}", f"_after_{v}").alias(f"next_{v}") for v in values],
        *[F.col(f"all_{v}") for v in values],
    )

"""Join shapes that hold up when one machine owns a large part of the facts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MACHINE = "Machine_ID"


def with_dimension(facts: DataFrame, dimension: DataFrame, columns: list[str]) -> DataFrame:
    """Inner join of fact rows to a few columns of the machine dimension.

    The join strategy is left to the planner and adaptive execution, which also splits
    hot machines of an inner join.
    """
    return facts.join(dimension.select(MACHINE, *columns), MACHINE)


def rows_matching(
    facts: DataFrame, per_machine: DataFrame, keep: list[Column], how: str = "inner"
) -> DataFrame:
    """Fact columns ``keep`` joined to a table with one row per machine.

    Equal fact rows of a machine are first counted together, so the shuffle moves
    distinct combinations and a hot machine is cut down before it.  ``_rows`` is how
    many fact rows each output row stands for.
    """
    counted = facts.groupBy(MACHINE, *keep).agg(F.count(F.lit(1)).alias("_rows"))
    return counted.join(per_machine, MACHINE, how)


def average_by_dimension(
    facts: DataFrame, dimension: DataFrame, measure: str, group: Column, *needed: str
) -> DataFrame:
    """Average of a fact measure by an attribute of the machine: columns ``_key, _average``.

    ``needed`` are the dimension columns the ``group`` expression uses.  The facts shrink
    to a sum and a count per machine before the join.
    """
    per_machine = facts.groupBy(MACHINE).agg(
        F.sum(measure).alias("_sum"), F.count(measure).alias("_count")
    )
    partial = (
        per_machine.join(dimension.select(MACHINE, *needed), MACHINE)
        .groupBy(group.alias("_key"))
        .agg(F.sum("_sum").alias("_sum"), F.sum("_count").alias("_count"))
    )
    return partial.select("_key", F.try_divide("_sum", "_count").alias("_average"))

"""Quality of a binary classifier on held-out rows.

Everything starts from a grouped count, so the work after the first aggregation does
not grow with the number of rows (confusion, report) or only with the number of
distinct scores (ROC).
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwarden.plans.running_totals import descending_totals

LABELS = ("Normal", "Failure")


def _count_if_all(rows: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row with the four cells, ``_<actual><predicted>``; one pass, no shuffle of rows."""
    cells = {
        f"_{actual}{predicted}": (F.col(label) == actual) & (F.col(prediction) == predicted)
        for actual in (0, 1)
        for predicted in (0, 1)
    }
    return rows.agg(*[F.count_if(test).alias(name) for name, test in cells.items()])


def confusion_matrix(rows: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Counts by actual (row) and predicted (column) class, zeros included."""
    cells = _count_if_all(rows, label, prediction)
    matrix = F.array(
        *[
            F.struct(
                F.lit(LABELS[actual]).alias("actual"),
                F.col(f"_{actual}0").alias(LABELS[0]),
                F.col(f"_{actual}1").alias(LABELS[1]),
            )
            for actual in (0, 1)
        ]
    )
    return cells.select(F.inline(matrix))


def _ratio(part: Column, whole: Column) -> Column:
    """A quotient that is 0 when undefined."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def classification_report(
    rows: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, macro and weighted means."""
    cells = _count_if_all(rows, label, prediction)
    total = F.col("_00") + F.col("_01") + F.col("_10") + F.col("_11")
    measured = cells.select("*", total.alias("_total"))
    for k, other in ((0, 1), (1, 0)):
        hit = F.col(f"_{k}{k}")
        measured = (
            measured.withColumn(f"s{k}", hit + F.col(f"_{k}{other}"))
            .withColumn(f"p{k}", _ratio(hit, hit + F.col(f"_{other}{k}")))
            .withColumn(f"r{k}", _ratio(hit, F.col(f"s{k}")))
        )
        both = F.col(f"p{k}") + F.col(f"r{k}")
        measured = measured.withColumn(
            f"f{k}", _ratio(2 * F.col(f"p{k}") * F.col(f"r{k}"), both)
        )
    accuracy = _ratio(F.col("_00") + F.col("_11"), F.col("_total"))

    def macro(m: str) -> Column:
        return (F.col(f"{m}0") + F.col(f"{m}1")) / 2

    def weighted(m: str) -> Column:
        return _ratio(
            F.col(f"{m}0") * F.col("s0") + F.col(f"{m}1") * F.col("s1"), F.col("_total")
        )

    def line(name: str, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            precision.alias("precision"),
            recall.alias("recall"),
            f1.alias("f1_score"),
            support.alias("support"),
        )

    lines = [
        line(str(k), F.col(f"p{k}"), F.col(f"r{k}"), F.col(f"f{k}"), F.col(f"s{k}")) for k in (0, 1)
    ]
    lines.append(line("accuracy", accuracy, accuracy, accuracy, F.col("_total")))
    lines.append(line("macro avg", macro("p"), macro("r"), macro("f"), F.col("_total")))
    lines.append(line("weighted avg", weighted("p"), weighted("r"), weighted("f"), F.col("_total")))
    return measured.select(F.inline(F.array(*lines)))


def roc_curve(rows: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """False and true positive rates while the threshold falls, from ``(0, 0)`` on.

    Rows without a score, NULL or NaN, are left out; the others are counted per distinct score first.  Points in the middle of a straight
    run are dropped: a point stays if it is the first, the last, or the step to the
    next point differs from the step that led to it.
    """
    steps = (
        rows.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
        .groupBy(F.col(score).cast("double").alias("threshold"))
        .agg(
            F.count_if(F.col(label) == 1).alias("tp"),
            F.count_if(F.col(label) == 0).alias("fp"),
        )
    )
    walked = descending_totals(steps, "threshold", ["tp", "fp"])
    first = (F.col("total_tp") == F.col("tp")) & (F.col("total_fp") == F.col("fp"))
    last = F.col("next_tp").isNull()
    turns = (F.col("next_tp") != F.col("tp")) | (F.col("next_fp") != F.col("fp"))
    points = walked.where(first | last | turns).select(
        F.try_divide(F.col("total_fp").cast("double"), F.col("all_fp").cast("double")).alias("fpr"),
        F.try_divide(F.col("total_tp").cast("double"), F.col("all_tp").cast("double")).alias("tpr"),
    )
    origin = rows.sparkSession.range(1).select(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return origin.unionByName(points)

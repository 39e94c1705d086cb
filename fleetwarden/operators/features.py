"""Model features from telemetry, with an encoding that training and scoring share."""

from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetwarden import schemas

# Fixed values.
DROPPED = (
    "Machine_ID",
    "Timestamp",
    "Installation_Date",
    "Last_Maintenance_Date",
    "Failure_Type",
    "Predicted_Failure_Time",
)
CATEGORICAL = ("Machine_Type", "Workload", "Maintenance_Type")
LABEL = "Failure_Status"
NUMERIC = tuple(
    name
    for name in schemas.TELEMETRY.names
    if name not in DROPPED and name not in CATEGORICAL and name != LABEL
)


@dataclass(frozen=True)
class FeatureSpec:
    """Numeric columns, and the encoded levels of each categorical column, in order."""

    numeric: tuple[str, ...]
    levels: dict[str, tuple[str, ...]]

    @property
    def columns(self) -> list[str]:
        encoded = [f"{name}_{level}" for name, levels in self.levels.items() for level in levels]
        return [*self.numeric, *encoded]

    def expressions(self) -> list[Column]:
        """The feature columns, as doubles, over a table with the raw columns.

        NULL counts as 0, negative readings as 0, and a category outside the saved
        levels as none of them.
        """
        numeric = [cleaned(F.col(name)).alias(name) for name in self.numeric]
        encoded = [
            F.coalesce((F.col(name) == level).cast("double"), F.lit(0.0)).alias(f"{name}_{level}")
            for name, levels in self.levels.items()
            for level in levels
        ]
        return numeric + encoded

    def with_vector(self, rows: DataFrame, *keep: str | Column) -> DataFrame:
        """``keep`` and the same features as one vector, ``features``.

        The vector is sparse, so a column of very many levels costs a row one entry.
        """
        encoded = [name for name, levels in self.levels.items() if levels]
        numeric = {f"_number_{i}": cleaned(F.col(name)) for i, name in enumerate(self.numeric)}
        level = {f"_level_{i}": F.col(name) for i, name in enumerate(encoded)}
        index, vector = ([f"{c}_{kind}" for c in level] for kind in ("index", "vector"))
        rows = rows.select(*keep, *[c.alias(name) for name, c in (numeric | level).items()])
        for name, text, number in zip(encoded, level, index):
            # other levels and NULL share the last index, which the encoder leaves out
            labels = list(self.levels[name])
            indexer = StringIndexerModel.from_labels(labels, text, number, handleInvalid="keep")
            rows = indexer.transform(rows)
        if encoded:
            rows = OneHotEncoder(inputCols=index, outputCols=vector).fit(rows).transform(rows)
        assembler = VectorAssembler(
            inputCols=[*numeric, *vector], outputCol="features", handleInvalid="keep"
        )
        made = assembler.transform(rows).drop(*numeric, *level, *index, *vector)
        return made.withMetadata("features", {})

    def save(self, spark: SparkSession, path: str) -> None:
        """Write one row per feature column, in order."""
        self.table(spark).coalesce(1).write.mode("overwrite").parquet(path)

    def table(self, spark: SparkSession) -> DataFrame:
        """position, source and level (null for a number) of every feature column."""
        rows = [(i, name, None) for i, name in enumerate(self.numeric)]
        for name, levels in self.levels.items():
            rows += [(len(rows) + i, name, level) for i, level in enumerate(levels)]
        return spark.createDataFrame(rows, "position int, source string, level string")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FeatureSpec":
        rows = spark.read.parquet(path).orderBy("position").collect()
        levels: dict[str, list[str]] = {name: [] for name in CATEGORICAL}
        for row in rows:
            if row["level"] is not None:
                levels[row["source"]].append(row["level"])
        numeric = tuple(row["source"] for row in rows if row["level"] is None)
        return cls(numeric, {name: tuple(found) for name, found in levels.items()})


def cleaned(column: Column) -> Column:
    """A number with gaps as 0, then negatives as 0."""
    return F.greatest(F.coalesce(column.cast("double"), F.lit(0.0)), F.lit(0.0))


def fit_features(telemetry: DataFrame, numeric: tuple[str, ...] = NUMERIC) -> FeatureSpec:
    """Learn the categories to encode.

    NULLs are filled before encoding, so a column with gaps has the fill value as
    its lowest level.  The lowest level of each column is left out: the fill value
    where there are gaps, else the first in alphabetical order.  The levels are held on
    the driver, as MLlib's indexer holds them.
    """
    long_form = F.array(
        *[F.struct(F.lit(name).alias("name"), F.col(name).alias("level")) for name in CATEGORICAL]
    )
    found: dict[str, list] = {name: [] for name in CATEGORICAL}
    for name, level in telemetry.select(F.inline(long_form)).distinct().collect():
        found[name].append(level)
    levels = {}
    for name, values in found.items():
        known = sorted(level for level in values if level is not None)
        has_gaps = len(known) < len(values)
        levels[name] = tuple(known if has_gaps else known[1:])
    return FeatureSpec(tuple(numeric), levels)


def prepare_features(telemetry: DataFrame, spec: FeatureSpec, *keep: str) -> DataFrame:
    """Feature columns, the label and any columns to ``keep``."""
    label = F.coalesce(F.col(LABEL), F.lit(0)).alias(LABEL)
    return telemetry.select(*keep, *spec.expressions(), label)


def training_rows(telemetry: DataFrame, spec: FeatureSpec, *keep: str) -> DataFrame:
    """The same features as one vector column, for the classifier."""
    label = F.coalesce(F.col(LABEL), F.lit(0)).cast("double").alias("label")
    return spec.with_vector(telemetry, *keep, label).select(*keep, "features", "label")

"""Boosted trees as a table: a row for each node, which SQL alone can walk.

``tree_table`` reads the trees of a kept classifier from where MLlib saved them and names what
each node asks: a number (``source``) or whether a category has a level (``source``, ``level``),
so no feature vector and no list of levels is needed to score a row. Its size is that of the
model, whatever the data.
"""

import math
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from fleetwarden.operators.features import CATEGORICAL, cleaned

LEAF = -1
#: Nodes of all trees that are written out as one expression at most; more are walked as arrays.
WRITTEN_OUT = 20_000


def tree_table(spark: SparkSession, stage_path: str, features: DataFrame, depth: int) -> DataFrame:
    """The nodes of a saved ensemble: tree, weight, node, source, level, threshold, left, right, leaf.

    ``features`` names the entries of the vector (position, source, level). Nodes of a tree are
    numbered from 0, its root; a leaf has -1 for both children and its value in ``leaf``.
    ``depth`` says how deep a tree may be.
    """
    nodes = spark.read.parquet(f"{stage_path}/data").select("treeID", "nodeData.*")
    # Saved without names: the tree's number, its metadata and its weight.
    weights = spark.read.parquet(f"{stage_path}/treesMetadata").toDF("treeID", "metadata", "weights")
    weights = weights.drop("metadata")
    inner = F.col("leftChild") >= 0
    split = F.col("split")
    numbered = nodes.join(F.broadcast(weights), "treeID").select(
        F.col("treeID").cast("int").alias("tree"),
        F.col("weights").cast("double").alias("weight"),
        F.col("id").cast("int").alias("node"),
        F.when(inner, split["featureIndex"]).alias("position"),
        F.when(inner, F.get(split["leftCategoriesOrThreshold"], F.lit(0))).alias("threshold"),
        F.when(inner, F.col("leftChild")).otherwise(LEAF).cast("int").alias("left"),
        F.when(inner, F.col("rightChild")).otherwise(LEAF).cast("int").alias("right"),
        F.when(~inner, F.col("prediction")).alias("leaf"),
    )
    named = numbered.join(features.select("position", "source", "level"), "position", "left")
    return named.select(
        "tree", "weight", "node", "source", "level", "threshold", "left", "right", "leaf",
        F.lit(depth).alias("depth"),
    )


def _forest(trees: DataFrame) -> DataFrame:
    """One row: ``asked``, the different questions of all nodes, and ``trees`` in order.

    A tree is arrays over its nodes in order: the place of its question, the threshold, where it
    leads and the value. A leaf asks nothing and leads to itself. ``steps`` has an entry for each
    level that the tree may have.
    """
    inner = F.col("left") != LEAF
    node = F.struct("node", "source", "level", "threshold", "left", "right", "leaf")
    by_tree = trees.groupBy("tree", "weight", "depth").agg(
        F.array_sort(F.collect_list(node)).alias("nodes"),
        F.collect_set(F.when(inner, F.struct("source", "level"))).alias("questions"),
    )
    tree = F.struct("tree", "weight", "depth", "nodes")
    forest = by_tree.agg(
        F.array_sort(F.collect_list(tree)).alias("forest"),
        F.array_distinct(F.flatten(F.collect_list("questions"))).alias("asked"),
    )

    def arrays(tree: Column) -> Column:
        nodes = tree["nodes"]

        def place(node: Column) -> Column:
            question = F.struct(node["source"], node["level"])
            return F.when(node["left"] != LEAF, F.array_position("asked", question) - 1).cast("int")

        def child(side: str) -> Column:
            return F.transform(nodes, lambda node, at: F.when(node["left"] == LEAF, at).otherwise(node[side]))

        # No path is longer than the number of nodes that ask.
        steps = F.least(tree["depth"], F.floor((F.size(nodes) - 1) / 2).cast("int"))
        return F.struct(
            tree["weight"].alias("weight"),
            F.transform(nodes, place).alias("place"),
            nodes["threshold"].alias("threshold"),
            child("left").alias("left"),
            child("right").alias("right"),
            nodes["leaf"].alias("leaf"),
            F.array_repeat(F.lit(0), steps).alias("steps"),
        )

    return forest.select("asked", F.transform("forest", arrays).alias("trees"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once a row.

    A column that only a lambda reads is put into the lambda by the optimizer and would be
    computed again for each element; a lambda's own argument is not.
    """
    return F.transform(F.array(value), use)[0]


def _double(value: float | None) -> str:
    """A number as SQL."""
    if value is None or not math.isfinite(value):
        return "CAST(NULL AS DOUBLE)" if value is None else f"CAST('{value}' AS DOUBLE)"
    return f"{value!r}D"


def _written_out(
    nodes: list[Row], numeric: tuple[str, ...]
) -> tuple[list[tuple[str | None, str | None]], list[str]]:
    """The different questions of the nodes, and the SQL of each tree's part of the margin, in order.

    The SQL reads the answer to question i as ``asked.a<i>``. The numbers come first, asked or not.
    """
    questions = {(name, None): i for i, name in enumerate(dict.fromkeys(numeric))}
    by_tree = defaultdict(list)
    for node in nodes:
        by_tree[node["tree"], node["weight"], node["depth"]].append(
            tuple(node[c] for c in ("node", "source", "level", "threshold", "left", "right", "leaf"))
        )

    def walk(tree: list[tuple], weight: float, at: int, steps: int) -> str:
        _, source, level, threshold, left, right, leaf = tree[at]
        if left == LEAF or not steps:
            return _double(None if leaf is None else weight * leaf)
        answer = f"asked.a{questions.setdefault((source, level), len(questions))}"
        low, high = (walk(tree, weight, child, steps - 1) for child in (left, right))
        return f"CASE WHEN {answer} <= {_double(threshold)} THEN {low} ELSE {high} END"

    parts = []
    for (_, weight, depth), tree in sorted(by_tree.items(), key=lambda item: item[0]):
        tree.sort(key=lambda node: [(value is not None, value) for value in node])
        # No path is longer than the number of nodes that ask.
        parts.append(walk(tree, weight, 0, min(depth, (len(tree) - 1) // 2)))
    return list(questions), parts


def with_margin(rows: DataFrame, trees: DataFrame, numeric: tuple[str, ...]) -> DataFrame:
    """``rows`` (with the raw columns) and ``margin``, the weighted sum over the trees in order.

    The questions of all nodes are answered once a row, and every tree is walked from its root on
    the row itself, without multiplying rows. The trees are read while the column is built; those
    of up to ``WRITTEN_OUT`` nodes become an expression, in which a step down a tree is one
    comparison with a constant. Larger ones come in as one value.
    """
    nodes = trees.limit(WRITTEN_OUT + 1).collect()
    if len(nodes) > WRITTEN_OUT:
        return _with_margin_of_arrays(rows, trees, numeric)
    questions, parts = _written_out(nodes, numeric)

    def answer(source: str | None, level: str | None) -> Column:
        if level is None:
            return cleaned(F.col(source)) if source in numeric else F.lit(None).cast("double")
        return F.col(source).eqNullSafe(level).cast("double") if source in CATEGORICAL else F.lit(0.0)

    answers = F.struct(F.lit(0.0), *[answer(*q).alias(f"a{i}") for i, q in enumerate(questions)])
    # The struct is the argument of a lambda so that it is computed once a row; see ``_once``.
    parts = ", ".join(parts) or "0.0D"
    walk = f"aggregate(array({parts}), 0.0D, (total, part) -> total + part)"
    margin = F.expr(f"transform(array(_asked), asked -> {walk})[0]")
    return rows.withColumn("_asked", answers).withColumn("margin", margin).drop("_asked")


def _with_margin_of_arrays(rows: DataFrame, trees: DataFrame, numeric: tuple[str, ...]) -> DataFrame:
    """``with_margin`` by higher-order functions over the trees as one value, as large as the model.

    The questions of all nodes are answered once a row, so that a step reads a few arrays by place.
    """
    numbers = F.create_map(*[x for n in numeric for x in (F.lit(n), cleaned(F.col(n)))])
    texts = F.create_map(*[x for n in CATEGORICAL for x in (F.lit(n), F.col(n))])
    given = F.struct(numbers.alias("numbers"), texts.alias("texts"), F.col("_forest").alias("forest"))

    def answers(given: Column) -> Column:
        def answer(question: Column) -> Column:
            has_level = F.try_element_at(given["texts"], question["source"]).eqNullSafe(question["level"])
            number = F.try_element_at(given["numbers"], question["source"])
            return F.when(question["level"].isNull(), number).otherwise(has_level.cast("double"))

        return F.transform(given["forest"]["asked"], answer)

    def total(values: Column, trees: Column) -> Column:
        def leaf_of(tree: Column) -> Column:
            def step(at: Column, _: Column) -> Column:
                low = F.get(values, F.get(tree["place"], at)) <= F.get(tree["threshold"], at)
                return F.when(low, F.get(tree["left"], at)).otherwise(F.get(tree["right"], at))

            return F.get(tree["leaf"], F.aggregate(tree["steps"], F.lit(0), step))

        return F.aggregate(trees, F.lit(0.0), lambda sum_, tree: sum_ + tree["weight"] * leaf_of(tree))

    margin = _once(given, lambda g: _once(answers(g), lambda values: total(values, g["forest"]["trees"])))
    forest = _forest(trees).select(F.struct("asked", "trees")).scalar()
    return rows.withColumn("_forest", forest).withColumn("margin", margin).drop("_forest")


def failure_probability(margin: Column) -> Column:
    """The score that log loss gives a margin."""
    return 1 / (1 + F.exp(-2 * margin))

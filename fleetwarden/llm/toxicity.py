"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct n-grams of a text's lower-cased bytes, hashed into a fixed number of
slots. In training, each slot's log ratio between its smoothed share in toxic and in other
texts is its scale; a ridge-penalised logistic regression is fitted to the scaled sets.
Scoring is one pass over the documents without a shuffle.

The model is fitted on at most ``max_rows`` labelled rows, those with the smallest hash of
their id; scores cover all rows and whole texts.

Defined results: null and empty texts have no n-grams and get the score of the intercept;
rows without a label or an id teach nothing; with one class only, or no labelled row, the
score is the smoothed share of toxic rows (a half without any); input columns named like the
output's are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwarden.llm import text
from fleetwarden.llm.frames import cut, ddl, share, shared, without
from fleetwarden.llm.linear import fit_sets, sigmoid, slot_counts

SIZES = (3, 4, 5)
BITS = 20
MAX_ROWS = 4000
LEAST = 10


@dataclass
class Model:
    weights: np.ndarray
    intercept: float
    sizes: tuple[int, ...]
    bits: int


def gram_sets(column, sizes: tuple[int, ...], bits: int) -> Iterator[np.ndarray]:
    """The distinct n-gram slots of each text, n-grams of bytes with A-Z lower-cased."""
    data, offsets = text.utf8(column)
    values = text.BYTE_VALUES[text.LOWER[data]]
    slots = []
    for n in sizes:
        total = np.zeros(max(0, len(values) - n + 1), np.uint64)
        for k in range(n):
            total = total * np.uint64(text.BASE) + values[k : len(values) - n + 1 + k]
        slots.append((total >> np.uint64(64 - bits)).astype(np.int32))
    for start, end in zip(offsets[:-1], offsets[1:]):
        own = [s[start : max(start, end - n + 1)] for n, s in zip(sizes, slots)]
        yield np.unique(np.concatenate(own))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, salt: int) -> DataFrame:
    """At most ``max_rows`` texts with their label, chosen by the hash of the id: doc_id, text, label."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label"))
    rows = rows.where("doc_id IS NOT NULL AND label IN (0, 1)").distinct()
    chosen = rows.orderBy(F.xxhash64("doc_id", F.lit(salt)), "doc_id", "label").limit(max_rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    label: str = "toxic",
    sizes: tuple[int, ...] = SIZES,
    bits: int = BITS,
    max_rows: int = MAX_ROWS,
    least: int = LEAST,
) -> Model:
    """Fit on the labelled documents given; leave held-out rows out of ``labels``.

    n-grams that fewer than ``least`` rows have get no weight (with fewer than 50 times
    ``least`` rows: fewer than a fiftieth of them). The sets of n-grams are written once and stay
    in the tasks; only counts and gradients of the n-grams in use reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text.pieces(batch):
                sets = [s.astype(np.int32).tobytes() for s in gram_sets(rows.column("text"), sizes, bits)]
                rows = rows.select(["label"]).append_column("slots", pa.array(sets, pa.binary()))
                yield from rows.to_batches()

    sample = labelled_sample(docs, labels, label, max_rows, 10).select("label", "text")
    rows = cut(sample.mapInArrow(run, "label int, slots binary"))
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    share_of_toxic = (toxic + 1) / (n + 2)
    weights = np.zeros(1 << bits, np.float32)
    if not 0 < toxic < n:
        return Model(weights, float(np.log(share_of_toxic / (1 - share_of_toxic))), sizes, bits)
    used, others, toxics = slot_counts(rows, min(least, max(1, n // 50)))
    ratio = np.log((toxics + 1) / (toxic + 2)) - np.log((others + 1) / (n - toxic + 2))
    found, intercept = fit_sets(rows, used, ratio, share_of_toxic)
    weights[used] = found
    return Model(weights, intercept, sizes, bits)


def score(docs: DataFrame, model: Model, *, keep_text: bool = True) -> DataFrame:
    """The documents with ``score`` (0 to 1) and ``predicted`` (1 from a half on)."""
    docs = without(docs, ["score", "predicted"])
    sent = share(docs, model)
    kept = docs if keep_text else without(docs, ["text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared(sent)
        for batch in batches:
            for rows in text.pieces(batch):
                margin = np.array(
                    [
                        m.weights[s].sum(dtype=float)
                        for s in gram_sets(rows.column("text"), m.sizes, m.bits)
                    ]
                )
                scores = sigmoid(margin + m.intercept)
                rows = rows if keep_text else rows.drop_columns(["text"])
                rows = rows.append_column("score", pa.array(scores))
                rows = rows.append_column("predicted", pa.array((scores >= 0.5).astype(np.int32)))
                yield from rows.to_batches()

    return docs.mapInArrow(run, ddl(kept, "score double, predicted int"))

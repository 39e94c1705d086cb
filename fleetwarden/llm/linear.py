"""Logistic regression over sets of hashed features, and through one feature.

Sets stay in the tasks: features are counted by grouping, and each round of the fit sends out
the weights and gets back one gradient a partition, both as long as the features in use.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwarden.llm.frames import share, shared

#: Partitions whose gradients are added up on the driver in each round.
PARTS = 8
#: Errors are rounded to this part of one, so that their sums are exact in any order.
UNIT = 2.0**-30


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def slot_counts(rows: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features that at least ``least`` rows have, in order, and how many rows of label 0 and
    of label 1 have each. ``rows`` has label (0 or 1) and slots (distinct int32, as bytes)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = [np.frombuffer(x.as_buffer(), np.int32) for x in batch.column("slots")]
            truth = np.repeat(batch.column("label").to_numpy(), [len(s) for s in slots])
            both = np.concatenate([np.empty(0, np.int32), *slots]).astype(np.int64) * 2 + truth
            found, n = np.unique(both, return_counts=True)
            arrays = [pa.array(found >> 1), pa.array(found & 1), pa.array(n.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, ["slot", "label", "n"])

    counted = rows.mapInArrow(count, "slot bigint, label bigint, n bigint")
    of = lambda k: F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0))
    sums = counted.groupBy("slot").agg(of(0).alias("n0"), of(1).alias("n1"))
    found = sums.where(F.col("n0") + F.col("n1") >= least).toArrow().sort_by("slot")
    return tuple(found.column(c).to_numpy().astype(np.int64) for c in ("slot", "n0", "n1"))


def fit_sets(
    rows: DataFrame,
    used: np.ndarray,
    scale: np.ndarray,
    share_of_ones: float,
    *,
    ridge: float = 10.0,
    rounds: int = 40,
) -> tuple[np.ndarray, float]:
    """Weights (already times ``scale``) of the features ``used``, and the intercept.

    A row's value of a feature is the feature's scale if the row has it. Full-batch gradient
    steps with adaptive rates, a job each; the same rows give the same weights, however they
    are dealt. The rows are read in every round: let them be written ones.
    """
    rows = rows.coalesce(PARTS)
    place_sent = share(rows, used.astype(np.int32))
    w = np.zeros(len(used))
    b = float(np.log(share_of_ones / (1 - share_of_ones)))
    m, v, rate = np.zeros(len(used) + 1), np.zeros(len(used) + 1), 0.02
    for step in range(1, rounds + 1):
        sent = share(rows, (w * scale, b))

        def gradient(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known, (weights, intercept) = shared(place_sent), shared(sent)
            sums, total = np.zeros(len(known)), 0.0
            for batch in batches:
                for label, slots in zip(batch.column("label").to_pylist(), batch.column("slots")):
                    own = np.frombuffer(slots.as_buffer(), np.int32)
                    at = np.searchsorted(known, own)
                    at = at[(at < len(known)) & (known[np.minimum(at, len(known) - 1)] == own)]
                    error = np.round((sigmoid(weights[at].sum() + intercept) - label) / UNIT)
                    sums[at] += error
                    total += error
            yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()]), pa.array([total])], ["sums", "total"])

        parts = rows.mapInArrow(gradient, "sums binary, total double").collect()
        sent.destroy()
        sums = np.sum([np.frombuffer(p["sums"]) for p in parts], axis=0) * UNIT
        grad = np.append(sums * scale + ridge * w, sum(p["total"] for p in parts) * UNIT)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w * scale, b


def fit_platt(x: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept of a logistic curve through one feature, by Newton's method."""
    if len(x) == 0 or labels.min() == labels.max():
        rate = float(labels.mean()) if len(x) else 0.5
        return 0.0, float(np.log((rate + 1e-3) / (1 - rate + 1e-3)))
    centre, spread = float(x.mean()), float(x.std()) or 1.0
    z, a, b = (x - centre) / spread, 0.0, 0.0
    for _ in range(rounds):
        p = sigmoid(a * z + b)
        q = p * (1 - p) + 1e-9
        ga, gb = np.sum((p - labels) * z) + 0.01 * a, np.sum(p - labels)
        haa, hab, hbb = np.sum(q * z * z) + 0.01, np.sum(q * z), np.sum(q)
        det = haa * hbb - hab * hab
        a -= (hbb * ga - hab * gb) / det
        b -= (haa * gb - hab * ga) / det
    return a / spread, b - a * centre / spread

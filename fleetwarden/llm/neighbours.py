"""Approximate nearest neighbours by multi-index hashing.

Vectors get binary codes: a principal-component projection and a rotation learned so that the
signs lose little (iterative quantisation). Codes are split into substrings of eight bits, and
every block of vectors keeps one table for each substring. If two codes differ in at most r
bits, one of m substrings differs in at most r // m: probing the buckets that near gives every
code within r, and the original vectors of those are measured in double precision.

Projection, rotation and radius are learned from a bounded sample, the rows with the smallest
hash of their id; the radius covers nearly all true neighbours of the sample. Every row is
indexed. Queries are broadcast in blocks of a bounded number; each task answers them from its
own rows with the nearest few, so that what is shuffled grows with queries, not with pairs.
A query that found fewer than wanted is asked again with the full radius, which is exact.

Defined results: rows without an id, and vectors that are null, zero, of another length than
most of the sample or hold null or non-finite components take no part; a query never finds
rows of its own id; ties go to the smaller id; repeated rows are found each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetwarden.llm.frames import cut, share, shared

BITS, PART = 64, 8
MAX_ROWS = 8000
#: Share of the sample's true neighbours that the radius covers.
COVERED = 0.99
#: Queries that are broadcast at once, and rows that are indexed together.
QUERIES, ROWS = 2000, 8192


@dataclass
class Model:
    length: int
    mean: np.ndarray
    project: np.ndarray
    radius: int

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """The codes as rows of BITS // 8 bytes."""
        return np.packbits((vectors - self.mean) @ self.project > 0, axis=1)


def vectors_of(ids, column, length: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the rows that take part."""
    keep_ids, keep = [], []
    for i, v in zip(ids.to_pylist(), column.to_pylist()):
        if i is None or v is None or (length is not None and len(v) != length) or None in v:
            continue
        x = np.array(v, dtype=float)
        if x.size and np.isfinite(x).all() and x.any():
            keep_ids.append(i), keep.append(x)
    return np.array(keep_ids, np.int64), keep


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(axis=1))


def fit(vectors: DataFrame, *, k: int = 10, max_rows: int = MAX_ROWS, rounds: int = 25) -> Model:
    """Learn projection, rotation and radius from at most ``max_rows`` rows."""
    some = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    some = some.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(max_rows)
    sample = some.toArrow().sort_by("vec_id")
    _, found = vectors_of(sample.column("vec_id"), sample.column("embedding"), None)
    if not found:
        return Model(0, np.zeros(0), np.zeros((0, BITS)), BITS)
    lengths = [len(v) for v in found]
    length = max(sorted(set(lengths)), key=lengths.count)
    x = np.array([v for v in found if len(v) == length])
    mean = x.mean(axis=0)
    _, _, axes = np.linalg.svd(x - mean, full_matrices=False)
    axes = axes[:BITS].T
    y = (x - mean) @ axes
    rotation = np.linalg.qr(np.random.default_rng(3).normal(size=(BITS, BITS)))[0][: y.shape[1]]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(y.T @ np.sign(y @ rotation), full_matrices=False)
        rotation = u @ v
    model = Model(length, mean, axes @ rotation, BITS)
    codes = model.codes(x).view(np.uint64).ravel()
    gaps = []
    for i in range(0, len(x), max(1, len(x) // 300)):
        d = distances(x[i], x)
        d[i] = np.inf
        near = np.argsort(d, kind="stable")[: min(k, len(x) - 1)]
        gaps += np.bitwise_count(codes[near] ^ codes[i]).tolist()
    model.radius = int(np.quantile(gaps, COVERED)) if gaps else BITS
    return model


class Index:
    """Tables of a block of codes: for each substring, the rows in order of its value."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.whole = codes.view(np.uint64).ravel()
        self.order = [np.argsort(c, kind="stable") for c in codes.T]
        self.ends = [np.cumsum(np.bincount(c, minlength=256)) for c in codes.T]
        bits = np.bitwise_count(np.arange(256, dtype=np.uint8))
        self.by_weight = [np.flatnonzero(bits <= r) for r in range(PART + 1)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code differs from this one in at most ``radius`` bits."""
        near = self.by_weight[min(PART, radius // len(code))]
        hit = np.zeros(len(self.whole), bool)
        for value, order, ends in zip(code, self.order, self.ends):
            buckets = near ^ int(value)
            last, first = ends[buckets], np.where(buckets > 0, ends[buckets - 1], 0)
            many = last - first
            places = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
            hit[order[places]] = True
        rows = np.flatnonzero(hit)
        return rows[np.bitwise_count(self.whole[rows] ^ code.view(np.uint64)[0]) <= radius]


def _answers(vectors: DataFrame, model: Model, queries: list, k: int, radius: int) -> DataFrame:
    """query_id, vec_id, score: what each block of rows finds for each query."""
    sent = share(vectors, (model, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, queries = shared(sent)
        asked = np.array([q for _, q in queries])
        codes = model.codes(asked)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                rows = batch.slice(start, ROWS)
                ids, found = vectors_of(rows.column("vec_id"), rows.column("embedding"), model.length)
                if not len(ids):
                    continue
                x = np.array(found)
                index = Index(model.codes(x))
                out: list[tuple[np.ndarray, ...]] = []
                for (query, _), q, code in zip(queries, asked, codes):
                    near = index.within(code, radius)
                    near = near[ids[near] != query]
                    d = distances(q, x[near])
                    best = np.lexsort((ids[near], d))[:k]
                    out.append((np.full(len(best), query), ids[near[best]], d[best]))
                columns = [pa.array(np.concatenate(c)) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score"])

    return vectors.mapInArrow(run, "query_id bigint, vec_id bigint, score double")


def _best(answers: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, model: Model, *, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found of each query, by Euclidean distance."""
    vectors, queries = (df.select("vec_id", "embedding") for df in (vectors, queries))
    none = vectors.sparkSession.createDataFrame([], "query_id bigint, vec_id bigint, score double, rank int")
    result = none
    blocks = queries.count() // QUERIES + 1 if model.length else 0
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).distinct().toArrow()
        ids, found = vectors_of(rows.column("vec_id"), rows.column("embedding"), model.length)
        asked = sorted(zip(ids.tolist(), found), key=lambda a: a[0])
        if not asked:
            continue
        best = cut(_best(_answers(vectors, model, asked, k, model.radius), k))
        enough = {r.query_id for r in best.groupBy("query_id").count().where(F.col("count") >= k).collect()}
        again = [a for a in asked if a[0] not in enough]
        if again:
            best = best.where(~F.col("query_id").isin([a[0] for a in again]))
            best = best.unionByName(_best(_answers(vectors, model, again, k, BITS), k))
        result = result.unionByName(best)
    return result.select("query_id", "rank", "vec_id", "score")

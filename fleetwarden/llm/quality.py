"""Quality: a compression classifier with one zstandard dictionary for each label.

Good and bad labelled texts are the contents of two raw dictionaries of one size. A text is
compressed with either; the difference of the two sizes, divided by their sum, tells which
kind it is more like. A logistic curve, fitted to labelled texts that are in neither
dictionary, turns that into a score. Scoring is one pass without a shuffle, over whole texts.

Dictionaries and curve are made from at most ``max_rows`` labelled rows, for each label those
with the smallest hash of their id; the first half is for the dictionaries. The curve is
fitted to whole texts, which are compressed where they are read.

Defined results: null and empty texts score as the curve does at a difference of zero; rows
without a label or an id teach nothing; with one class only, or no labelled row, all texts get
the smoothed share of good rows (a half without any); input columns named like the output's
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetwarden.llm import text
from fleetwarden.llm.frames import ddl, share, shared, without
from fleetwarden.llm.linear import fit_platt, sigmoid

MAX_ROWS = 4000
DICTIONARY_BYTES = 512 << 10
#: Characters of one text that reach the driver at most, from a place that the id's hash gives.
EXCERPT = 8 << 10
LEVEL = 6


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float
    intercept: float


class Sizes:
    """Compressed sizes of a text under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.compress = [
            zstandard.ZstdCompressor(
                level=LEVEL, dict_data=self.dictionary(d), write_content_size=False
            ).compress
            for d in (good, bad)
        ]

    @staticmethod
    def dictionary(content: bytes):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        return d

    def difference(self, data: bytes) -> float:
        """From -1 (like the bad texts) to 1 (like the good ones)."""
        if not data:
            return 0.0
        good, bad = (len(c(data)) for c in self.compress)
        return (bad - good) / (bad + good)

    def differences(self, column) -> np.ndarray:
        """The difference of each whole text."""
        data, offsets = text.utf8(column)
        data = data.tobytes()
        spans = zip(offsets[:-1].tolist(), offsets[1:].tolist())
        return np.array([self.difference(data[a:b]) for a, b in spans], float)


def fair_share(texts: list[bytes], size: int) -> bytes:
    """The texts, line by line, in ``size`` bytes: where they don't fit, the longest are cut alike."""
    left = max(0, size - len(texts) + 1)
    limit = extra = 0
    for k, length in enumerate(sorted(map(len, texts))):
        limit, extra = divmod(left, len(texts) - k)
        if length > limit:
            break
        limit, extra, left = length, 0, left - length
    parts = []
    for t in texts:
        more = int(len(t) > limit and extra > 0)
        extra -= more
        parts.append(t[: limit + more])
    return b"\n".join(parts)[:size]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    label: str = "quality",
    max_rows: int = MAX_ROWS,
    dictionary_bytes: int = DICTIONARY_BYTES,
    excerpt: int = EXCERPT,
) -> Model:
    """Fit on the labelled documents given; leave held-out rows out of ``labels``.

    Every row chosen for a dictionary of ``dictionary_bytes`` has a share of it, from at most
    ``excerpt`` characters of its text.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label"))
    rows = rows.where("doc_id IS NOT NULL AND label IN (0, 1)").distinct()
    at = F.xxhash64("doc_id", F.lit(7))
    chosen = None
    for kind in (0, 1):
        best = rows.where(F.col("label") == kind).orderBy(at, "doc_id").limit(max_rows // 2)
        chosen = best if chosen is None else chosen.union(best)
    # at most max_rows rows: the first half of a kind goes to its dictionary
    kind = Window.partitionBy("label")
    place = F.row_number().over(kind.orderBy(at, "doc_id"))
    half = F.greatest(F.lit(1), F.floor(F.count("*").over(kind) / 2))
    chosen = F.broadcast(chosen.select("*", place.alias("place"), half.alias("half")))
    sample = docs.select("doc_id", "text").join(chosen, "doc_id").where("length(text) > 0")
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_bad, n_good = counts.get(0, 0), counts.get(1, 0)
    odds = float(np.log((n_good + 1) / (n_bad + 1)))

    last_start = F.greatest(F.lit(1), F.length("text") - excerpt + 2)
    start = F.pmod(F.xxhash64("doc_id", F.lit(8)), last_start).cast("int") + 1
    piece = F.substr("text", start, F.lit(excerpt)).alias("text")
    taught = sample.where("place <= half").select("place", "label", piece).toArrow()
    taught = taught.sort_by([("place", "ascending"), ("label", "ascending"), ("text", "ascending")])
    contents: dict[int, list[bytes]] = {0: [], 1: []}
    for kind, own in zip(taught.column("label").to_pylist(), taught.column("text").to_pylist()):
        contents[kind].append(own.encode())
    size = min(dictionary_bytes, *(len(b"\n".join(own)) for own in contents.values()))
    good, bad = fair_share(contents[1], size), fair_share(contents[0], size)
    if not size:
        return Model(b"", b"", 0.0, odds)
    sent = share(docs, Model(good, bad, 0.0, 0.0))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared(sent)
        sizes = Sizes(m.good, m.bad)
        for batch in batches:
            for rows in text.pieces(batch):
                x = pa.array(sizes.differences(rows.column("text")))
                yield from rows.select(["place", "label"]).append_column("x", x).to_batches()

    rest = sample.where("place > half").select("place", "label", "text")
    rest = rest.mapInArrow(measure, "place int, label int, x double").toArrow()
    rest = rest.sort_by([("place", "ascending"), ("label", "ascending"), ("x", "ascending")])
    truth = rest.column("label").to_numpy().astype(float)
    if not 0 < truth.sum() < len(truth):
        return Model(b"", b"", 0.0, odds)
    slope, intercept = fit_platt(rest.column("x").to_numpy(), truth)
    seen = float(np.log((truth.sum() + 1) / (len(truth) - truth.sum() + 1)))
    return Model(good, bad, slope, intercept + odds - seen)


def score(docs: DataFrame, model: Model, *, keep_text: bool = True) -> DataFrame:
    """The documents with ``score`` (0 to 1, higher is better) and ``predicted``."""
    docs = without(docs, ["score", "predicted"])
    sent = share(docs, model)
    kept = docs if keep_text else without(docs, ["text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared(sent)
        sizes = Sizes(m.good, m.bad) if m.good and m.bad else None
        for batch in batches:
            for rows in text.pieces(batch):
                x = sizes.differences(rows.column("text")) if sizes else np.zeros(rows.num_rows)
                scores = sigmoid(m.slope * x + m.intercept)
                rows = rows if keep_text else rows.drop_columns(["text"])
                rows = rows.append_column("score", pa.array(scores))
                rows = rows.append_column("predicted", pa.array((scores >= 0.5).astype(np.int32)))
                yield from rows.to_batches()

    return docs.mapInArrow(run, ddl(kept, "score double, predicted int"))

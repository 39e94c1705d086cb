"""Scores against plain formulas, pipeline stages with clashing columns, empty tables."""

import itertools
import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from fleetwarden.llm import (
    bpe,
    decontamination,
    language,
    linear,
    lines,
    ngram_join,
    periods,
    quality,
    quotations,
    repair,
    repeats,
    text,
    toxicity,
)
from tests.llm.conftest import SMALL

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
MASK = 2**64 - 1


def plain_sigmoid(x):
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def plain_slots(words, sizes, bits):
    """The slots of a text's distinct n-grams of bytes, with Python's own numbers."""
    data = (words or "").encode().translate(LOWER)
    found = set()
    for n in sizes:
        for i in range(len(data) - n + 1):
            total = 0
            for b in data[i : i + n]:
                total = (total * text.BASE + int(text.BYTE_VALUES[b])) & MASK
            found.add(total >> (64 - bits))
    return found


def test_toxicity_is_its_formula(small, make, edges):
    docs, labels = small("documents").limit(60), small("labels")
    model = toxicity.fit(small("documents"), labels, bits=14, max_rows=100, least=3)
    for frame in (docs, make([r for r in edges if len(r[1] or "") < 10_000])):
        for r in toxicity.score(frame, model).collect():
            want = plain_sigmoid(
                sum(float(model.weights[s]) for s in plain_slots(r.text, model.sizes, 14)) + model.intercept
            )
            assert r.score == pytest.approx(want, abs=1e-9)
            assert r.predicted == (r.score >= 0.5)


def plain_fit(sets, labels, least, rounds=40, ridge=10.0):
    """Log-count ratios and full-batch steps with adaptive rates, over a dense matrix."""
    n, ones = len(sets), sum(labels)
    seen = Counter(s for own in sets for s in own)
    used = sorted(s for s, c in seen.items() if c >= least)
    rows = np.array([[float(s in own) for s in used] for own in sets])
    truth = np.array(labels, float)
    scale = np.log((rows[truth == 1].sum(0) + 1) / (ones + 2)) - np.log((rows[truth == 0].sum(0) + 1) / (n - ones + 2))
    p = (ones + 1) / (n + 2)
    w, b = np.zeros(len(used)), math.log(p / (1 - p))
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, rounds + 1):
        error = linear.sigmoid(rows @ (w * scale) + b) - truth
        grad = np.append(scale * (rows.T @ error) + ridge * w, error.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return dict(zip(used, w * scale)), b


def test_toxicity_fit_is_its_formula(spark):
    texts = ["bad word here", "a bad thing", "nice word", "a nice thing here", "bad bad", "good", "nice nice", "so bad"]
    truth = [1, 1, 0, 0, 1, 0, 0, 1]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame(list(enumerate(truth)), "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels, bits=12, least=1)
    weights, intercept = plain_fit([plain_slots(t, toxicity.SIZES, 12) for t in texts], truth, 1)
    assert model.intercept == pytest.approx(intercept, abs=1e-6)
    for slot in range(1 << 12):
        assert float(model.weights[slot]) == pytest.approx(weights.get(slot, 0.0), abs=1e-5)
    again = toxicity.fit(docs.repartition(5), labels, bits=12, least=1)
    assert (again.weights == model.weights).all() and again.intercept == model.intercept


def test_quality_is_its_formula(small, make, edges):
    model = quality.fit(small("documents"), small("labels"), max_rows=80)
    kind = zstandard.DICT_TYPE_RAWCONTENT

    def size(content, data):
        own = zstandard.ZstdCompressionDict(content, dict_type=kind)
        own.precompute_compress(level=quality.LEVEL)
        compressor = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=own, write_content_size=False)
        return len(compressor.compress(data))

    assert model.good and model.bad
    for frame in (small("documents").limit(40), make(edges)):
        for r in quality.score(frame, model).collect():
            data = (r.text or "").encode()
            good, bad = size(model.good, data), size(model.bad, data)
            x = (bad - good) / (bad + good) if data else 0.0
            assert r.score == pytest.approx(plain_sigmoid(model.slope * x + model.intercept), abs=1e-12)
            assert r.predicted == (r.score >= 0.5)


def segmentations(word):
    """Every way to cut a word into parts."""
    for cuts in itertools.product([False, True], repeat=len(word) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(word)]
        yield [word[a:b] for a, b in zip(at, at[1:])]


def test_language_is_the_sum_over_all_segmentations(make):
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "é", "éa", "aba"]
    hashes, order = language._piece_index(pieces)
    chance = np.random.default_rng(3).random((len(pieces), 3))
    chance /= chance.sum(axis=0)
    model = language.Model(["x", "y", "z"], hashes, order, chance)
    known = {p.encode(): chance[i] for i, p in enumerate(pieces)}

    def likelihood(word):
        total = np.zeros(3)
        for parts in segmentations("▁".encode() + word.encode()):
            # A single byte may also be none of the pieces.
            ways = [known.get(p, np.zeros(3)) + (language.FLOOR if len(p) == 1 else 0) for p in parts]
            total += np.prod(ways, axis=0)
        return total

    rows = [(1, "ab"), (2, "aba b"), (3, "éab a"), (4, "q ab"), (5, "1 2"), (6, ""), (7, None), (8, "ba\tab ab")]
    for r in language.predict(make(rows), model).collect():
        words = (r.text or "").split()
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        logs = sum(np.log(likelihood(w)) for w in words)
        share = np.exp(logs - logs.max()) / np.exp(logs - logs.max()).sum()
        assert r.lang_pred == "xyz"[int(share.argmax())]
        assert r.score == pytest.approx(share.max(), rel=1e-9)


CLASHING = ["score", "predicted", "n_lines", "n_removed", "hits", "token_ids", "__gone", "__digest", "__text", "block"]


def test_stages_keep_columns_of_any_name(spark, small):
    docs = small("documents")
    wide = docs.select("*", *[F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")).alias(c) for c in CLASHING])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.asDict() for r in wide.collect()}
        after = stage(spark, wide, SMALL)
        assert after.schema == wide.schema, name
        rows = after.collect()
        assert 0 < len(rows) <= len(before)
        changed = {"text", "n_chars"} if name == "line dedup" else set()
        for r in rows:
            assert {k: v for k, v in r.asDict().items() if k not in changed} == {
                k: v for k, v in before[r.doc_id].items() if k not in changed
            }
            assert name != "line dedup" or r.n_chars == len(r.text)
        wide = spark.createDataFrame(rows, wide.schema)


def test_stages_of_odd_rows(spark, small, edges):
    names = ", ".join(f"`{c}` string" for c in CLASHING)
    schema = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {names}"
    rows = [(i, t, None, None, len(t or ""), *["x"] * len(CLASHING)) for i, t in edges]
    odd = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        kept = stage(spark, odd, SMALL)
        assert kept.schema == odd.schema
        found = kept.collect()
        # Rows without a text or an id are no copies of anything.
        assert {1, 2, 3, 4, 6, 9}.issubset({r.doc_id for r in found})
        assert sum(r.doc_id is None for r in found) == 2
        assert all(r[c] == "x" for r in found for c in CLASHING)
    (name, last) = corpus_pipeline.STAGES[-1]
    assert last(spark, odd, SMALL).count() == len(edges), name


def test_empty_tables(spark, small, make):
    none = make([(1, "x")]).where("doc_id > 1")
    pieces = ["▁a"]
    model = language.Model(["x"], *language._piece_index(pieces), np.ones((1, 1)))
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    frames = {
        "op1": ngram_join.similar_documents(none),
        "keep_one": ngram_join.keep_one(none),
        "op2": language.predict(none, model),
        "op4": decontamination.find_benchmark(none, small("benchmark")),
        "op5": bpe.round_trip(none, path, pattern),
        "encode": bpe.encode(none, path, pattern),
        "op6": lines.remove_shared_lines(none),
        "op7": quality.score(none, quality.Model(b"", b"", 0.0, 0.0)),
        "op8": quotations.order_conversations(small("conversations").where("turn < 0")),
        "op9": repeats.remove_repeats(none),
        "op10": toxicity.score(none, toxicity.fit(none, small("labels"))),
        "op11": periods.periodic_runs(none),
        "op13": repair.report(repair.repair(small("conversations").where("turn < 0"))),
    }
    for name, frame in frames.items():
        assert frame.collect() == [], name
    docs = small("documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).collect() == []

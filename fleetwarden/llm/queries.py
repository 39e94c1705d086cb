"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetwarden.llm import (
    bpe,
    decontamination,
    language,
    lines,
    neighbours,
    ngram_join,
    periods,
    quality,
    quotations,
    repair,
    repeats,
    token_files,
    toxicity,
)
from fleetwarden.llm.frames import crc_mod, shared_folder, table
from fleetwarden.llm.sql import OP11_SQL, OP13_SQL

BYTE_BPE = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
TOKENIZER = "byte_bpe_50k.json"


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 4) == 2
    pieces = language.read_pieces(public_tokenizers.path(PIECES))
    model = language.fit(docs.where(~held_out), pieces)
    scored = language.predict(docs.select("doc_id", "text"), model, keep_text=False)
    return scored.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 100 = 0"), neighbours.fit(vectors))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_benchmark(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda n, h: n + h["last"] - h["first"] + 1)
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = lines.remove_shared_lines(docs)
    kept = F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    return found.select("doc_id", "n_lines", "n_removed", kept)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_mod("doc_id", 3) == 1
    model = quality.fit(docs, labels.where(~held_out))
    scored = quality.score(docs.select("doc_id", "text"), model, keep_text=False)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quotations.order_conversations(table(spark, sf_dir, "conversations"))
    own = F.sha2("own_text", 256).alias("own_sha256")
    return found.select("conv_id", "position", "turn", "role", "reply_to", "n_quotes", "n_linked", own)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_mod("doc_id", 5) == 0
    model = toxicity.fit(docs, labels.where(~held_out))
    scored = toxicity.score(docs.select("doc_id", "text"), model, keep_text=False)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periods.periodic_runs(periods.with_planted_runs(docs), keep_text=False)
    best = periods.longest_by_exponent(F.col("runs"))
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    path, pattern = public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN
    token_files.write(table(spark, sf_dir, "documents"), path, pattern, folder)
    return token_files.index(spark, folder)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = repair.damaged(table(spark, sf_dir, "conversations"))
    return repair.report(repair.repair(messages, copies="copies"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_ngram_join,
        op2_language_id,
        op3_nearest_neighbours,
        op4_decontamination,
        op5_byte_bpe,
        op6_line_dedup,
        op7_quality,
        op8_chat_formatting,
        op9_suffix_dedup,
        op10_toxicity,
        op11_periodic_runs,
        op12_token_files,
        op13_conversation_repair,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_decontamination": OP4_SQL,
        "op11_periodic_runs": OP11_SQL,
        "op13_conversation_repair": OP13_SQL,
    }


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), windows AS (
  SELECT DISTINCT item, least(10, len(w)) AS size,
    array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS s
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), places AS (
  SELECT doc_id, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS s
  FROM (
    SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
    FROM d, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)
), hits AS (SELECT doc_id, i, size, item FROM places JOIN windows USING (size, s)),
words AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(DISTINCT item) AS n_items,
    array_to_string(list_sort(list(DISTINCT item)), ',') AS ids FROM hits GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

"""A corpus made ready for training, in stages that each apply one operator of fleetwarden.llm.

Every stage reads what the one before it wrote. The first four return the columns of documents;
the last one returns the encoded documents.

Defined results of the first four: all columns come back as they are, whatever their names, but
for the text that line dedup cuts (and ``n_chars`` after it). A null, empty or blank text is
neither toxic by its words, nor like another, nor contaminated, and stays if the classifier's
intercept lets it. Texts of any length are read whole. Rows without an id stay unless they are
toxic or contaminated, and so do rows that repeat an id with another text; of rows with one id
and text the join keeps one. Ties go to the smallest doc_id. An empty table stays empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fleetwarden.llm import bpe, decontamination, lines, ngram_join, toxicity
from fleetwarden.llm.frames import aside, shared_folder, table
from fleetwarden.llm.queries import BYTE_BPE


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on all labelled documents, doesn't call toxic.

    A score of a half is toxic. Without labels, or with labels of one kind, all documents have
    one score, the smoothed share of toxic labels (a half, so toxic, without any label).
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rows, back = aside(docs, "text")
    return back(toxicity.score(rows, model).where("predicted = 0"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that they share with an earlier one; those of which
    nothing is left go."""
    rows, back = aside(docs, "doc_id", "text", "n_chars")
    return back(lines.without_shared_lines(rows))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group that n-gram similarity links."""
    rows, back = aside(docs, "doc_id", "text")
    return back(ngram_join.keep_one(rows))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source with the number of tokens and digests of ids and decoded bytes.

    A null text counts as empty.
    """
    docs = docs.select("doc_id", "text", "lang", "source")
    return bpe.round_trip(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", clean_of_toxicity),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("byte-level BPE", encoded),
]

#: The stages learn a classifier and align texts, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.schema(docs.schema).parquet(f"{folder}/{k}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}

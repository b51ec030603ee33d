"""A training corpus from ``documents``: quality, language, near-duplicates, source mixture, packed sequences.

Every stage takes what its predecessor kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import language_id, quality
from millrace.llm.common import fresh, held_out, prepare
from millrace.llm.minhash_dedup import near_duplicates
from millrace.llm.packing import pack, tokenize
from millrace.llm.queries import END_TOKEN, GOOD_SCORE, SEQUENCE_TOKENS, mix_documents
from millrace.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# The near-duplicate stage compares sets of five words; languages below this share are ambiguous.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
LEAST_LANGUAGE_SHARE = 0.5

ORACLE_SQL = None


def _columns(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that their nearest labelled neighbours call good; all of them where there are no labels."""
    labels = prepare(spark).read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id")))
    model = quality.train(docs, labels, "doc_id", "text", "quality")
    if not len(model.labels):
        return docs
    return docs.where(quality.quality_score(docs, F.col("text"), model) >= GOOD_SCORE)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; all of them where no document names its language."""
    prepare(spark)
    model = language_id.train(docs.where(~held_out(F.col("doc_id"))), "text", "lang", ["doc_id"])
    if not model.languages:
        return docs
    found = language_id.language_of(docs, F.col("text"), model)
    sure = (found["lang_pred"] != language_id.UNDETERMINED) & (found["score"] >= LEAST_LANGUAGE_SHARE)
    return docs.where(sure)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: one with the smallest id; rows without an id stay.

    Ids may repeat, so rows are told apart by a number that is written with them.
    """
    prepare(spark)
    row = fresh(docs, "__row")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
    found = near_duplicates(numbered, "doc_id", "text", SHINGLE_WORDS, SIMILAR_PERCENT, tag=row)
    gone = found.where(~F.col("kept")).select(row)
    return numbered.join(gone, row, "left_anti").select(_columns(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the target weights of their sources, each at most once."""
    prepare(spark)
    return mix_documents(docs, max_epochs=1).select(_columns(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of ``SEQUENCE_TOKENS``."""
    prepare(spark)
    pieces = tokenize(docs, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"), END_TOKEN, SEQUENCE_TOKENS)
    return pack(pieces, SEQUENCE_TOKENS, ["doc_id", "piece"])


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_quality),
    ("language", known_language),
    ("near_duplicates", without_near_duplicates),
    ("mixture", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared scratch folder and read again."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs

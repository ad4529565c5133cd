"""A corpus pipeline: language ID, n-gram Jaccard join, substring dedup, secret scans and best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns documents (doc_id, text, lang, source, n_chars) for the next one, the
last one the packed pieces. A stage's result is written as Parquet in the shared folder and read again. The tables that
a stage writes for itself belong to its result: they go once no data frame reads them any more (`scratch.sweep`).
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storymetrics.llm import common, langid, ngram_join, packing, secrets, substring

MORE = ("lang", "source")


def documents(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (null and empty texts too) or of unclear language go; a document at the bar stays."""
    return langid.accepted(docs).select("doc_id", "text", "lang", "source", "n_chars")


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8 and above) the document with the smallest doc_id stays.

    Documents without words and rows without doc_id stay; rows with the doc_id that stays all stay.
    """
    return ngram_join.representatives(docs, 5, 80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in 50-word windows that stand in an earlier document go; texts that lose nothing stay as they are (null: empty)."""
    return documents(substring.dedup(docs, more=MORE, rejoin=False).withColumnRenamed("kept", "text"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; no document goes (null texts become empty)."""
    return documents(secrets.redact(docs, MORE))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces, an empty one's too, and their places in the sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("substring_dedup", substring_dedup),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]
#: SQL can't express the language model and the packing; tests/llm holds each stage, and run(), against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        before, docs = docs, common.saved(function(spark, docs, sf_dir), name)
        common.dropped(before)  # only what was written here
    return STAGES[-1][1](spark, docs, sf_dir)

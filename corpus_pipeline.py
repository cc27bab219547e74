"""A training-data pipeline over documents: each stage reads what the one before it wrote.

language: keeps documents whose text is in a language that the labelled rows teach.
near_dedup: sets of five-word shingles with a Jaccard similarity of 0.8 or more are near copies; SimHash
    fingerprints in vantage-point trees find the pairs to compare, the sets decide; of each group of near
    copies the smallest id stays.
repeats: byte strings of 100 that occur earlier in the corpus are cut out of the texts.
decontaminate: documents that hold an item of the benchmark go.
encode: ids of every text, with digests of the ids and of the bytes decoded from them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from keelson.llm import bpe, decontam, langid, simhash, suffix
from keelson.llm.common import materialize, table

KNOWN = 250_000  # words that a worker keeps the codes of; workers hold what earlier stages left beside them
WIDTH, LIKENESS = 5, 0.8  # words of a shingle; Jaccard similarity of near copies


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs, langid.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.first_of_groups(docs, WIDTH, LIKENESS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix.removed_from(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True, known=KNOWN)


STAGES = [("language", language), ("near_dedup", near_dedup), ("repeats", repeats), ("decontaminate", decontaminate), ("encode", encode)]

#: Naive Bayes, vantage-point trees and BPE have no form in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

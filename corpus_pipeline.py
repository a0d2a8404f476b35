"""A training corpus from raw documents: known languages, one document of a group, no secrets, mixed sources, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spectrafold.llm import bpe, language, mixing, near, secret_scan, simhash
from spectrafold.llm.common import Scratch, crc_fold, read

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose likeliest language has a posterior below a half, go."""
    model = language.fit(docs.where(crc_fold() != 2).select("text", "lang"))
    return language.with_known_language(docs, model)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of SimHash fingerprints (two bits) reach, the one with the smallest id stays; of those left
    that links of five-word Jaccard similarity 0.8 or more reach, too."""
    return near.representatives(Scratch(spark).save(simhash.representatives(docs)))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; spans that look secret are masked."""
    return secret_scan.mask_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: rows repeat, a last copy may be a part."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with digests of the ids and of what they decode to."""
    return bpe.encode_documents(docs, TOKENIZER, keep=("doc_id", "source"), with_ids=True)


STAGES = [
    ("language_id", keep_known_languages), ("near_duplicates", keep_one_of_each_group), ("secret_scan", mask_secrets),
    ("mix_sources", mix_sources), ("bpe_round_trip", encode),
]

#: Naive Bayes, XXH64 shingle sets and byte-pair encoding are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, on documents; what a stage returns is written and read by the next."""
    scratch = Scratch(spark)
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs)
    return docs

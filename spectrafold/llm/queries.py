"""The numbered queries over whole tables, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spectrafold.llm import bpe, decontaminate, extraction, language, merkle, mixing, negatives, quality, secret_scan, simhash, sketches, substrings, vectors
from spectrafold.llm.common import Scratch, crc_fold, held_out, read

TOKENIZERS = "/opt/tokenizers"


def op1_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.without_repeats(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language.fit(docs.where(crc_fold() != 2).select("text", "lang"))
    return language.predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op4_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(crc_fold() != 2))
    return quality.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op5_document_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.compare_with_edits(read(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    sized = Scratch(spark).save(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")))
    return mixing.mix_sources(sized, F.col("size")).select("doc_id", "size", "source_size", "target", "taken")


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str, tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    return bpe.encode_documents(read(spark, sf_dir, "documents"), tokenizer)


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(read(spark, sf_dir, "pages"))


def op9_embedding_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(read(spark, sf_dir, "embeddings"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.col("base_spans")
    return found.select(
        "doc_id", *[secret_scan.count_kind(base, kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(secret_scan.joined(base), 256).alias("base_sha256"), secret_scan.joined(F.col("secret_spans")).alias("spans"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    head = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    seen = F.when(tampered, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = merkle.manifest(
        docs, "source", "doc_id", merkle.leaf_digest(*head, F.col("text")), {"doc_id": F.col("doc_id"), "seen": merkle.leaf_digest(*head, seen)})
    return merkle.verify(found, "seen").select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op13_benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.occurrences(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return found.select(
        "doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"))


QUERIES = {f.__name__: f for f in (
    op1_simhash_groups, op2_repeated_strings, op3_language_id, op4_quality_score, op5_document_sketch, op6_mix_sources,
    op7_bpe_round_trip, op8_main_text, op9_embedding_groups, op10_secret_scan, op11_merkle_manifest, op12_hard_negatives,
    op13_benchmark_hits)}
ORACLES = {
    "op6_mix_sources": mixing.MIX_SQL, "op11_merkle_manifest": merkle.MANIFEST_SQL, "op12_hard_negatives": negatives.NEGATIVES_SQL,
    "op13_benchmark_hits": decontaminate.OCCURRENCES_SQL}

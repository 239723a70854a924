"""The queries op1 to op10 and pipeline, with their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadspan.llm import bpe, extraction, licences, lines, packing, quality, simhash, tokenfile, toxicity, vectors
from loadspan.llm.tables import new_path, parquet


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.grouped(parquet(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op2_minhash_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.deduplicated(parquet(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(quality.with_statistics(parquet(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    stats = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return found.select("doc_id", *stats, "base_failed", "kept", "p_good")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parquet(spark, sf_dir, "documents")
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.decode(bpe.encode(docs, ranks, pattern), ranks)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op5_repair_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    tokenfile.write_token_file(parquet(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return tokenfile.documents(spark, path)


def op6_tree_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extraction.extracted(parquet(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parquet(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, parquet(spark, sf_dir, "labels"))
    found = toxicity.scored(docs, model)
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "toxic_spans")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(parquet(spark, sf_dir, "documents"))
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", "notices.label")))
    score = F.greatest(F.coalesce(F.array_max("notices.score"), F.lit(0.0)), F.when(F.size("base_labels") > 0, 0.5).otherwise(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base_starts").cast("long").alias("n_base"),
        F.array_min("base_starts").alias("first_word"),
        F.array_max("base_starts").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.least(score, F.lit(1.0)).alias("score"),
    )


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.packed(parquet(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_spherical_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.linked(parquet(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_minhash_lines, op3_weak_supervision, op4_byte_bpe, op5_repair_files, op6_tree_model, op7_crf_toxicity, op8_license_scan, op9_best_fit, op10_spherical_kmeans)}
ORACLE: dict[str, str] = {}

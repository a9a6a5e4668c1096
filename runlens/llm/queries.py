"""The queries of the corpus operators, one per operator, over the given tables."""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, chat, decontam, forest, langid, license_scan, neardup, negatives, pii, quality_model, quality_rules, warc
from .common import id_remainder, read_table, saved
from .oracle import oracle_sql  # noqa: F401  the entry takes queries and SQL from here

#: Places of the tokenizer files; parameters of the queries' builders.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Remainders of crc32 of the id that are held out: (divisor, remainder).
LANG_FOLD, QUALITY_FOLD = (4, 2), (5, 0)
THRESHOLD = 0.3


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.leaks(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(read_table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = quality_rules.judge(read_table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("host_rate", 9).alias("host_rate"))


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    divisor, out = LANG_FOLD
    model = langid.train(docs.where(id_remainder(F.col("doc_id"), divisor) != out))
    return langid.predict(docs, model).select(F.col("id").alias("doc_id"), (id_remainder(F.col("id"), divisor) == out).alias("held_out"), "lang_pred", "score")


def op5_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = read_table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return chat.read_back(chat.format_chats(turns.unionByName(extra)))


def op6_simhash_neardup(spark: SparkSession, folder: str) -> DataFrame:
    found = neardup.near_duplicates(read_table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = read_table(spark, folder, "pages")
    archives, index = warc.archive_and_index(spark, pages)
    return warc.read_pages(pages, index, archives)


def op8_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.scan(read_table(spark, folder, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(F.col("id").alias("doc_id"), *(count(kind).alias(f"n_{kind}") for kind, _, _ in pii.KINDS), F.sha2("base", 256).alias("base_sha256"), F.col("joined").alias("spans"))


def op9_bpe(spark: SparkSession, folder: str, tokenizer: str = TOKENIZER) -> DataFrame:
    found = bpe.tokens(read_table(spark, folder, "documents"), tokenizer)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def learned(labels: DataFrame) -> DataFrame:
    """The labels that aren't held out."""
    divisor, out = QUALITY_FOLD
    return labels.where(id_remainder(F.col("doc_id"), divisor) != out)


def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    stats = saved(quality_model.document_statistics(read_table(spark, folder, "documents")), "statistics")
    scored = quality_model.score_statistics(stats, quality_model.train(stats, learned(read_table(spark, folder, "labels"))))
    divisor, out = QUALITY_FOLD
    return scored.select(F.col("id").alias("doc_id"), (id_remainder(F.col("id"), divisor) == out).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op11_alignment(spark: SparkSession, folder: str, bytes_file: str = BYTES, piece_model: str = PIECES) -> DataFrame:
    return alignment.align(read_table(spark, folder, "documents"), bytes_file, piece_model)


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read_table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors.withColumn("label", moved))


def op13_minhash_neardup(spark: SparkSession, folder: str) -> DataFrame:
    return forest.near_duplicates(read_table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return _pipeline().run(spark, folder)


def _pipeline():
    root = str(Path(__file__).resolve().parents[2])
    if root not in sys.path:
        sys.path.insert(0, root)
    import corpus_pipeline

    return corpus_pipeline


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_decontamination, op2_license_scan, op3_quality_rules, op4_language_id, op5_chat_format, op6_simhash_neardup, op7_warc, op8_pii, op9_bpe, op10_quality_classifier, op11_alignment, op12_hard_negatives, op13_minhash_neardup]
    return {f.__name__: f for f in own} | {"pipeline": pipeline}

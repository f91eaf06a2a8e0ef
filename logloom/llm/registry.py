"""Registered queries of this folder (``opN_<name>``) and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import chat_format, license_scan, mixing, near_dedup, paragraph_sketch, quality_classifier, quality_rules, sentencepieces, source_divergence, token_alignment, token_files, toxicity, warc_archive
from logloom.llm.shared import TEST_FOLD, fold, ship, stored

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out() -> Column:
    return F.coalesce(fold() == TEST_FOLD, F.lit(False)).alias("held_out")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return chat_format.read_conversations(chat_format.format_conversations(rows.unionByName(extra)))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    rows = mixing.measured(docs)
    rows = stored(spark, rows.withColumn("row", F.struct("row.doc_id", "row.source", "row.lang")), "mixing_rows")
    found = mixing.drawn(rows, mixing.cell_probabilities(spark, rows))
    return found.select("row.doc_id", "row.source", "row.lang", F.expr("substr(c_topic, 2)").alias("topic"), "n_tokens", "weight", "probability", "kept")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(spark, table(spark, sf_dir, "documents"), shingle_words=3, percent=85)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = token_files.store_documents(spark, docs, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_documents(spark, path)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_documents(docs, toxicity.train(spark, docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "log_ratio_per_word")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    measured = quality_rules.measure(docs).withColumn("row", F.struct("row.doc_id"))
    measured = stored(spark, measured, "quality_stats")  # numbers only: read for the sketches and for the verdicts
    judged = quality_rules.verdicts(measured, quality_rules.limits_of(spark, measured))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("row.doc_id", *[F.col(f"base.{c}").cast("long").alias(c) for c in names], "base_failed", "kept", "failed_rule")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: ids, code points, a digest of the ids and whether decoding them gives the text."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    encoded = sentencepieces.encode_documents(docs, model, carry=["doc_id", "text"])
    decoded = sentencepieces.decode_documents(encoded, model, carry=["doc_id", "text", "ids"], text="decoded")
    same = F.col("decoded") == F.translate("text", sentencepieces.SPACE, " ")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.length("decoded").cast("long").alias("decoded_chars"), F.xxhash64("ids").alias("ids_hash"), same.alias("restored"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_documents(table(spark, sf_dir, "documents"))


def op9_paragraph_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_sketch.fingerprints(spark, table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    scored = quality_classifier.score_documents(docs, trees)
    predicted = (F.col("score") >= quality_classifier.PREDICT_FROM).cast("int").alias("predicted")
    return scored.select("doc_id", held_out(), "score", predicted)


def op11_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    archive = warc_archive.write_archive(spark, pages)
    found = warc_archive.read_captures(warc_archive.lookup(spark, archive, pages.select("url").distinct()))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(spark, table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return token_alignment.align_documents(spark, docs, *files)


def queries() -> dict[str, Query]:
    return {
        "op1_chat_format": op1_chat_format,
        "op2_mixing": op2_mixing,
        "op3_near_dedup": op3_near_dedup,
        "op4_token_files": op4_token_files,
        "op5_toxicity": op5_toxicity,
        "op6_quality_rules": op6_quality_rules,
        "op7_sentencepiece": op7_sentencepiece,
        "op8_license_scan": op8_license_scan,
        "op9_paragraph_sketch": op9_paragraph_sketch,
        "op10_quality_classifier": op10_quality_classifier,
        "op11_warc_archive": op11_warc_archive,
        "op12_source_divergence": op12_source_divergence,
        "op13_token_alignment": op13_token_alignment,
    }

"""One query per operator, over the whole of its table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    byte_bpe,
    decontaminate,
    fertility,
    html_extract,
    jaccard_join,
    line_crf,
    line_dedup,
    log_bilinear,
    merkle,
    spelling,
    sql,
    substring_dedup,
    suffix_dedup,
    warc,
)
from tidemark.llm.registry import query, table


@query("op1_ngram_jaccard_join", sql.OP1)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op4_byte_bpe")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    tokens = byte_bpe.encode(table(spark, sf_dir, "documents", "doc_id", "text"), path, pattern)
    return byte_bpe.decode(tokens, path, pattern).select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op3_html_extract")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html_extract.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return text.withColumn("n_chars", F.char_length("text").cast("long"))


@query("op5_line_crf")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    known = table(spark, sf_dir, "labels", "doc_id", "quality").where(line_crf.remainder("doc_id", 4) != 2)
    model = line_crf.fit(docs, known.withColumnRenamed("quality", "label"))
    return line_crf.score(docs, model).select(
        "doc_id", (line_crf.remainder("doc_id", 4) == 2).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op6_line_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"), equal_short=True)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op10_decontaminate", sql.OP10)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return decontaminate.find_items(docs, table(spark, sf_dir, "benchmark", "item_id", "text")).drop("row_key")


@query("op2_token_fertility")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabularies = (
        fertility.Vocabulary("bytes", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
        fertility.Vocabulary("pieces", public_tokenizers.path("piece_bpe_32k.model")),
    )
    return fertility.judge(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), vocabularies).drop(
        "group", "length_class")


@query("op8_warc_normalise", sql.OP8)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages", "page_id", "url", "html"), min_bytes=0).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op7_log_bilinear")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = log_bilinear.score(table(spark, sf_dir, "documents", "doc_id", "text"), line_crf.remainder("doc_id", 10) != 0)
    return scores.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score")


@query("op9_suffix_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return rest.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


@query("op11_substring_dedup", sql.OP11)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = substring_dedup.remove_windows(table(spark, sf_dir, "documents", "doc_id", "text"))
    return rest.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


@query("op12_merkle_manifest", sql.OP12)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = table(spark, sf_dir, "documents", *fields)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    text = F.when(tampered, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return merkle.audited(docs, fields, "source", "doc_id", {"text": text}).select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_hash(F.col("proof")).alias("proof_sha256"), "folded_root",
        "verified")


@query("op13_spelling_variants", sql.OP13)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents", "doc_id", "text"), every=199)

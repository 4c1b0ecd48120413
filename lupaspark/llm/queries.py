"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lupaspark.llm import bpe, decontam, infill, lattice, linededup, neardup, oracles, resampling, simhash, suffixes, tokencounts, toxicity, urlfilter, warc
from lupaspark.session import table

#: The vocabularies of the queries; the operators take any path.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.scored(table(spark, sf_dir, "documents"), lattice.read_scores(PIECES))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_columns(docs: DataFrame) -> DataFrame:
    """For each document the lines left, those taken out, and a digest of the text that stays; a null text has no lines and no digest."""
    out = linededup.deduplicated(docs)
    removed = F.coalesce("removed_lines", F.array().cast("array<int>"))
    lines = F.when(F.col("text").isNotNull(), F.size(F.split("text", "\n")))
    return out.select("doc_id", lines.alias("lines_left"), F.size(removed).alias("n_removed"), removed.alias("removed_lines"), F.sha2("text", 256).alias("text_sha256"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_columns(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.attributed(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")), with_data=False)
    return chunks.where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(urlfilter.RULES, "host string, path string, verdict string")
    return urlfilter.judge(pages, rules, urlfilter.listed_urls(pages, urlfilter.UNWANTED))


def op11_columns(docs: DataFrame) -> DataFrame:
    """Digests of the output, and of the text rebuilt from output and form."""
    rebuilt = infill.restored(F.col("form"), F.col("output"))
    return infill.transformed(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(rebuilt, 256).alias("restored_sha256"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_columns(table(spark, sf_dir, "documents"))


def op12_columns(docs: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return suffixes.deduplicated(docs).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_columns(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.drawn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_embedding_neardup, op2_lm_scoring, op3_simhash, op4_decontamination, op5_toxicity, op6_line_dedup, op7_token_counts, op8_bpe, op9_warc, op10_url_filter, op11_fim, op12_suffix_dedup, op13_importance_resampling)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)

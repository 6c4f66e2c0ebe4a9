"""The numbered queries and their SQL; each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, decontaminate, fingerprint, lines, lm, mixing, near, quality, quotes, repair, repeats, tokens, toxicity
from .common import read_table


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_file(read_table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(read_table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read_table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_likeness(read_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read_table(spark, sf_dir, "documents")).drop("kept")


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(read_table(spark, sf_dir, "documents"))


def op10_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_conversations(read_table(spark, sf_dir, "conversations"))


def op11_dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(read_table(spark, sf_dir, "embeddings"))


def op13_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_conversations(repair.damage(read_table(spark, sf_dir, "conversations")), copies_col="copies")


QUERIES = {f.__name__: f for f in (op1_token_file, op2_near_duplicates, op3_mix_sources, op4_decontaminate, op5_quality, op6_fingerprints, op7_toxicity, op8_remove_repeats, op9_lm_scores, op10_quotation_links, op11_dedup_lines, op12_vector_codes, op13_repair_conversations)}
SQL = {"op3_mix_sources": mixing.OP3_SQL, "op4_decontaminate": decontaminate.OP4_SQL, "op8_remove_repeats": repeats.OP8_SQL, "op11_dedup_lines": lines.OP11_SQL, "op12_vector_codes": codes.OP12_SQL, "op13_repair_conversations": repair.OP13_SQL}

"""The subpackage's queries, one for each operator, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import ann, audit, bpe, decontaminate, language_id, negatives, packing, quality, sharding, simhash, substring, token_output, url_filter
from .common import table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op3_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op4_pack_config_lp(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    out = simhash.components_within(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex64(F.col("fp")).alias("fingerprint"), "component_id")


def op6_decontaminate_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.withColumn("contaminated", F.lit(True)).drop("dg")


def op7_shard_vector_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op8_substring_rlz(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return substring.digest(table(spark, sf_dir, "documents"))


def op9_ann_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return ann.search(table(spark, sf_dir, "embeddings"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed sequences with checksums of their rows of the two matrices."""
    ship(spark)
    out = token_output.pack_sequences(table(spark, sf_dir, "documents"))
    return out.select("sequence_id", "doc_ids", "pieces", "starts", "cu_seqlens", "n_tokens", F.crc32("ids").alias("ids_crc32"), F.crc32("positions").alias("positions_crc32"))


def op11_bpe_speculate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return bpe.digest(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return negatives.mine(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_language_id": op2_language_id,
    "op3_quality_crf": op3_quality_crf,
    "op4_pack_config_lp": op4_pack_config_lp,
    "op5_simhash_golay": op5_simhash_golay,
    "op6_decontaminate_templates": op6_decontaminate_templates,
    "op7_shard_vector_bin": op7_shard_vector_bin,
    "op8_substring_rlz": op8_substring_rlz,
    "op9_ann_collision": op9_ann_collision,
    "op10_token_output": op10_token_output,
    "op11_bpe_speculate": op11_bpe_speculate,
    "op12_filter_audit": op12_filter_audit,
    "op13_hard_negatives": op13_hard_negatives,
}

SQL = {
    "op1_url_filter": url_filter.filter_sql(),
    "op6_decontaminate_templates": decontaminate.LEAK_SQL,
    "op8_substring_rlz": substring.DIGEST_SQL,
    "op12_filter_audit": audit.AUDIT_SQL,
    "op13_hard_negatives": negatives.MINE_SQL,
}

"""The queries ``opN_*``: each operator with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from medialake.llm import adaptive_scan, bloom_cascade, contextual_pii, crf_language, filter_audit, html_text, katz, minhash_join, packing, parity_join, prefix_trie, toxic_neighbours, wu_manber
from medialake.llm.common import table


def op1_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_report(table(spark, sf_dir, "documents"))


def op2_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wu_manber.decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_tree_scoring_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extraction_report(table(spark, sf_dir, "pages"))


def op4_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf_language.language_report(table(spark, sf_dir, "documents"))


def op5_nearest_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_neighbours.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_bloom_cascade_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_cascade.judge(table(spark, sf_dir, "pages"), bloom_cascade.CONTRACT_RULES, keep=["page_id"])


def op7_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.language_model_report(table(spark, sf_dir, "documents"))


def op8_adaptive_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptive_scan.neighbours_report(table(spark, sf_dir, "embeddings"))


def op9_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.jaccard_report(table(spark, sf_dir, "documents"))


def op10_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contextual_pii.personal_data_report(table(spark, sf_dir, "documents"))


def op11_permutation_trie_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interaction_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_pointer_jumping_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie_report(table(spark, sf_dir, "conversations"))


def op13_minhash_coordinate_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.dedup_report(table(spark, sf_dir, "documents"))


_ALL = (
    op1_sum_of_squares_packing, op2_wu_manber_decontamination, op3_tree_scoring_extraction, op4_crf_language, op5_nearest_toxicity,
    op6_bloom_cascade_url_filter, op7_katz_backoff, op8_adaptive_dimension_scan, op9_parity_sketch_join, op10_contextual_pii,
    op11_permutation_trie_audit, op12_pointer_jumping_trie, op13_minhash_coordinate_join,
)
QUERIES = {f.__name__: f for f in _ALL}

ORACLE = {
    "op2_wu_manber_decontamination": wu_manber.ORACLE_SQL,
    "op6_bloom_cascade_url_filter": bloom_cascade.ORACLE_SQL,
    "op9_parity_sketch_join": parity_join.ORACLE_SQL,
    "op11_permutation_trie_audit": filter_audit.ORACLE_SQL,
    "op12_pointer_jumping_trie": prefix_trie.ORACLE_SQL,
    "op13_minhash_coordinate_join": minhash_join.ORACLE_SQL,
}

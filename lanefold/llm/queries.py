"""The registered queries of this subpackage, with SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lanefold.llm import bpe, chat, collisions, drift, langid, mixing, packing, rules, simhash, spelling, substrings, toxicity, urls
from lanefold.llm.common import table

VOCABULARY = "word_bpe_49k.json"


def op1_link_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filtered(table(spark, sf_dir, "pages"))


def op2_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotated(table(spark, sf_dir, "conversations"))


def op3_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.shortened(table(spark, sf_dir, "documents"))


def op4_nearest_toxic_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op6_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.grouped(table(spark, sf_dir, "documents"))


def op7_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"))


def op8_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.nearest_vectors(table(spark, sf_dir, "embeddings"))


def op9_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_bpe_tree_concatenation(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), path), path)


def op11_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op12_trie_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_drift_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.clustered(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_link_propagation, op2_perspective_rotation, op3_chunk_dedup, op4_nearest_toxic_examples, op5_best_fit_packing, op6_simhash_anchors, op7_rule_ledger, op8_collision_counting, op9_ppm_language, op10_bpe_tree_concatenation, op11_pivotal_mixing, op12_trie_pairs, op13_drift_clusters)}
SQL = {"op1_link_propagation": urls.FILTERED_SQL, "op2_perspective_rotation": chat.ROTATED_SQL, "op7_rule_ledger": rules.JUDGE_SQL, "op12_trie_pairs": spelling.VARIANTS_SQL, "op13_drift_clusters": drift.CLUSTERED_SQL}

"""Registered queries of the corpus operators: each runs over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, collocations, decontaminate, exact_dup, fill_middle, hmm_lm, licenses, near_dup, packing, quality, sharding, token_counts, url_filter
from .common import load
from .pieces import tokenizer_path


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dup.remove_repeats(load(spark, sf_dir, "documents"), window=400).drop("kept_bytes")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(load(spark, sf_dir, "documents"), width=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), folds=5, threshold=0.3)


def op5_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.score_texts(load(spark, sf_dir, "documents"), folds=10)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path(packing.DEFAULT_TOKENIZER)
    return packing.pack_documents(load(spark, sf_dir, "documents"), path, capacity=2048, end_id=0)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(load(spark, sf_dir, "documents"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(load(spark, sf_dir, "embeddings"), k=20, query_modulus=20)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path(token_counts.DEFAULT_TOKENIZER)
    return token_counts.count_tokens(load(spark, sf_dir, "documents"), path, limit=512)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(load(spark, sf_dir, "documents"), shards=40)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_phrases(load(spark, sf_dir, "documents"), most=2000, least=30)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.fill_in_middle(load(spark, sf_dir, "documents"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(load(spark, sf_dir, "pages"), url_filter.production_rules(spark))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_quality": op4_quality,
    "op5_hmm_scores": op5_hmm_scores,
    "op6_packing": op6_packing,
    "op7_license_scan": op7_license_scan,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_token_counts": op9_token_counts,
    "op10_sharding": op10_sharding,
    "op11_collocations": op11_collocations,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_url_filter": op13_url_filter,
}

ORACLE_SQL: dict[str, str] = {
    "op7_license_scan": licenses.oracle(),
    "op11_collocations": collocations.oracle(),
    "op12_fill_in_middle": fill_middle.oracle(),
    "op13_url_filter": url_filter.oracle(),
}

"""The registered queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, jaccard, language, licenses, manifest, mixing, neighbours, packing, resampling, scoring, search, secrets, urls
from .common import prepare, scratch, table


def op1_block_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.top_k(table(prepare(spark), folder, "embeddings"))


def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_digest(table(prepare(spark), folder, "documents"))


def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(prepare(spark), folder, "documents")
    return packing.pack(docs, packing.clusters(docs))


def op4_secret_ledger(spark: SparkSession, folder: str) -> DataFrame:
    ledger = secrets.open_ledger(prepare(spark), scratch(spark, "ledger"))
    return secrets.secret_digest(table(spark, folder, "documents"), ledger)


def op5_flat_graph_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.near_duplicates(table(prepare(spark), folder, "embeddings"))


def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.language_digest(table(prepare(spark), folder, "documents"))


def op7_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge_urls(table(prepare(spark), folder, "pages"))


def op8_shingle_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join_similar(table(prepare(spark), folder, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_chat_repair(spark: SparkSession, folder: str) -> DataFrame:
    return chat.format_chats(table(prepare(spark), folder, "conversations"))


def op10_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_digest(table(prepare(spark), folder, "documents"))


def op11_target_resample(spark: SparkSession, folder: str) -> DataFrame:
    prepare(spark)
    return resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_backoff_scores(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.score_digest(table(prepare(spark), folder, "documents"))


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.manifest_digest(table(prepare(spark), folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_block_search, op2_license_scan, op3_best_fit_packing, op4_secret_ledger, op5_flat_graph_dedup, op6_language, op7_url_rules,
        op8_shingle_join, op9_chat_repair, op10_source_mix, op11_target_resample, op12_backoff_scores, op13_merkle_manifest,
    )
}

SQL: dict[str, str] = {
    "op1_block_search": search.SQL, "op7_url_rules": urls.SQL, "op8_shingle_join": jaccard.SQL, "op10_source_mix": mixing.SQL,
    "op11_target_resample": resampling.SQL, "op12_backoff_scores": scoring.SQL, "op13_merkle_manifest": manifest.SQL,
}

"""Queries of the training-data operators and, where SQL can express them, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, classifier, fim, html, media, neardup, oracle, packing, quality, repair, secrets, substring, toxicity
from .shared import public_vocabulary, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(spark, sf_dir, public_vocabulary("word_bpe_49k.json"))


def op2_html_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_texts(table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_vocabulary("byte_bpe_50k.json"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op6_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.aligned(spark, sf_dir)


def op7_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"))


def op8_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(table(spark, sf_dir, "documents"))


def op10_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(table(spark, sf_dir, "conversations"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digests(table(spark, sf_dir, "conversations"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of operator 7's policy rejects, alone and beside others, by bitwise aggregation of the ledger."""
    return quality.ablation(quality.ledger(table(spark, sf_dir, "documents")), "v1")


def queries() -> dict[str, Query]:
    return {
        "op1_bpe": op1_bpe,
        "op2_html_consensus": op2_html_consensus,
        "op3_toxicity": op3_toxicity,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_secret_scan": op5_secret_scan,
        "op6_chroma_fingerprints": op6_chroma_fingerprints,
        "op7_quality_ledger": op7_quality_ledger,
        "op8_minhash_neardup": op8_minhash_neardup,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_chat_windows": op10_chat_windows,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_quality_classifier": op13_quality_classifier,
        "quality_ablation": quality_ablation,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_quality_ledger": oracle.VERDICTS,
        "op8_minhash_neardup": oracle.NEAR_COPIES,
        "op9_substring_dedup": oracle.REPEATS,
        "op10_chat_windows": oracle.chat(chat.BUDGET, chat.HISTORY),
        "op11_fill_in_middle": oracle.FIM,
        "op12_conversation_repair": oracle.REPAIRS,
        "quality_ablation": oracle.ABLATION,
    }

"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm import consensus, conversations, encode, group_split, mixing, near_duplicates, pairs, spans, split_overlap, sql
from tracelode.session import materialise

TEXTS = ["task_input", "expected_behavior"]
SIMILAR = 0.65
SPAN = 300


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.broken_pairs(_table(spark, sf_dir, "eval_example"), "example_id").select(F.col("id").alias("example_id"), "defect")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.consensus(_table(spark, sf_dir, "judge_audit_log"))


def p2_judges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.judge_reliability(_table(spark, sf_dir, "judge_audit_log"))


def p2_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = consensus.agreement(_table(spark, sf_dir, "judge_audit_log"))
    return found.select("tasks", "ratings", *(F.round(c, 9).alias(c) for c in ("observed", "expected", "alpha")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = split_overlap.split_overlaps(_table(spark, sf_dir, "eval_example"), "example_id", TEXTS, SIMILAR)
    return hits.select(F.least("eval_id", "train_id").alias("example_id_a"), F.greatest("eval_id", "train_id").alias("example_id_b"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_overlap.overlap_report(_table(spark, sf_dir, "eval_example"), "example_id", TEXTS, SIMILAR)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates.near_duplicate_pairs(_table(spark, sf_dir, "eval_example"), "example_id", TEXTS, SIMILAR)
    return found.select(F.col("id_a").alias("example_id_a"), F.col("id_b").alias("example_id_b"))


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_duplicates.near_duplicate_classes(_table(spark, sf_dir, "eval_example"), "example_id", TEXTS, SIMILAR)
    return classes.select(F.col("id").alias("example_id"), "class_id", "n_links")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_split.linked_groups(_table(spark, sf_dir, "eval_example"), "example_id").select(F.col("id").alias("example_id"), "group_id")


def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits = group_split.assign_splits(_table(spark, sf_dir, "eval_example"), "example_id", {"train": 0.8, "validation": 0.1, "test": 0.1})
    return splits.select(F.col("id").alias("example_id"), "group_id", "split")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.left_out(_table(spark, sf_dir, "session_message"))


def p7_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.conversations(_table(spark, sf_dir, "session_message"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode_documents(_table(spark, sf_dir, "documents"), "doc_id")


def _source_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return materialise(encode.count_tokens(documents), "tokens")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_source_tokens(spark, sf_dir), _table(spark, sf_dir, "mix_target"), "doc_id")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_source_tokens(spark, sf_dir), _table(spark, sf_dir, "mix_target"), "doc_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans.shared_span_pairs(_table(spark, sf_dir, "documents"), "doc_id", "text", SPAN)
    return found.select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p10_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_extent(_table(spark, sf_dir, "documents"), "doc_id", "text", SPAN).withColumnRenamed("id", "doc_id")


def p10_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.doubled_lengths(_table(spark, sf_dir, "documents"), "doc_id", "text", SPAN).withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p2_found, p2_judges, p2_agreement, p3_found, p3_report, p4_found, p4_classes, p5_found, p5_splits, p7_found, p7_conversations, p8_ids, p9_mix, p9_shares, p10_found, p10_shared, p10_lengths)}


def oracle_sql() -> dict[str, str]:
    found = {"p3_found": sql.P3_FOUND, "p3_report": sql.P3_REPORT, "p4_found": sql.P4_FOUND, "p4_classes": sql.P4_CLASSES}
    return found | {"p2_agreement": sql.P2_AGREEMENT, "p5_found": sql.P5_FOUND, "p7_found": sql.p7_found(conversations.SPEAKERS), "p10_found": sql.P10_FOUND, "p10_shared": sql.P10_SHARED, "p10_lengths": sql.P10_LENGTHS}

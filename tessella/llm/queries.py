"""The queries of this folder, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import furniture, knn_forest, leakage, mixing, moderation, near_dups, repeated_lines, splitter
from tessella.llm.common import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return furniture.furniture_lines(table(spark, d, "embedding_requests"))


def p1_main_body(spark: SparkSession, d: str) -> DataFrame:
    return furniture.main_body(table(spark, d, "embedding_requests"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.repeated_lines(table(spark, d, "chunks"))


def p2_sequences(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.prefixspan(table(spark, d, "chunks"))[0]


def p2_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.remove_repeated_lines(table(spark, d, "chunks").select("point_id", "base_url", "url", "text").distinct()).select("point_id", "text", "removed_lines")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_neighbours(spark, d).select("point_id", "neighbour_id")


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    good = knn_forest.valid_vectors(table(spark, d, "points"), table(spark, d, "collections"))
    return knn_forest.all_knn(good).select(F.col("id").alias("point_id"), "neighbour_id", F.round("cosine", 6).alias("cosine"), "rank")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_pieces(spark, d).select("request_id").distinct()


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitter.split_oversized(table(spark, d, "embedding_requests"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return near_dups.near_duplicate_pairs(table(spark, d, "chunks")).select("point_id_a", "point_id_b")


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_dups.near_duplicate_groups(table(spark, d, "chunks"), 0.5)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_report(spark, d).select("doc_id", "item_id")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_used(spark, d).where("short").select("source")


def p7_plan(spark: SparkSession, d: str) -> DataFrame:
    return mixing.source_plan(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_used(spark: SparkSession, d: str) -> DataFrame:
    return mixing.source_use(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_scores(spark, d).where("flagged").select("doc_id")


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return moderation.score_texts(docs, moderation.fit(docs, table(spark, d, "moderation_labels")))


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return moderation.source_rates(table(spark, d, "documents"), p8_scores(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit()}

"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orderloom.llm import (
    bpe_codec,
    collocations,
    filter_audit,
    group_join,
    multi_index,
    nn_descent,
    packing,
    pii,
    quality,
    site_lines,
    token_counts,
    toxicity,
    warc,
)
from orderloom.llm.common import table


def op1_warc_round_trip(spark: SparkSession, directory: str) -> DataFrame:
    return warc.page_records(table(spark, directory, "pages"))


def op2_near_duplicate_texts(spark: SparkSession, directory: str) -> DataFrame:
    return group_join.near_duplicate_groups(table(spark, directory, "documents"))


def op3_embedding_near_duplicates(spark: SparkSession, directory: str) -> DataFrame:
    return nn_descent.near_duplicates(table(spark, directory, "embeddings"))


def op4_site_lines(spark: SparkSession, directory: str) -> DataFrame:
    return site_lines.cleaned_documents(table(spark, directory, "documents"))


def op5_bpe_round_trip(spark: SparkSession, directory: str) -> DataFrame:
    return bpe_codec.digests(bpe_codec.round_trip(table(spark, directory, "documents")))


def op6_token_counts(spark: SparkSession, directory: str) -> DataFrame:
    return token_counts.token_counts(table(spark, directory, "documents"))


def op7_quality_scores(spark: SparkSession, directory: str) -> DataFrame:
    return quality.quality_scores(table(spark, directory, "documents"), table(spark, directory, "labels"))


def op8_nearest_neighbours(spark: SparkSession, directory: str) -> DataFrame:
    return multi_index.neighbours(table(spark, directory, "embeddings"))


def op9_personal_data(spark: SparkSession, directory: str) -> DataFrame:
    return pii.span_report(pii.find_spans(table(spark, directory, "documents")))


def op10_pattern_packing(spark: SparkSession, directory: str) -> DataFrame:
    return packing.pack_documents(table(spark, directory, "documents"))


def op11_collocations(spark: SparkSession, directory: str) -> DataFrame:
    return collocations.collocations(table(spark, directory, "documents"))


def op12_toxicity_scores(spark: SparkSession, directory: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, directory, "documents"), table(spark, directory, "labels"))


def op13_filter_audit(spark: SparkSession, directory: str) -> DataFrame:
    return filter_audit.audit(table(spark, directory, "documents"), table(spark, directory, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_round_trip": op1_warc_round_trip,
    "op2_near_duplicate_texts": op2_near_duplicate_texts,
    "op3_embedding_near_duplicates": op3_embedding_near_duplicates,
    "op4_site_lines": op4_site_lines,
    "op5_bpe_round_trip": op5_bpe_round_trip,
    "op6_token_counts": op6_token_counts,
    "op7_quality_scores": op7_quality_scores,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_personal_data": op9_personal_data,
    "op10_pattern_packing": op10_pattern_packing,
    "op11_collocations": op11_collocations,
    "op12_toxicity_scores": op12_toxicity_scores,
    "op13_filter_audit": op13_filter_audit,
}
ORACLES: dict[str, str] = {
    "op4_site_lines": site_lines.SQL,
    "op11_collocations": collocations.SQL,
    "op13_filter_audit": filter_audit.SQL,
}

"""The corpus pipeline: quality, boilerplate lines, near duplicates, personal data, packing.

Every stage takes what the one before it kept, written to the shared folder and
read again. All but the last return the columns of the documents, with ``text``
and ``n_chars`` changed where a stage changes texts. Extra columns pass through
whatever their names; an empty table passes through empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.llm import group_join, packing, pii, quality, site_lines
from orderloom.llm.common import stored, table


def _with_text(columns: list[str], text: Column, parent: str = "") -> list[Column]:
    """The columns of a document, with another text and its length."""
    own = {"text": text, "n_chars": F.length(text).cast("long")}
    return [own.get(c, F.col(f"{parent}`{c}`")).alias(c) for c in columns]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; null and empty texts are scored as empty."""
    model = quality.fit_on_labels(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).where(F.col("score") >= quality.THRESHOLD).select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate of their source."""
    cleaned = site_lines.drop_boilerplate(docs)
    return cleaned.select(*_with_text(docs.columns, F.col("text"), "row."))


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of every group of near duplicates; of repeated rows one.

    Documents without words are in no group and stay, as do rows without doc_id.
    """
    grouped = stored(group_join.near_duplicate_groups(docs), "groups")
    named = grouped.where("doc_id is not null")
    others = stored(named.where("doc_id <> component_id").select("doc_id").distinct(), "others")
    kept = docs.join(group_join.bounded_broadcast(others), "doc_id", "left_anti").select(*docs.columns)
    repeated = stored(named.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, "doc_id", "left_anti").select(*docs.columns)
    return once.unionByName(kept.join(repeated, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"]))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; null texts stay null."""
    field = pii.fit_field(docs)
    return pii.redacted(docs, field).select(*_with_text(docs.columns, F.col("hidden"), "row."))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", keep_quality),
    ("lines", drop_lines),
    ("near_duplicates", keep_one_of_group),
    ("personal_data", hide_personal_data),
    ("packing", pack),
]

#: The classifier, the random field and the token ids cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that all stages leave of a folder's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs

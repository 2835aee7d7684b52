"""The corpus pipeline: stages from the operators of ``inkmark.llm`` applied to ``documents`` one after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmark.llm.arrow import stored, table
from inkmark.llm.decontamination import contaminated
from inkmark.llm.packing import pack_documents
from inkmark.llm.pii import find_pii, fit_pii
from inkmark.llm.quality_rules import apply_rules, fit_rules
from inkmark.llm.sketch_dedup import kept_rows
from inkmark.session import broadcast_checked

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the hard limits and the isolation forest; repeated rows and rows without id are judged alike."""
    judged = apply_rules(docs, fit_rules(docs, table(spark, sf_dir, "labels")), keep=COLUMNS[1:])
    return judged.filter("kept").select(*COLUMNS)


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with ``row_key``, 128 bits of all their columns: rows that share an id, or have none, are told apart by it."""
    row = F.to_json(F.struct(*COLUMNS), {"ignoreNullFields": "false"})
    return docs.select(*COLUMNS, F.unhex(F.md5(row)).alias("row_key"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: that of the smallest id, and a row without id only where all are; texts decide, not ids.

    Rows that share an id, or have none, stay with every text that is no copy. Of rows with one id and one set of shingles one
    stays, the same on every run; a text without words is a copy only of such a text under its own id.
    """
    rows = keyed(docs)
    # the join brings equal rows together, so the last step needs no exchange of its own
    return rows.join(kept_rows(rows, "row_key"), "row_key", "left_semi").dropDuplicates(["row_key"]).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark item; rows that share an id, or have none, are judged each by its own text."""
    rows = keyed(docs)
    found = contaminated(rows, table(spark, sf_dir, "benchmark"), id_col="row_key").select(F.col("doc_id").alias("row_key")).distinct()
    # few rows are found as a rule; then the texts need not move
    return rows.join(broadcast_checked(stored(found, "found")), "row_key", "left_anti").select(*COLUMNS)


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; ``n_chars`` follows the new text."""
    found = find_pii(docs, fit_pii(docs), keep=("lang", "source"))
    text = F.col("redacted")
    return found.select("doc_id", text.alias("text"), "lang", "source", F.char_length(text).cast("long").alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of the permitted lengths."""
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", pii_redaction),
    ("packing", packing),
]

#: No SQL: the stages fit models and encode tokens; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage reads what its predecessor kept, from Parquet."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

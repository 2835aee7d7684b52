"""The standard tables read as labelled corpora.

``docs`` (documents joined with labels) plays a labelled benchmark with groups and
domains, ``conv`` (conversation turns) a human/machine benchmark with prompt groups,
``emb`` a table of frozen-encoder vectors.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmark.session import spread


# Turns that the id of a conversation's turn has room for.
TURNS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str, heavy: bool = False) -> DataFrame:
    """One standard table; ``heavy`` spreads a scan of few splits for CPU-heavy text work."""
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(scan) if heavy else scan


def docs_labeled(spark: SparkSession, sf_dir: str, heavy: bool = False) -> DataFrame:
    """doc_id, text, label, toxic, domain (language), grp (source), n_chars, dataset_name."""
    docs = table(spark, sf_dir, "documents", heavy).select("doc_id", "text", "lang", "source", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return docs.join(labels, "doc_id").select(
        "doc_id",
        "text",
        F.col("quality").cast("int").alias("label"),
        F.col("toxic").cast("int").alias("toxic"),
        F.col("lang").alias("domain"),
        F.col("source").alias("grp"),
        "n_chars",
        F.lit("docs").alias("dataset_name"),
    )


def turn_id() -> Column:
    """One id per (conv_id, turn): the turn takes the last six digits; a longer conversation is an error, not a clash."""
    fits = (F.col("turn") >= 0) & (F.col("turn") < TURNS)
    number = F.when(fits, F.col("conv_id").cast("bigint") * TURNS + F.col("turn"))
    return F.coalesce(number, F.raise_error(F.lit("a turn number needs more than six digits")).cast("bigint"))


def conv_labeled(spark: SparkSession, sf_dir: str, heavy: bool = False) -> DataFrame:
    """doc_id, text, label, prompt_group, domain (turn parity), dataset_name."""
    turns = table(spark, sf_dir, "conversations", heavy).filter(F.col("role").isin("user", "assistant"))
    return turns.select(
        turn_id().alias("doc_id"),
        "text",
        F.when(F.col("role") == "assistant", 1).otherwise(0).alias("label"),
        F.col("conv_id").alias("prompt_group"),
        F.concat(F.lit("t"), (F.col("turn") % 2).cast("string")).alias("domain"),
        F.lit("conv").alias("dataset_name"),
    )


def all_turns(spark: SparkSession, sf_dir: str, heavy: bool = False) -> DataFrame:
    """doc_id and text of every turn, whoever speaks."""
    return table(spark, sf_dir, "conversations", heavy).select(turn_id().alias("doc_id"), "text")


def emb_labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, embedding, label."""
    return table(spark, sf_dir, "embeddings", heavy=True).select(
        F.col("vec_id").alias("doc_id"), "embedding", F.when(F.col("label") >= 5, 1).otherwise(0).alias("label")
    )


def with_generators(docs: DataFrame) -> DataFrame:
    """Generator and attack metadata derived from the ids of ``docs``."""
    return docs.withColumn(
        "model", F.when(F.col("label") == 1, F.concat(F.lit("g"), F.col("doc_id") % 4)).otherwise("human")
    ).withColumn(
        "attack",
        F.when((F.col("label") == 1) & (F.col("doc_id") % 3 > 0), F.concat(F.lit("a"), F.col("doc_id") % 3)).otherwise(
            "none"
        ),
    )


def with_conflicts(docs: DataFrame) -> DataFrame:
    """``docs`` plus upper-cased copies with flipped labels of every seventh id."""
    flipped = docs.filter(F.col("doc_id") % 7 == 0)
    flipped = flipped.withColumns(
        {
            "doc_id": -F.col("doc_id") - 1,  # below all others
            "text": F.translate("text", ascii_lowercase, ascii_uppercase),
            "label": 1 - F.col("label"),
        }
    )
    return docs.unionByName(flipped)


def with_markers(docs: DataFrame) -> DataFrame:
    """``docs`` with authorship markers planted before and after the texts."""
    return docs.withColumn(
        "text",
        F.expr(
            "CASE doc_id % 5 WHEN 0 THEN concat('# AI-generated ', text) WHEN 1 THEN concat('(ai generated) ', text) "
            "WHEN 2 THEN concat(text, ' // AI-GENERATED') ELSE text END"
        ),
    )

"""Label encoders: 0 is human-written, 1 is machine-generated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings each encoder accepts.
PERMISSIVE_HUMAN = ("0", "human", "real", "false", "not_generated", "not generated")
PERMISSIVE_AI = ("1", "ai", "machine", "generated", "true", "llm")
PERMISSIVE_V0_HUMAN = ("human", "0", "false", "no", "human-written", "real")
PERMISSIVE_V0_AI = ("ai", "1", "true", "yes", "generated", "machine")
STRICT_HUMAN = ("0", "human", "humans", "real", "authentic", "student", "not_generated", "not generated")
STRICT_AI = ("1", "ai", "machine", "generated", "llm", "model", "chatgpt", "gpt", "synthetic")
GENERATOR_LABEL_COLUMNS = ("label", "is_ai", "generated", "class")
HUMAN_COLUMN_NAMES = ("original", "human", "human_text")
GENERATOR_AFFIXES = ("_generated_abstract", "_generated_post", "generated_", "_generated")


def spelled(value: Column) -> Column:
    """Trimmed lower-case spelling; integral decimals such as ``0.0`` read as ``0``."""
    return F.regexp_replace(F.lower(F.trim(value.cast("string"))), r"^(\d+)\.0+$", "$1")


def _two_sets(value: Column, human: tuple, ai: tuple) -> Column:
    return F.when(value.isin(*human), 0).when(value.isin(*ai), 1)


def permissive(value: Column) -> Column:
    """Unknown spellings count as machine unless they mention ``human``."""
    key = F.coalesce(spelled(value), F.lit(""))
    return _two_sets(key, PERMISSIVE_HUMAN, PERMISSIVE_AI).otherwise(F.when(key.contains("human"), 0).otherwise(1))


def permissive_v0(value: Column) -> Column:
    """The earlier permissive rule: ``no`` is human, ``not generated`` is not."""
    key = F.coalesce(spelled(value), F.lit(""))
    return _two_sets(key, PERMISSIVE_V0_HUMAN, PERMISSIVE_V0_AI).otherwise(
        F.when(key.contains("human"), 0).otherwise(1)
    )


def _or_fail(encoded: Column, value: Column, on_unknown: str) -> Column:
    if on_unknown == "null":
        return encoded
    message = F.concat(F.lit("unknown label value: "), F.coalesce(value.cast("string"), F.lit("NULL")))
    return F.coalesce(encoded, F.raise_error(message).cast("int"))


def strict(value: Column, on_unknown: str = "null") -> Column:
    """Only listed spellings; others give NULL (for quarantine) or an error."""
    return _or_fail(_two_sets(spelled(value), STRICT_HUMAN, STRICT_AI), value, on_unknown)


def legacy(value: Column, on_unknown: str = "error") -> Column:
    """``human`` or ``ai`` and nothing else."""
    return _or_fail(_two_sets(spelled(value), ("human",), ("ai",)), value, on_unknown)


def from_generator(columns: list[str], on_unknown: str = "error") -> Column:
    """Generator name decides when present, else the first filled label column."""
    declared = [F.col(c).cast("string") for c in GENERATOR_LABEL_COLUMNS if c in columns]
    explicit = F.coalesce(*declared) if declared else F.lit(None).cast("string")
    encoded = _two_sets(spelled(explicit), PERMISSIVE_HUMAN, PERMISSIVE_AI)
    if "model" in columns:
        name = F.lower(F.trim(F.col("model")))
        encoded = F.when(F.col("model").isNotNull(), F.when(name == "human", 0).otherwise(1)).otherwise(encoded)
    return _or_fail(encoded, explicit, on_unknown)


def challenge(value: Column) -> Column:
    return F.when(F.lower(F.trim(value.cast("string"))) == "ai", 1).otherwise(0)


def label_of_column(name: Column) -> Column:
    """Label told by the name of a wide table's text column; NULL where it tells nothing."""
    lowered = F.lower(name)
    return F.when(lowered.startswith("original_") | lowered.isin(*HUMAN_COLUMN_NAMES), 0).when(
        lowered.contains("generated"), 1
    )


def generator_of_column(name: Column) -> Column:
    """Generator told by the column name, with the fixed affixes removed one after the other."""
    stem = F.lower(name)
    for affix in GENERATOR_AFFIXES:
        stem = F.regexp_replace(stem, affix, "")
    named = F.when(F.length(stem) == 0, "unknown_ai").otherwise(stem)
    return F.when(label_of_column(name) == 0, "human").when(label_of_column(name) == 1, named)


def domain_of_column(file_name: Column, name: Column) -> Column:
    """Domain told by file and column name."""
    both = F.lower(F.concat_ws(" ", file_name, name))
    return (
        F.when(both.contains("post") | both.contains("social"), "social_media")
        .when(both.contains("abstract"), "academic_abstract")
        .otherwise("arabic_text")
    )

"""Reshaping: wide tables to rows, unions of result sets, long feature views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmark.functions import labels
from inkmark.functions.text import normalize_arabic
from inkmark.operators.dedup import keep_first


def text_columns(columns: list[str]) -> list[str]:
    """Columns whose name tells a label: human originals and machine versions."""
    lowered = {c: c.lower() for c in columns}
    return [
        c
        for c, name in lowered.items()
        if name.startswith("original_") or name in labels.HUMAN_COLUMN_NAMES or "generated" in name
    ]


def wide_to_long(raw: DataFrame, ids: list[str], file_name: str, dataset_name: str) -> DataFrame:
    """One row per (row, text column) with label, generator and domain told by the column name.

    One ``unpivot`` reads the table once, where a loop over columns would scan it per column.
    """
    names = text_columns(raw.columns)
    if not names:
        raise ValueError(f"no original or generated text columns among {raw.columns}")
    source = F.col("source_column")
    rows = raw.select(*ids, *names).unpivot(ids, names, "source_column", "text")
    rows = rows.select(
        *ids,
        normalize_arabic(F.col("text")).alias("text"),
        labels.label_of_column(source).alias("label"),
        F.lit(dataset_name).alias("dataset_name"),
        labels.domain_of_column(F.lit(file_name), source).alias("domain"),
        labels.generator_of_column(source).alias("generator"),
        "source_column",
        # column order of the table, the order in which the rows count as first
        reduce(lambda rest, i: F.when(source == names[i], i).otherwise(rest), range(len(names)), F.lit(len(names))).alias(
            "_order"
        ),
    )
    rows = rows.filter(F.length("text") > 0)
    return keep_first(rows, F.col("text"), ["_order", *ids]).drop("_order")


def union_all(tables: list[DataFrame]) -> DataFrame:
    """Concatenate by column name; columns a table lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def features_long(features: DataFrame, ids: list[str], names: list[str]) -> DataFrame:
    return features.unpivot(ids, names, "feature", "value")

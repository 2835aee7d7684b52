"""Writers for clean tables, splits, audits and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_split(df: DataFrame, path: str) -> None:
    """One table partitioned by dataset and split; a reader of one split scans only its folders."""
    df.write.mode("overwrite").partitionBy("dataset_name", "split").parquet(path)


def write_table(df: DataFrame, path: str, kind: str) -> None:
    """Export as csv, tsv, jsonl or parquet; the path should carry the matching suffix."""
    writer = df.write.mode("overwrite")
    if kind == "parquet":
        writer.parquet(path)
    elif kind == "jsonl":
        writer.json(path)
    elif kind in ("csv", "tsv"):
        options = writer.option("header", True).option("quote", '"').option("escape", '"')
        # quote everything: texts hold separators and line breaks, and NULL differs from ''
        options.option("quoteAll", True).option("sep", "\t" if kind == "tsv" else ",").csv(path)
    else:
        raise ValueError(f"cannot write {kind}")


def write_audit_json(audit: DataFrame, path: str) -> None:
    audit.write.mode("overwrite").json(path)


def write_report(lines: DataFrame, path: str) -> None:
    """Markdown lines in order. A report has a line per experiment, so one file is enough."""
    lines.orderBy("line_no").select("line").coalesce(1).write.mode("overwrite").text(path)

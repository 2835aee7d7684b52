"""Readers: dispatch by suffix, discovery below a folder, the clean contract, bounded scans.

A table is a file or a folder written by Spark; in both cases the suffix of its name tells
the format. Listing goes through the Hadoop file system, so shared and object stores work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkmark.operators.reshape import union_all

# Suffixes per format, and the order in which the first table of a folder is looked for.
FORMATS = {
    ".csv": "csv",
    ".jsonl": "jsonl",
    ".json": "json",
    ".parquet": "parquet",
    ".pq": "parquet",
    ".tsv": "tsv",
    ".txt": "tsv",
}
FIRST_TABLE_ORDER = (".csv", ".jsonl", ".json", ".parquet", ".tsv")
DISCOVERED = (".csv", ".tsv", ".jsonl", ".json", ".parquet", ".pq")
REQUIRED = ("text", "label", "dataset_name")


def _suffix(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return name[name.rfind(".") :].lower() if "." in name else ""


def format_of(path: str) -> str:
    try:
        return FORMATS[_suffix(path)]
    except KeyError:
        raise ValueError(f"unsupported file type: {path}") from None


def _read(spark: SparkSession, kind: str, paths: list[str], schema: T.StructType | str | None, multi_line: bool = True) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "parquet":
        return reader.parquet(*paths)
    if kind == "jsonl":
        return reader.json(paths)
    if kind == "json":
        # one JSON array per file: a file is the unit of parallelism
        return reader.option("multiLine", True).json(paths)
    reader = reader.option("header", True).option("multiLine", multi_line).option("quote", '"').option("escape", '"')
    if schema is None:
        reader = reader.option("inferSchema", True)
    return reader.option("sep", "\t" if kind == "tsv" else ",").csv(paths)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = True) -> DataFrame:
    """Read one table; give the schema of known feeds to avoid an inference pass.

    Fields of CSV and TSV may hold line ends, so a file is one task; ``multi_line=False`` splits files without such fields.
    """
    return _read(spark, format_of(path), [path], schema, multi_line)


def _children(spark: SparkSession, folder: str) -> list[tuple[str, bool]]:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return [(s.getPath().toString(), s.isDirectory()) for s in system.listStatus(hadoop)]


def find_first_table(spark: SparkSession, folder: str) -> str | None:
    """First table of a folder by format priority, then by name."""
    names = sorted(path for path, _ in _children(spark, folder))
    return next((n for suffix in FIRST_TABLE_ORDER for n in names if _suffix(n) == suffix), None)


def discover_tables(spark: SparkSession, folder: str, prefer_monolingual: bool = True) -> list[str]:
    """All tables below a folder, sorted. Only names are listed; no data is read.

    Monolingual tables win if there are any; otherwise multilingual ones are left out.
    """
    if _suffix(folder) in FORMATS:
        return [folder]
    found, pending = [], [folder]
    while pending:
        for path, is_folder in _children(spark, pending.pop()):
            if _suffix(path) in DISCOVERED:
                found.append(path)
            elif is_folder:
                pending.append(path)
    found.sort()
    if not prefer_monolingual:
        return found

    def named(word: str) -> list[str]:
        return [p for p in found if word in p.rsplit("/", 1)[-1].lower()]

    return named("monolingual") or [p for p in found if p not in named("multilingual")]


def read_tables(
    spark: SparkSession, paths: list[str], root: str, schema: T.StructType | str | None = None, multi_line: bool = True
) -> DataFrame:
    """Union of many tables with ``source_file`` relative to ``root``: one scan per format."""
    below = _relative(_resolved(spark, root))
    by_format: dict[str, list[str]] = {}
    for path in paths:
        by_format.setdefault(format_of(path), []).append(path)
    return union_all(
        [_read(spark, kind, group, schema, multi_line).withColumn("source_file", below) for kind, group in sorted(by_format.items())]
    )


def _resolved(spark: SparkSession, root: str) -> str:
    """The absolute path of a folder in its file system, without scheme and host."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(root)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toUri().getPath()


def _relative(root: str) -> Column:
    """Path of a row's table below the resolved ``root``; an error where the row comes from elsewhere.

    Spark gives paths URL-encoded. A plus sign stands for itself there, so it is protected from the decoder.
    """
    decoded = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    path = F.regexp_replace(decoded, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    prefix = root.rstrip("/") + "/"
    below = F.substr(path, F.lit(len(prefix) + 1))
    suffixes = "|".join(s.lstrip(".") for s in FORMATS)
    table = F.regexp_extract(below, rf"^(.*?\.(?:{suffixes}))(?:/[^/]*)?$", 1)
    inside = F.startswith(path, F.lit(prefix)) & (table != "")
    return F.when(inside, table).otherwise(F.raise_error(F.concat(F.lit(f"not a table below {root}: "), decoded)))


def require_clean_contract(df: DataFrame) -> DataFrame:
    """Check the required columns on the schema, then drop rows without text or label."""
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"clean table misses {missing}; it has {df.columns}")
    return df.na.drop(subset=["text", "label"])


def bounded_scan(df: DataFrame, max_scan: int, key: str) -> DataFrame:
    """The first ``max_scan`` rows in key order (top-k per task, then merged)."""
    return df.orderBy(key).limit(max_scan)

"""Registered queries: readers and writers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkmark.functions import labels
from inkmark.functions.text import squash_spaces
from inkmark.operators import columns, dedup
from inkmark.operators.reshape import union_all
from inkmark.operators.splits import sample_balanced, split_stratified
from inkmark.plans import oracle as o
from inkmark.plans.cleaning import ORACLES as ORACLES_CLEANING
from inkmark.plans.cleaning import audit_cleaning
from inkmark.plans.evaluation import ORACLES as ORACLES_EVALUATION
from inkmark.plans.evaluation import report_lines
from inkmark.plans.splitting import SPLIT_STRATIFIED_SQL
from inkmark.session import cut_lineage, scratch_path
from inkmark.sources import sinks, tables
from inkmark.sources.bindings import docs_labeled, table, with_generators

QUERIES = {}
ORACLES = {}

CONVERSATION = "conv_id bigint, turn bigint, role string, text string"


def query(name, sql=None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


@query(
    "scan_table",
    """SELECT f.format, conv_id, turn, role, text FROM conversations
CROSS JOIN (VALUES ('csv'), ('jsonl'), ('parquet'), ('tsv')) f(format)""",
)
def scan_table(spark, sf_dir):
    """The conversations written in four formats and read back by suffix."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    root = scratch_path(spark, "scan")
    parts = []
    for kind in ("csv", "jsonl", "parquet", "tsv"):
        path = f"{root}/conversations.{kind}"
        sinks.write_table(turns, path, kind)
        parts.append(tables.read_table(spark, path, CONVERSATION).withColumn("format", F.lit(kind)))
    return union_all(parts)


@query(
    "scan_discover",
    """SELECT CASE WHEN conv_id % 3 = 0 THEN 'train_monolingual.jsonl' ELSE 'deep/dev_monolingual.csv' END AS source_file,
       conv_id, turn, text, CASE WHEN conv_id % 3 = 0 THEN role END AS role
FROM conversations WHERE conv_id % 3 < 2""",
)
def scan_discover(spark, sf_dir):
    """Discovery below a folder that also holds a multilingual table; the csv feed lacks a column."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    root = scratch_path(spark, "discover")
    third = F.col("conv_id") % 3
    sinks.write_table(turns.filter(third == 0), f"{root}/train_monolingual.jsonl", "jsonl")
    sinks.write_table(turns.filter(third == 1).drop("role"), f"{root}/deep/dev_monolingual.csv", "csv")
    sinks.write_table(turns.filter(third == 2), f"{root}/deep/all_multilingual.parquet", "parquet")
    return tables.read_tables(spark, tables.discover_tables(spark, root), root).select(
        "source_file", F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "text", "role"
    )


@query(
    "scan_clean_contract",
    f"""{o.with_(o.DOCS)} SELECT doc_id, text, label, dataset_name FROM docs WHERE doc_id % 11 <> 0 AND doc_id % 13 <> 0""",
)
def scan_clean_contract(spark, sf_dir):
    docs = docs_labeled(spark, sf_dir).select(
        "doc_id",
        F.when(F.col("doc_id") % 11 != 0, F.col("text")).alias("text"),
        F.when(F.col("doc_id") % 13 != 0, F.col("label")).alias("label"),
        "dataset_name",
    )
    return tables.require_clean_contract(docs)


@query("scan_bounded", "SELECT doc_id, lang, source FROM documents ORDER BY doc_id LIMIT 500")
def scan_bounded(spark, sf_dir):
    return tables.bounded_scan(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), 500, "doc_id")


@query(
    "sink_roundtrip",
    f"""WITH s AS ({SPLIT_STRATIFIED_SQL})
SELECT doc_id, label, domain, 'docs' AS dataset_name, split FROM s WHERE split = 'test'""",
)
def sink_roundtrip(spark, sf_dir):
    """A split written as a partitioned table; reading the test side prunes the other partitions."""
    path = scratch_path(spark, "splits")
    docs = docs_labeled(spark, sf_dir).select("doc_id", "label", "domain", "dataset_name")
    sinks.write_split(split_stratified(docs), path)
    return spark.read.parquet(path).filter(F.col("split") == "test")


@query("sink_audit_json", ORACLES_CLEANING["audit_cleaning"])
def sink_audit_json(spark, sf_dir):
    """The cleaning audit, written as JSON and read back."""
    audit = audit_cleaning(spark, sf_dir)
    path = scratch_path(spark, "audit")
    sinks.write_audit_json(audit, path)
    return spark.read.schema(audit.schema).json(path)


@query("sink_report", "SELECT row_number() OVER (ORDER BY line_no) - 1 AS line_no, line FROM (" + ORACLES_EVALUATION["report_lines"] + ")")
def sink_report(spark, sf_dir):
    """The result table, written as Markdown lines and read back in order."""
    path = scratch_path(spark, "report")
    sinks.write_report(report_lines(spark, sf_dir), path)
    # a report is one short file, so its lines are numbered in one task
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("_at"))
    return lines.select((F.row_number().over(Window.orderBy("_at")) - 1).cast("bigint").alias("line_no"), "line")


_FEED = f"""{o.with_(o.DOCS, o.GENERATED)},
feed AS (SELECT doc_id, text, domain AS lang, CASE WHEN doc_id % 9 > 0 THEN grp END AS domain, CASE WHEN label = 1 THEN model ELSE 'human' END AS model FROM gen),
clean AS (SELECT doc_id, {o.squash('text')} AS text, CASE WHEN lower(model) = 'human' THEN 0 ELSE 1 END AS label,
  coalesce(domain, 'unknown') AS domain, model FROM feed WHERE lang IN ('en', 'eng', 'english')),
uniq AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM clean WHERE length(text) > 0) WHERE rn = 1),
s AS (SELECT least(count(*) FILTER (label = 0), count(*) FILTER (label = 1)) AS k FROM uniq)
SELECT doc_id, label, domain, model, attack, md5(text) AS text_md5 FROM (
  SELECT *, 'none' AS attack, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || CAST(doc_id AS VARCHAR))) AS r FROM uniq) WHERE r <= (SELECT k FROM s)"""


@query("feed_generator", _FEED)
def feed_generator(spark, sf_dir):
    """A feed with generator names from raw rows to a balanced table: language, labels, defaults, copies, balance."""
    docs = with_generators(docs_labeled(spark, sf_dir))
    raw = docs.select(
        "doc_id", F.col("text").alias("generation"), F.col("domain").alias("lang"), F.when(F.col("doc_id") % 9 > 0, F.col("grp")).alias("domain"), "model"
    )
    english = columns.keep_english(raw)
    labelled = english.select(
        "doc_id", squash_spaces(F.col("generation")).alias("text"), labels.from_generator(["model"]).alias("label"), "domain", "model"
    ).filter(F.length("text") > 0)
    filled = columns.with_defaults(labelled, {"domain": "unknown", "attack": "none"})
    unique = cut_lineage(dedup.dedup_text(filled, ["doc_id"]))
    balanced = sample_balanced(unique, 1 << 62, 1 << 62)
    return balanced.select("doc_id", "label", "domain", "model", "attack", F.md5(F.col("text").cast("binary")).alias("text_md5"))


_STRICT_FEED = f"""WITH raw AS (SELECT doc_id, source || '.parquet' AS source_file, text,
  CASE WHEN doc_id % 97 = 5 THEN NULL WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END AS label FROM documents),
good AS (SELECT * FROM raw WHERE source_file NOT IN (SELECT source_file FROM raw WHERE label IS NULL)),
clean AS (SELECT doc_id, source_file, {o.squash('text')} AS text, label FROM good WHERE text IS NOT NULL),
uniq AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY source_file, doc_id) AS rn FROM clean WHERE length(text) > 0)
SELECT source_file, count(*) AS n_rows, sum(label) AS n_ai, min(doc_id) AS first_id FROM uniq WHERE rn = 1 GROUP BY source_file"""


@query("feed_strict", _STRICT_FEED)
def feed_strict(spark, sf_dir):
    """Files below a folder with odd names: discovery, cleaning, quarantine of files, copies within and across files, summary."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    raw = F.when(F.col("doc_id") % 97 == 5, "no idea").when(F.col("doc_id") % 2 == 0, "human").otherwise("AI")
    root = scratch_path(spark, "feed of a+b")
    rows = docs.withColumn("label", raw).withColumn("file", F.concat("source", F.lit(".parquet")))
    rows.write.partitionBy("file").parquet(f"{root}/raw")
    feed = spark.read.parquet(f"{root}/raw").withColumnRenamed("file", "source_file")
    feed = feed.withColumn("label", labels.strict(F.col("label")))
    kept, _ = columns.quarantine_sources(feed, "source_file", need_one=False)
    clean = kept.withColumn("text", squash_spaces(F.col("text"))).filter(F.length("text") > 0)
    unique = dedup.dedup_two_level(clean, "source_file", "doc_id")
    return unique.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("label").alias("n_ai"), F.min("doc_id").alias("first_id")
    )

"""Registered queries: streams over the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkmark.functions import stylometry
from inkmark.plans import oracle as o
from inkmark.plans.evaluation import SCORERS, logit_sql, apply_scorers
from inkmark.plans.features import v2_sql
from inkmark.sources.bindings import table
from inkmark.streaming import jobs

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def _stream(spark, sf_dir, name):
    return jobs.table_stream(spark, sf_dir, f"{name}.parquet", table(spark, sf_dir, name).schema)


@query(
    "stream_score",
    f"""WITH {v2_sql('documents')} SELECT doc_id, detector, score, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS prediction FROM ("""
    + " UNION ALL ".join(
        f"SELECT doc_id, '{m}' AS detector, round(1.0 / (1.0 + exp(-{logit_sql(b, w)})), 2) AS score FROM v2"
        for m, t, b, w in SCORERS
        if t == "docs"
    )
    + ")",
)
def stream_score(spark, sf_dir):
    def score(stream):
        features = stylometry.add_v2_features(stream, keep=["doc_id"])
        return apply_scorers(features, [s for s in SCORERS if s[1] == "docs"])

    scored = jobs.stream_score(_stream(spark, sf_dir, "documents"), score)
    return jobs.scratch_run(scored.select("doc_id", "detector", "score", "prediction"), "stream-score")


@query(
    "stream_dedup",
    f"SELECT DISTINCT md5({o.squash('text')}) AS text_md5 FROM documents WHERE length(trim(text)) > 0",
)
def stream_dedup(spark, sf_dir):
    unique = jobs.stream_dedup(_stream(spark, sf_dir, "documents"))
    return jobs.scratch_run(unique.select("text_md5"), "stream-dedup")


@query(
    "stream_label_counts",
    "SELECT role, turn % 2 AS parity, count(*) AS n FROM conversations GROUP BY 1, 2",
)
def stream_label_counts(spark, sf_dir):
    turns = _stream(spark, sf_dir, "conversations").withColumn("parity", F.col("turn") % 2)
    return jobs.scratch_run(jobs.stream_label_counts(turns, ["role", "parity"]), "stream-counts", complete=True)

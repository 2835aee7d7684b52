"""The flagship query: from raw turns to an evaluation table, in one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmark.functions import stylometry
from inkmark.functions.text import squash_spaces
from inkmark.operators import dedup, metrics
from inkmark.plans import oracle as o
from inkmark.plans.evaluation import BINARY_SQL, SCORERS, apply_scorers, auc_sql, counts_sql, logit_sql, using
from inkmark.plans.features import v2_sql
from inkmark.sources.bindings import conv_labeled


def detector_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan, clean, deduplicate, featurise, score and evaluate conversations, overall and per slice."""
    turns = conv_labeled(spark, sf_dir, heavy=True).select("doc_id", "text", "label", "domain")
    clean = turns.withColumn("text", squash_spaces(F.col("text"))).filter(F.length("text") > 0)
    unique = dedup.dedup_text(clean, ["doc_id"])
    features = stylometry.add_v2_features(unique, keep=["label", "domain"])
    scored = apply_scorers(features, [SCORERS[1]])
    slices = F.array(
        F.struct(F.lit("all").alias("slice_column"), F.lit("all").alias("slice_value")),
        F.struct(F.lit("domain").alias("slice_column"), F.col("domain").alias("slice_value")),
    )
    rows = scored.select("label", "prediction", "score", F.explode(slices).alias("_s"))
    rows = rows.select("label", "prediction", "score", "_s.*")
    report = metrics.evaluate(rows, ["slice_column", "slice_value"])
    return report.filter(F.col("n") >= metrics.MIN_SLICE_ROWS)


QUERIES = {"detector_report": detector_report}
ORACLES = {
    "detector_report": f"""{o.with_(o.CONV)}, t AS (SELECT * REPLACE ({o.squash('text')} AS text) FROM conv),
uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM t WHERE length(text) > 0) WHERE rn = 1),
{v2_sql('uniq', 'doc_id, label, domain')},
one AS (SELECT doc_id, label, domain, round(1.0 / (1.0 + exp(-{logit_sql(*SCORERS[1][2:])})), 2) AS score FROM v2),
scored AS (SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS prediction FROM one),
sliced AS (SELECT 'all' AS slice_column, 'all' AS slice_value, label, prediction, score FROM scored
  UNION ALL SELECT 'domain', domain, label, prediction, score FROM scored),
{counts_sql('sliced', 'slice_column, slice_value', 'HAVING count(*) >= 20')}, {auc_sql('sliced', 'slice_column, slice_value')}
SELECT k.slice_column, k.slice_value, k.n, {BINARY_SQL}, roc_auc FROM k JOIN auc ON {using('slice_column, slice_value')}"""
}

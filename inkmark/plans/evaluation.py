"""Registered queries: audits, scoring with fixed coefficients, metrics and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkmark.functions import labels, stylometry
from inkmark.operators import audits, metrics, reshape, splits
from inkmark.plans import oracle as o
from inkmark.plans.cleaning import PERMISSIVE_SQL, PERMISSIVE_V0_SQL, _GAPPY, _gappy, spelled_docs, spelled_sql
from inkmark.plans.features import v2_sql
from inkmark.plans.splitting import QUERIES as SPLIT_QUERIES
from inkmark.plans.splitting import ORACLES as SPLIT_ORACLES
from inkmark.sources.bindings import conv_labeled, docs_labeled, with_generators

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


# --- audits -------------------------------------------------------------------------------


@query(
    "label_dist_string",
    f"""{o.with_(o.DOCS)}, c AS (SELECT domain, label, count(*) AS n FROM docs GROUP BY domain, label),
s AS (SELECT domain, label, printf('%.3f', round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY domain), 3)) AS share FROM c)
SELECT domain, string_agg(label || '=' || share, '; ' ORDER BY label) AS label_distribution FROM s GROUP BY domain""",
)
def label_dist_string(spark, sf_dir):
    return audits.label_distribution(docs_labeled(spark, sf_dir), by=["domain"])


@query(
    "audit_files",
    f"""{o.with_(spelled_sql())}, raw AS (
  SELECT doc_id, source, CASE WHEN raw_label IS NOT NULL THEN {PERMISSIVE_SQL} END AS label, text
  FROM (SELECT * REPLACE ({_GAPPY} AS text) FROM spelled)),
ok AS (SELECT *, row_number() OVER (PARTITION BY source, clean ORDER BY doc_id) AS rn
       FROM (SELECT *, {o.squash('text')} AS clean FROM raw WHERE text IS NOT NULL AND label IS NOT NULL) WHERE length(clean) > 0)
SELECT source, count(*) AS rows_before, count(*) FILTER (text IS NULL) AS missing_text, count(*) FILTER (label IS NULL) AS missing_label,
  (SELECT count(*) FROM ok WHERE ok.source = raw.source AND rn > 1) AS duplicates_removed,
  (SELECT count(*) FROM ok WHERE ok.source = raw.source AND rn = 1) AS rows_after,
  (SELECT count(*) FROM ok WHERE ok.source = raw.source AND rn = 1 AND label = 0) AS human_rows,
  (SELECT count(*) FROM ok WHERE ok.source = raw.source AND rn = 1 AND label = 1) AS ai_rows
FROM raw GROUP BY source""",
)
def audit_files(spark, sf_dir):
    docs = _gappy(spelled_docs(spark, sf_dir))
    label = F.when(F.col("raw_label").isNotNull(), labels.permissive(F.col("raw_label")))
    return audits.per_file_summary(docs.withColumn("label", label), "source")


@query(
    "audit_distributions",
    f"""{o.with_(o.DOCS, o.GENERATED)}, v AS (
  SELECT 'label' AS column_name, CAST(label AS VARCHAR) AS value FROM gen UNION ALL SELECT 'domain', domain FROM gen
  UNION ALL SELECT 'model', model FROM gen UNION ALL SELECT 'attack', attack FROM gen UNION ALL SELECT 'grp', grp FROM gen)
SELECT * FROM (SELECT column_name, value, n, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rank
  FROM (SELECT column_name, value, count(*) AS n FROM v GROUP BY 1, 2)) WHERE rank <= 20""",
)
def audit_distributions(spark, sf_dir):
    docs = with_generators(docs_labeled(spark, sf_dir))
    return audits.value_distributions(docs, ["label", "domain", "model", "attack", "grp"])


@query(
    "audit_nulls",
    f"""{o.with_(spelled_sql())}, raw AS (SELECT doc_id, {_GAPPY} AS text, lang, source, raw_label FROM spelled)
"""
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS null_count, count(*) AS n_rows FROM raw"
        for c in ("doc_id", "text", "lang", "source", "raw_label")
    ),
)
def audit_nulls(spark, sf_dir):
    docs = _gappy(spelled_docs(spark, sf_dir)).select("doc_id", "text", "lang", "source", "raw_label")
    return audits.null_counts(docs)


@query(
    "audit_label_values",
    f"""{o.with_(spelled_sql())} SELECT DISTINCT raw_label AS label_value FROM spelled WHERE raw_label IS NOT NULL
ORDER BY 1 LIMIT 50""",
)
def audit_label_values(spark, sf_dir):
    return audits.label_values(spelled_docs(spark, sf_dir), "raw_label")


_META = """
meta AS (
  SELECT doc_id, CAST(label AS VARCHAR) AS label, domain, grp, toxic, n_chars // 1000 AS size_class,
         CASE WHEN label = 1 THEN 'm' ELSE 'none' END AS ai_model, CASE WHEN doc_id % 9 > 0 THEN 'v' || (doc_id % 4) END AS decoding
  FROM docs)"""


@query(
    "audit_metadata_leakage",
    f"""{o.with_(o.DOCS, _META)}, lab AS (SELECT * REPLACE ({PERMISSIVE_V0_SQL.replace('raw_label', 'label')} AS label) FROM meta),
v AS ("""
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, coalesce(CAST({c} AS VARCHAR), 'MISSING') AS value, label FROM lab"
        for c in ("doc_id", "domain", "grp", "toxic", "size_class", "ai_model", "decoding")
    )
    + """),
p AS (SELECT column_name, value, CAST(greatest(sum(label), count(*) - sum(label)) AS DOUBLE) / count(*) AS purity FROM v GROUP BY 1, 2),
r AS (SELECT column_name, count(*) AS unique_values, round(avg(purity), 6) AS mean_label_purity FROM p GROUP BY 1)
SELECT *, CASE WHEN mean_label_purity >= 0.95 THEN 'high' WHEN mean_label_purity >= 0.8 THEN 'medium' ELSE 'low' END AS risk
FROM r WHERE unique_values <= 80""",
)
def audit_metadata_leakage(spark, sf_dir):
    meta = docs_labeled(spark, sf_dir).select(
        "doc_id",
        F.col("label").cast("string").alias("label"),
        "domain",
        "grp",
        "toxic",
        F.floor(F.col("n_chars") / 1000).alias("size_class"),
        F.when(F.col("label") == 1, "m").otherwise("none").alias("ai_model"),
        F.when(F.col("doc_id") % 9 > 0, F.concat(F.lit("v"), F.col("doc_id") % 4)).alias("decoding"),
    )
    return audits.metadata_leakage(meta, "label")


# --- scoring with fixed coefficients --------------------------------------------------------

# Two published-style linear scorers, each with an intercept per training dataset. They stand in
# for fitted models, so that every metric can be checked exactly. Fixed values.
SCORERS = [
    ("style_a", "docs", -0.60, {"lexical_diversity": 1.8, "stopword_ratio": -4.0, "uppercase_ratio": 9.0, "avg_word_length": 0.05}),
    ("style_a", "conv", -1.10, {"lexical_diversity": 1.8, "stopword_ratio": -4.0, "uppercase_ratio": 9.0, "avg_word_length": 0.05}),
    ("style_b", "docs", 1.00, {"avg_sentence_length": -0.1, "comma_count": 0.02, "repetition_ratio": -0.5, "digit_ratio": 20.0}),
    ("style_b", "conv", 0.30, {"avg_sentence_length": -0.1, "comma_count": 0.02, "repetition_ratio": -0.5, "digit_ratio": 20.0}),
]


def _logit(intercept, weights):
    return F.lit(float(intercept)) + sum(F.lit(float(w)) * F.col(c) for c, w in weights.items())


def logit_sql(intercept, weights):
    return f"(CAST({intercept} AS DOUBLE)" + "".join(f" + CAST({w} AS DOUBLE) * {c}" for c, w in weights.items()) + ")"


def apply_scorers(features, scorers=SCORERS):
    """One row per (row, scorer): probability rounded to two decimals, so that ties occur."""
    listed = F.array(
        *[
            F.struct(
                F.lit(model).alias("detector"),
                F.lit(train).alias("train_dataset"),
                F.round(1.0 / (1.0 + F.exp(-_logit(b, w))), 2).alias("score"),
            )
            for model, train, b, w in scorers
        ]
    )
    kept = [c for c in features.columns if c not in stylometry.V2_FEATURES]
    rows = features.select(*kept, F.explode(listed).alias("_s")).select(*kept, "_s.*")
    return rows.withColumn("prediction", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def score_both(spark, sf_dir):
    """Documents and conversations, scored by every scorer."""
    both = reshape.union_all(
        [
            with_generators(docs_labeled(spark, sf_dir, heavy=True)).select("doc_id", "text", "label", "domain", "attack", "dataset_name"),
            conv_labeled(spark, sf_dir, heavy=True).select("doc_id", "text", "label", "domain", "dataset_name"),
        ]
    )
    keep = ["doc_id", "label", "domain", "attack", "dataset_name"]
    features = stylometry.add_v2_features(both, keep=keep)
    return apply_scorers(features).withColumnRenamed("dataset_name", "test_dataset")


_KEEP = "doc_id, label, domain, attack, dataset_name"
SCORED = (
    o.with_(o.DOCS, o.GENERATED, o.CONV)
    + f""", ab AS (
  SELECT doc_id, text, label, domain, attack, dataset_name FROM gen
  UNION ALL SELECT doc_id, text, label, domain, NULL, dataset_name FROM conv), {v2_sql('ab', _KEEP)},
probs AS ("""
    + " UNION ALL ".join(
        f"""SELECT doc_id, label, domain, attack, dataset_name AS test_dataset, '{m}' AS detector, '{t}' AS train_dataset,
  round(1.0 / (1.0 + exp(-{logit_sql(b, w)})), 2) AS score FROM v2"""
        for m, t, b, w in SCORERS
    )
    + """), scored AS (SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS prediction FROM probs)"""
)

BY = ["detector", "train_dataset", "test_dataset"]
_BY = ", ".join(BY)


def counts_sql(source, by, having=""):
    return f"""
k AS (SELECT {by}, count(*) AS n, count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
  count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 0 AND prediction = 0) AS tn FROM {source} GROUP BY {by} {having})"""


def _safe(a, b):
    return f"(CASE WHEN {b} = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / {b} END)"


_P1, _R1, _P0, _R0 = _safe("tp", "(tp + fp)"), _safe("tp", "(tp + fn)"), _safe("tn", "(tn + fn)"), _safe("tn", "(tn + fp)")
_F1, _F0 = _safe("2 * tp", "(2 * tp + fp + fn)"), _safe("2 * tn", "(2 * tn + fp + fn)")
BINARY_SQL = f"""round({_safe('tp + tn', 'n')}, 6) AS accuracy, round({_P1}, 6) AS precision, round({_R1}, 6) AS recall, round({_F1}, 6) AS f1"""
_MACRO3_SQL = f"""round(({_P1} + {_P0}) / 2, 6) AS macro_precision, round(({_R1} + {_R0}) / 2, 6) AS macro_recall, round(({_F1} + {_F0}) / 2, 6) AS macro_f1"""
_MACRO_SQL = f"{_MACRO3_SQL}, round(CASE WHEN tp + fn = 0 THEN {_R0} WHEN tn + fp = 0 THEN {_R1} ELSE ({_R1} + {_R0}) / 2 END, 6) AS balanced_accuracy"


def auc_sql(source, by):
    """CTE ``auc``: mid-rank formula, an independent route to the tie-aware area."""
    return f"""
mid AS (SELECT {by}, label, rank() OVER (PARTITION BY {by} ORDER BY score)
  + (count(*) OVER (PARTITION BY {by}, score) - 1) / 2.0 AS r FROM {source}),
auc AS (SELECT {by}, CASE WHEN count(*) FILTER (label = 1) > 0 AND count(*) FILTER (label = 0) > 0 THEN
  round((CAST(sum(CASE WHEN label = 1 THEN r ELSE 0 END) AS DOUBLE) - CAST(count(*) FILTER (label = 1) AS DOUBLE) * (count(*) FILTER (label = 1) + 1) / 2)
  / (CAST(count(*) FILTER (label = 1) AS DOUBLE) * count(*) FILTER (label = 0)), 6) END AS roc_auc FROM mid GROUP BY {by})"""


def using(by, left="k", right="auc"):
    return " AND ".join(f"{left}.{c.strip()} IS NOT DISTINCT FROM {right}.{c.strip()}" for c in by.split(","))


RESULTS = f"""{SCORED}, {counts_sql('scored', _BY)}, {auc_sql('scored', _BY)},
results AS (SELECT k.detector AS model, k.train_dataset, k.test_dataset, k.n, {BINARY_SQL}, roc_auc FROM k JOIN auc ON {using(_BY)})"""


def results(spark, sf_dir):
    """Result table: one row per (model, train_dataset, test_dataset)."""
    return metrics.evaluate(score_both(spark, sf_dir), BY).withColumnRenamed("detector", "model")


@query("score_linear", f"{SCORED} SELECT doc_id, label, test_dataset, detector, train_dataset, score, prediction FROM scored")
def score_linear(spark, sf_dir):
    return score_both(spark, sf_dir).select(
        "doc_id", "label", "test_dataset", "detector", "train_dataset", "score", "prediction"
    )


@query("metrics_binary", f"{SCORED}, {counts_sql('scored', _BY)} SELECT {_BY}, n, {BINARY_SQL} FROM k")
def metrics_binary(spark, sf_dir):
    return metrics.binary_metrics(score_both(spark, sf_dir), BY)


@query("metrics_macro", f"{SCORED}, {counts_sql('scored', _BY)} SELECT {_BY}, n, {_MACRO_SQL} FROM k")
def metrics_macro(spark, sf_dir):
    return metrics.macro_metrics(score_both(spark, sf_dir), BY)


@query("metrics_auc", f"{SCORED}, {auc_sql('scored', _BY + ', domain')} SELECT {_BY}, domain, roc_auc FROM auc")
def metrics_auc(spark, sf_dir):
    return metrics.roc_auc(score_both(spark, sf_dir), [*BY, "domain"])


_HOLED_SCORED = "holed AS (SELECT * REPLACE (CASE WHEN doc_id % 4 > 0 THEN domain END AS domain) FROM scored)"


@query(
    "metrics_auc_nulls",
    f"""{SCORED}, {_HOLED_SCORED}, {counts_sql('holed', _BY + ', domain')}, {auc_sql('holed', _BY + ', domain')}
SELECT {', '.join('k.' + c for c in BY)}, k.domain, n, {BINARY_SQL}, roc_auc FROM k JOIN auc ON {using(_BY + ', domain')}""",
)
def metrics_auc_nulls(spark, sf_dir):
    """Rows without a domain are a group like any other."""
    scored = score_both(spark, sf_dir).withColumn("domain", F.when(F.col("doc_id") % 4 > 0, F.col("domain")))
    return metrics.evaluate(scored, [*BY, "domain"])


@query(
    "confusion_matrix",
    f"""{SCORED}, {counts_sql('scored', _BY)}
SELECT {_BY}, true_label, predicted_label, CASE true_label * 2 + predicted_label WHEN 0 THEN tn WHEN 1 THEN fp WHEN 2 THEN fn ELSE tp END AS n
FROM k CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) c(true_label, predicted_label)""",
)
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(score_both(spark, sf_dir), BY)


@query(
    "metrics_logloss",
    f"""{SCORED} SELECT {_BY}, count(*) AS n, round(avg(CASE WHEN label = 1 THEN -ln(least(greatest(score, 1e-15), 1 - 1e-15))
ELSE -ln(1 - least(greatest(score, 1e-15), 1 - 1e-15)) END), 6) AS log_loss FROM scored GROUP BY {_BY}""",
)
def metrics_logloss(spark, sf_dir):
    return metrics.log_loss(score_both(spark, sf_dir), BY)


_SLICE = "detector, slice_column, slice_value"


@query(
    "metrics_slices",
    f"""{SCORED}, sliced AS (
  SELECT detector, label, prediction, score, 'domain' AS slice_column, domain AS slice_value FROM scored WHERE train_dataset = test_dataset
  UNION ALL SELECT detector, label, prediction, score, 'attack', attack FROM scored WHERE train_dataset = test_dataset AND attack IS NOT NULL),
{counts_sql('sliced', _SLICE, 'HAVING count(*) >= 20 AND count(DISTINCT label) = 2')}, {auc_sql('sliced', _SLICE)}
SELECT k.detector, k.slice_column, k.slice_value, k.n, {BINARY_SQL}, {_MACRO3_SQL}, roc_auc FROM k JOIN auc ON {using(_SLICE)}""",
)
def metrics_slices(spark, sf_dir):
    scored = score_both(spark, sf_dir).filter(F.col("train_dataset") == F.col("test_dataset"))
    return metrics.slice_metrics(scored)


@query(
    "error_rows",
    f"""{SCORED} SELECT doc_id, label AS true_label, prediction AS predicted_label, domain, attack, {_BY}, score FROM scored
WHERE label <> prediction""",
)
def error_rows(spark, sf_dir):
    return metrics.error_rows(score_both(spark, sf_dir))


@query(
    "rank_f1",
    f"""{RESULTS} SELECT *, row_number() OVER (PARTITION BY test_dataset ORDER BY f1 DESC, model) AS f1_rank FROM results
WHERE train_dataset = 'docs'""",
)
def rank_f1(spark, sf_dir):
    return metrics.rank_by_f1(results(spark, sf_dir).filter(F.col("train_dataset") == "docs"), by="test_dataset")


@query("best_model", f"{RESULTS} SELECT * FROM results ORDER BY f1 DESC, roc_auc DESC, model, train_dataset, test_dataset LIMIT 1")
def best_model(spark, sf_dir):
    order = [F.desc("f1"), F.desc("roc_auc"), F.asc("model"), F.asc("train_dataset"), F.asc("test_dataset")]
    return metrics.best_row(results(spark, sf_dir), order)


@query(
    "generalization_gap",
    f"""{RESULTS} SELECT a.model, a.train_dataset, a.test_dataset, a.f1 AS cross_f1, h.f1 AS in_domain_f1, round(h.f1 - a.f1, 6) AS f1_drop
FROM results a JOIN results h ON h.model = a.model AND h.train_dataset = a.train_dataset AND h.test_dataset = h.train_dataset
WHERE a.test_dataset <> a.train_dataset""",
)
def generalization_gap(spark, sf_dir):
    return metrics.generalization_gap(results(spark, sf_dir))


@query(
    "probability_band",
    f"""{SCORED} SELECT doc_id, {_BY}, score, CASE WHEN score >= 0.7 THEN 'Likely AI-generated' WHEN score >= 0.55 THEN 'Possibly AI-generated'
  WHEN score <= 0.3 THEN 'Likely human-written' WHEN score <= 0.45 THEN 'Possibly human-written' ELSE 'Uncertain' END AS band,
  CASE WHEN score >= 0.7 OR score <= 0.3 THEN 'High confidence' WHEN score >= 0.55 OR score <= 0.45 THEN 'Moderate confidence'
  ELSE 'Low confidence' END AS confidence FROM scored""",
)
def probability_band(spark, sf_dir):
    banded = metrics.probability_band(score_both(spark, sf_dir))
    return banded.select("doc_id", *BY, "score", "band", "confidence")


@query(
    "union_results",
    f"""{RESULTS} SELECT model, train_dataset, test_dataset, f1, roc_auc, CAST(NULL AS VARCHAR) AS split FROM results WHERE test_dataset = 'docs'
UNION ALL SELECT model, NULL, test_dataset, f1, NULL, 'challenge' FROM results WHERE test_dataset = 'conv'""",
)
def union_results(spark, sf_dir):
    """Two result tables with different columns, concatenated by name."""
    table = results(spark, sf_dir)
    one = table.filter(F.col("test_dataset") == "docs").select("model", "train_dataset", "test_dataset", "f1", "roc_auc")
    two = table.filter(F.col("test_dataset") == "conv").select("model", "test_dataset", "f1", F.lit("challenge").alias("split"))
    return reshape.union_all([one, two])


_COLUMNS = ["model", "train_dataset", "test_dataset", "accuracy", "precision", "recall", "f1", "roc_auc"]


def _cells_sql():
    cells = [c if c in _COLUMNS[:3] else f"coalesce(printf('%.4f', round({c}, 4)), 'nan')" for c in _COLUMNS]
    return "'| ' || " + " || ' | ' || ".join(cells) + " || ' |'"


@query(
    "report_lines",
    f"""{RESULTS}, l AS (SELECT row_number() OVER (ORDER BY model, train_dataset, test_dataset) + 1 AS line_no, {_cells_sql()} AS line FROM results)
SELECT 0 AS line_no, '| {" | ".join(_COLUMNS)} |' AS line UNION ALL SELECT 1, '| {" | ".join(["---"] * len(_COLUMNS))} |'
UNION ALL SELECT line_no, line FROM l""",
)
def report_lines(spark, sf_dir):
    return metrics.report_lines(results(spark, sf_dir), [*_COLUMNS, "absent"], ["model", "train_dataset", "test_dataset"])


_DIST = """string_agg(label || '=' || share, '; ' ORDER BY label) FROM (SELECT label, printf('%.3f', round(CAST(count(*) AS DOUBLE) /
  sum(count(*)) OVER (), 3)) AS share FROM assigned WHERE split_name = sides.split_name AND split = '{side}' GROUP BY label)"""


@query(
    "experiment_rows",
    f"""{SCORED}, assigned AS (
  SELECT 'stratified' AS split_name, doc_id, label, split FROM ({SPLIT_ORACLES['split_stratified']})
  UNION ALL SELECT 'three_way', doc_id, label, split FROM ({SPLIT_ORACLES['split_three_way']})),
held AS (SELECT s.*, a.split_name FROM scored s JOIN assigned a ON a.doc_id = s.doc_id AND a.split = 'test'
         WHERE s.test_dataset = 'docs' AND s.train_dataset = 'docs'),
{counts_sql('held', 'split_name, detector')}, {auc_sql('held', 'split_name, detector')},
dist AS (SELECT split_name, split, string_agg(label || '=' || share, '; ' ORDER BY label) AS d FROM (
  SELECT split_name, split, label, printf('%.3f', round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY split_name, split), 3)) AS share
  FROM assigned GROUP BY split_name, split, label) GROUP BY split_name, split),
sides AS (SELECT split_name, count(*) FILTER (split = 'train') AS train_size, count(*) FILTER (split = 'test') AS test_size FROM assigned GROUP BY 1)
SELECT k.split_name, k.detector, {BINARY_SQL}, roc_auc, train_size, test_size, tr.d AS train_label_distribution, te.d AS test_label_distribution
FROM k JOIN auc ON k.split_name = auc.split_name AND k.detector = auc.detector JOIN sides ON sides.split_name = k.split_name
JOIN dist tr ON tr.split_name = k.split_name AND tr.split = 'train' JOIN dist te ON te.split_name = k.split_name AND te.split = 'test'""",
)
def experiment_rows(spark, sf_dir):
    """Experiment rows of the fixed scorers on two splits of the labelled documents."""
    docs = docs_labeled(spark, sf_dir, heavy=True).select("doc_id", "text", "label", "domain")
    narrow = docs_labeled(spark, sf_dir).select("doc_id", "label")
    assigned = reshape.union_all(
        [
            splits.split_stratified(narrow).withColumn("split_name", F.lit("stratified")),
            splits.split_three_way(narrow).withColumn("split_name", F.lit("three_way")),
        ]
    )
    features = stylometry.add_v2_features(docs, keep=["doc_id"])
    scored = apply_scorers(features, [s for s in SCORERS if s[1] == "docs"])
    test = scored.join(assigned.filter(F.col("split") == "test"), "doc_id")
    return metrics.experiment_rows(test, assigned, ["split_name", "detector"])

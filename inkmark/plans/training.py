"""Registered queries that fit models. Fitted numbers have no SQL twin; ``fit_checks`` holds what SQL can check of them."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from inkmark.functions import ngrams
from inkmark.models import training as t
from inkmark.models.vectors import FeaturePlan, embedding_style_vectors, embedding_vectors, style_columns, with_style
from inkmark.operators import lexical, metrics, reshape, splits
from inkmark.functions.labels import challenge
from inkmark.session import cut_lineage, scratch_path
from inkmark.plans import oracle as o
from inkmark.plans.splitting import ORACLES as SPLIT_ORACLES
from inkmark.plans.splitting import QUERIES as SPLIT_QUERIES
from inkmark.plans.splitting import stratified_quota_sql
from inkmark.sources.bindings import conv_labeled, docs_labeled, emb_labeled, table

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def _sides(rows, recipes=()):
    """A materialised 80/20 split of the labelled rows, with the stylometry that the recipes read."""
    split = splits.split_stratified(rows.select("doc_id", "text", "label"))
    split = with_style(split, [r.plan() for r in recipes]) if any(r.plan().style for r in recipes) else cut_lineage(split)
    return split.filter(F.col("split") == "train"), split.filter(F.col("split") == "test")


def _fit_and_evaluate(recipes, rows):
    train, test = _sides(rows, recipes)
    parts, known = [], {}
    for recipe in recipes:
        scored = t.train(recipe, train, known).score(test, ["doc_id", "label"])
        parts.append(scored.withColumn("model", F.lit(recipe.name)))
    return metrics.evaluate(reshape.union_all(parts), ["model"], macro=True)


def _single(name, recipe):
    QUERIES[name] = lambda spark, sf_dir: _fit_and_evaluate([recipe], conv_labeled(spark, sf_dir, heavy=True))


for _i, _recipe in enumerate(t.CURRENT, start=1):
    _single(f"train_m{_i}", _recipe)


@query("train_m5")
def train_m5(spark, sf_dir):
    """The five earlier detectors on conversations."""
    return _fit_and_evaluate(t.EARLIER, conv_labeled(spark, sf_dir, heavy=True))


@query("train_m6")
def train_m6(spark, sf_dir):
    """The benchmark baselines on the labelled documents."""
    return _fit_and_evaluate(t.BENCHMARK, docs_labeled(spark, sf_dir, heavy=True))


@query("train_m7")
def train_m7(spark, sf_dir):
    """Sigmoid-calibrated SVM on conversations."""
    return _fit_and_evaluate([t.EARLIER[2]], conv_labeled(spark, sf_dir, heavy=True))


@query("train_m8")
def train_m8(spark, sf_dir):
    """Epoch history of the gradient-trained detector."""
    rows = splits.split_stratified(conv_labeled(spark, sf_dir, heavy=True).select("doc_id", "text", "label"))
    rows = rows.withColumn("split", F.when(F.col("split") == "test", "val").otherwise("train"))
    return t.train_epochs(cut_lineage(rows))


@query("train_m8_best")
def train_m8_best(spark, sf_dir):
    """The epoch with the best validation F1."""
    return t.best_epoch(train_m8(spark, sf_dir))


def _fit_vectors(name, vectors, rows):
    """Logistic regression on vectors built from the split rows, evaluated on the test side."""
    train = rows.filter(F.col("split") == "train")
    recipe = t.Recipe(name, FeaturePlan, "logistic", 2000)
    model = t.fit_classifier(recipe, vectors(t.with_class_weight(train), train, ["doc_id", "label", "class_weight"]))
    test = vectors(rows.filter(F.col("split") == "test"), train, ["doc_id", "label"])
    return t.probability(model, test, ["doc_id", "label"]).withColumn("model", F.lit(recipe.name))


@query("train_m9")
def train_m9(spark, sf_dir):
    """Logistic regression on precomputed embeddings."""
    rows = cut_lineage(splits.split_stratified(emb_labeled(spark, sf_dir)))
    return metrics.evaluate(_fit_vectors("embedding_logistic", embedding_vectors, rows), ["model"], macro=True)


@query("train_m9_style")
def train_m9_style(spark, sf_dir):
    """The same beside stylometry: every vector goes with the document of its id."""
    texts = table(spark, sf_dir, "documents", heavy=True).select("doc_id", "text")
    rows = with_style(splits.split_stratified(emb_labeled(spark, sf_dir).join(texts, "doc_id")), [FeaturePlan(style="v1")])
    return metrics.evaluate(_fit_vectors("embedding_style_logistic", embedding_style_vectors, rows), ["model"], macro=True)


@query("cross_dataset")
def cross_dataset(spark, sf_dir):
    """Documents to conversations and back, with the generalisation gap of each model."""
    docs_train, docs_test = _sides(docs_labeled(spark, sf_dir, heavy=True), t.CURRENT)
    conv_train, conv_test = _sides(conv_labeled(spark, sf_dir, heavy=True), t.CURRENT)
    columns = ["text", "label", *style_columns(docs_test)]
    tests = reshape.union_all(
        [
            docs_test.select("doc_id", *columns, F.lit("docs").alias("test_dataset")),
            # ids of the two sets overlap
            conv_test.select((-F.col("doc_id") - 1).alias("doc_id"), *columns, F.lit("conv").alias("test_dataset")),
        ]
    )
    results = t.cross_dataset({"docs": docs_train, "conv": conv_train}, tests)
    return metrics.generalization_gap(cut_lineage(results))


@query("feature_importance")
def feature_importance(spark, sf_dir):
    train, _ = _sides(conv_labeled(spark, sf_dir, heavy=True), [t.CURRENT[2]])
    return t.feature_importance(t.train(t.CURRENT[2], train))


@query("model_roundtrip")
def model_roundtrip(spark, sf_dir):
    """A fitted detector, saved and loaded, scores the test rows."""
    train, test = _sides(conv_labeled(spark, sf_dir, heavy=True))
    path = scratch_path(spark, "detector")
    t.save_detector(t.train(t.CURRENT[0], train), path)
    return t.load_detector(spark, t.CURRENT[0], path).score(test, ["doc_id", "label"])


@query("challenge_eval")
def challenge_eval(spark, sf_dir):
    """Detectors fitted on four fifths of the conversations meet a challenge set never trained on."""
    turns = conv_labeled(spark, sf_dir, heavy=True)
    fifth = F.col("prompt_group") % 5 == 0
    plans = [r.plan() for r in t.EARLIER]
    train = with_style(turns.filter(~fifth).select("doc_id", "text", "label"), plans)
    raw = turns.filter(fifth).withColumn("raw", F.when(F.col("label") == 1, "AI").otherwise("human"))
    held = with_style(raw.select("doc_id", "text", challenge(F.col("raw")).alias("label")), plans)
    parts, known = [], {}
    for recipe in t.EARLIER:
        scored = t.train(recipe, train, known).score(held, ["doc_id", "label"])
        parts.append(scored.withColumns({"split": F.lit("challenge"), "model": F.lit(recipe.name)}))
    return metrics.evaluate(reshape.union_all(parts), ["split", "model"])


def _check(name, recipe, train, test):
    scored = t.train(recipe, train).score(test, ["doc_id", "label"])
    return metrics.evaluate(scored.withColumn("check", F.lit(name)), ["check"])


@query("sanity_label_shuffle_model")
def sanity_label_shuffle_model(spark, sf_dir):
    """A text model fitted on shuffled labels; chance level is expected."""
    train, test = _sides(conv_labeled(spark, sf_dir, heavy=True))
    shuffled = splits.shuffle_labels(train).drop("label").withColumnRenamed("shuffled_label", "label")
    recipe = t.Recipe("label_shuffle", lambda: FeaturePlan([ngrams.SHUFFLE_CHECK]), "logistic", 1500)
    return _check("label_shuffle_text_model", recipe, cut_lineage(shuffled.select("doc_id", "text", "label")), test)


@query("sanity_length_only")
def sanity_length_only(spark, sf_dir):
    """Only the four length features."""
    train, test = _sides(conv_labeled(spark, sf_dir, heavy=True))
    return _check("length_only_model", t.Recipe("length", lambda: FeaturePlan(style="length"), "logistic", 1500), train, test)


@query("sanity_prompt_only")
def sanity_prompt_only(spark, sf_dir):
    """Only the prompt: the first user turn of each conversation."""
    turns = conv_labeled(spark, sf_dir, heavy=True)
    prompts = turns.filter(F.col("label") == 0).groupBy("prompt_group").agg(F.min_by("text", "doc_id").alias("prompt"))
    rows = turns.join(prompts, "prompt_group", "left").select(
        "doc_id", "label", F.coalesce("prompt", F.lit("missing")).alias("text")
    )
    train, test = _sides(rows)
    recipe = t.Recipe("prompt", lambda: FeaturePlan([ngrams.PROMPT_CHECK]), "logistic", 1500)
    return _check("prompt_only_model", recipe, train, test)


_CONV_SPLIT = f"""{o.with_(o.CONV)}, {stratified_quota_sql('conv')},
r AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || CAST(doc_id AS VARCHAR))) AS rn FROM conv),
sides AS (SELECT r.label, rn <= quota AS is_test FROM r JOIN q_conv ON r.label = q_conv.label)"""


@query(
    "fit_checks",
    f"""{_CONV_SPLIT} SELECT model, count(*) FILTER (NOT is_test) AS train_size, count(*) FILTER (is_test) AS test_size,
  count(*) FILTER (is_test AND label = 1) AS test_positive,
  round(count(*) FILTER (NOT is_test) / (2.0 * count(*) FILTER (NOT is_test AND label = 0)), 6) AS weight_human,
  round(count(*) FILTER (NOT is_test) / (2.0 * count(*) FILTER (NOT is_test AND label = 1)), 6) AS weight_ai,
  true AS fits_training_rows, true AS same_after_reload
FROM sides CROSS JOIN (VALUES ('word_logistic'), ('style_logistic'), ('word_svm_calibrated')) m(model) GROUP BY model""",
)
def fit_checks(spark, sf_dir):
    """Sizes and weights of three fits, whether each beats the majority class on its training rows, and reloading."""
    recipes = (t.CURRENT[0], t.EARLIER[3], t.EARLIER[2])
    train, test = _sides(conv_labeled(spark, sf_dir, heavy=True), recipes)
    sizes = train.agg(F.count(F.lit(1)).alias("train_size")).first()
    tested = test.agg(F.count(F.lit(1)).alias("test_size"), F.count_if(F.col("label") == 1).alias("test_positive")).first()
    weights = {r["label"]: r["weight"] for r in lexical.class_weights(train).collect()}
    majority = max(1 / (2 * w) for w in weights.values())
    rows, known = [], {}
    for recipe in recipes:
        detector = t.train(recipe, train, known)
        right = detector.score(train, ["doc_id", "label"]).agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
        path = scratch_path(spark, "detector")
        t.save_detector(detector, path)
        reloaded = t.load_detector(spark, recipe, path).score(test, ["doc_id"]).withColumnRenamed("score", "again")
        apart = detector.score(test, ["doc_id"]).join(reloaded, "doc_id").agg(F.max(F.abs(F.col("score") - F.col("again")))).first()[0]
        rows.append((recipe.name, sizes["train_size"], *tested, weights[0], weights[1], right > majority, apart < 1e-9))
    schema = "model string, train_size bigint, test_size bigint, test_positive bigint, weight_human double, weight_ai double, fits_training_rows boolean, same_after_reload boolean"
    return spark.createDataFrame(rows, schema)


@query(
    "fit_sigmoid",
    f"""WITH RECURSIVE {o.with_(o.DOCS).removeprefix('WITH ')},
m AS (SELECT (n_chars % 97) / 97.0::DOUBLE - 0.5 + 0.3 * label AS x, label FROM docs),
c AS (SELECT count(*) FILTER (label = 1) AS n1, count(*) FILTER (label <> 1) AS n0 FROM m),
d AS (SELECT x, CASE WHEN label = 1 THEN (n1 + 1.0::DOUBLE) / (n1 + 2) ELSE 1.0::DOUBLE / (n0 + 2) END AS t FROM m, c),
fit AS (SELECT 0 AS i, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b
  UNION ALL SELECT i + 1, a + (hb * ga - hab * gb) / (ha * hb - hab * hab), b + (ha * gb - hab * ga) / (ha * hb - hab * hab)
  FROM (SELECT i, a, b, sum((t - p) * x) AS ga, sum(t - p) AS gb, sum(p * (1 - p) * x * x) AS ha, sum(p * (1 - p) * x) AS hab, sum(p * (1 - p)) AS hb
    FROM (SELECT i, a, b, x, t, 1 / (1 + exp(-(a * x + b))) AS p FROM fit, d WHERE i < 20) GROUP BY i, a, b))
SELECT n1 AS n_one, n0 AS n_zero, round(a, 5) AS slope, round(b, 5) AS intercept FROM fit, c WHERE i = 20""",
)
def fit_sigmoid(spark, sf_dir):
    """Slope and intercept of a sigmoid with smoothed targets over a margin that overlaps between the classes."""
    margin = (F.col("n_chars") % 97) / F.lit(97.0) - 0.5 + 0.3 * F.col("label")
    rows = docs_labeled(spark, sf_dir).select("label", array_to_vector(F.array(margin)).alias("features"))
    slope, intercept = t.fit_sigmoid(rows)
    sizes = rows.agg(F.count_if(F.col("label") == 1).alias("n_one"), F.count_if(F.col("label") != 1).alias("n_zero"))
    return sizes.select("n_one", "n_zero", F.round(F.lit(slope), 5).alias("slope"), F.round(F.lit(intercept), 5).alias("intercept"))


MATRIX_SPLITS = (
    "split_stratified", "split_three_way", "split_source_grouped", "split_domain_holdout", "split_generator_holdout_disjoint",
    "split_attack_holdout_disjoint",
)


def _assigned(spark, sf_dir):
    """(split_name, doc_id, label, split) of all splits of the documents, one name per hold-out."""
    parts = []
    for name in MATRIX_SPLITS:
        rows = SPLIT_QUERIES[name](spark, sf_dir)
        label = F.concat_ws(":", F.lit(name), *([F.col("holdout")] if "holdout" in rows.columns else []))
        parts.append(rows.select(label.alias("split_name"), "doc_id", "label", "split"))
    return cut_lineage(reshape.union_all(parts))


def _matrix(spark, sf_dir, recipes):
    """Every recipe fitted on the train side of every split; scored test rows and the assignments. Texts join last.

    Every document takes part in all splits, so its stylometry is computed once for all of them.
    """
    assigned = _assigned(spark, sf_dir)
    texts = table(spark, sf_dir, "documents", heavy=True).select("doc_id", "text")
    texts = with_style(texts.join(assigned.select("doc_id").distinct(), "doc_id", "left_semi"), [r.plan() for r in recipes])
    parts = []
    for (name,) in assigned.select("split_name").distinct().orderBy("split_name").collect():
        own = assigned.filter(F.col("split_name") == name)
        sides = [own.filter(F.col("split") == side).select("doc_id", "label").join(texts, "doc_id") for side in ("train", "test")]
        known: dict = {}
        for recipe in recipes:
            scored = t.train(recipe, sides[0], known).score(sides[1], ["doc_id", "label"])
            parts.append(scored.withColumns({"split_name": F.lit(name), "model": F.lit(recipe.name)}))
    return cut_lineage(reshape.union_all(parts)), assigned


@query("experiment_matrix")
def experiment_matrix(spark, sf_dir):
    """Model by split: sizes, label distributions and metrics of a stylometric and a word model on every split and hold-out."""
    scored, assigned = _matrix(spark, sf_dir, (t.EARLIER[3], t.CURRENT[0]))
    return metrics.experiment_rows(scored, assigned, ["split_name", "model"])


def _matrix_sql():
    parts = []
    for name in MATRIX_SPLITS:
        label = f"'{name}:' || holdout" if "holdout" in name else f"'{name}'"
        parts.append(f"SELECT {label} AS split_name, label, split FROM ({SPLIT_ORACLES[name]})")
    share = """(SELECT string_agg(label || '=' || share, '; ' ORDER BY label) FROM (SELECT label, printf('%.3f', round(CAST(count(*) AS DOUBLE) /
  sum(count(*)) OVER (), 3)) AS share FROM assigned WHERE split_name = sides.split_name AND split = '{side}' GROUP BY label))"""
    return f"""WITH assigned AS ({' UNION ALL '.join(parts)}),
sides AS (SELECT split_name, count(*) FILTER (split = 'train') AS train_size, count(*) FILTER (split = 'test') AS test_size FROM assigned GROUP BY split_name)
SELECT split_name, 'style_logistic' AS model, train_size, test_size, test_size AS n_scored, {share.format(side='train')} AS train_label_distribution,
  {share.format(side='test')} AS test_label_distribution FROM sides"""


@query("experiment_matrix_sizes", _matrix_sql())
def experiment_matrix_sizes(spark, sf_dir):
    """What SQL can check of the matrix: sizes, label distributions, and that each fitted model scored every test row."""
    scored, assigned = _matrix(spark, sf_dir, (t.EARLIER[3],))
    rows = metrics.experiment_rows(scored, assigned, ["split_name", "model"])
    counted = scored.groupBy("split_name", "model").agg(F.count(F.lit(1)).alias("n_scored"))
    columns = ["train_size", "test_size", "n_scored", "train_label_distribution", "test_label_distribution"]
    return rows.join(counted, ["split_name", "model"]).select("split_name", "model", *columns)

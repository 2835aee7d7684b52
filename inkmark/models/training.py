"""Training, calibration, scoring and persistence of the detectors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import (
    LogisticRegression,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmark.functions import ngrams
from inkmark.models.forest import Forest
from inkmark.models.margins import Blocks, Margin, add_margins, fit_blocks, fit_squared_hinge, logistic_gradient
from inkmark.models.vectors import FeaturePlan, FittedFeatures, assemble, feature_cells, fit_features, style_values, term_cells
from inkmark.operators import lexical, metrics
from inkmark.operators.quota import ceil_share, with_thresholds
from inkmark.session import cut_lineage, hold, stored

SEED = 42
FOLDS = 3
TOLERANCE = 1e-4
# Training rows per task; this sizes the tasks of an optimizer step and changes no result.
ROWS_PER_TASK = 10_000


@dataclass(frozen=True)
class Recipe:
    """A named detector: its features and its classifier."""

    name: str
    plan: Callable[[], FeaturePlan]
    classifier: str
    max_iter: int = 1000
    trees: int = 300
    max_depth: int = 30


CURRENT = (
    Recipe("word_logistic", lambda: FeaturePlan([ngrams.WORD_STOP]), "logistic"),
    Recipe("char_svm", lambda: FeaturePlan([ngrams.CHAR]), "svm"),
    Recipe("style_forest", lambda: FeaturePlan(style="v2", scaled=False), "forest"),
    Recipe("hybrid_svm", lambda: FeaturePlan([ngrams.WORD_STOP, ngrams.CHAR], style="v2"), "svm"),
)
EARLIER = (
    Recipe("word_logistic_v0", lambda: FeaturePlan([ngrams.WORD_MAXDF]), "logistic", 2000),
    Recipe("char_wb_logistic", lambda: FeaturePlan([ngrams.CHAR_WB]), "logistic", 2000),
    Recipe("word_svm_calibrated", lambda: FeaturePlan([ngrams.WORD_MAXDF]), "svm_calibrated"),
    Recipe("style_logistic", lambda: FeaturePlan(style="v1"), "logistic", 2000),
    Recipe("hybrid_logistic", lambda: FeaturePlan([ngrams.WORD_MAXDF, ngrams.CHAR_WB], style="v1"), "logistic", 2500),
)
BENCHMARK = (
    Recipe("word_logistic_wide", lambda: FeaturePlan([ngrams.WORD_WIDE]), "logistic", 2000),
    Recipe("char_wb_logistic_wide", lambda: FeaturePlan([ngrams.CHAR_WB_WIDE]), "logistic", 2000),
    Recipe("word_svm_calibrated_wide", lambda: FeaturePlan([ngrams.WORD_WIDE]), "svm_calibrated"),
)


def with_class_weight(train: DataFrame) -> DataFrame:
    """Balanced weight per row; two classes give a two-row table."""
    weights = lexical.class_weights(train).select("label", F.col("weight").alias("class_weight"))
    return train.join(F.broadcast(weights), "label")


def _logistic(n: int, max_iter: int) -> LogisticRegression:
    # the balanced weights sum to n, so C = 1 is a penalty of 1/n
    return LogisticRegression(
        regParam=1.0 / n, elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=TOLERANCE,
        weightCol="class_weight",
    )


def _forest(recipe: Recipe) -> RandomForestClassifier:
    """Spark ML's forest, whose trees the driver holds; detectors grow ``Forest``. Every row keeps its node in every tree, so a level of deep trees need not walk them from the root again."""
    return RandomForestClassifier(
        numTrees=recipe.trees, maxDepth=recipe.max_depth, featureSubsetStrategy="sqrt", seed=SEED,
        weightCol="class_weight", maxMemoryInMB=1024, cacheNodeIds=True,
    )


def probability(model, vectors: DataFrame, keep: list[str]) -> DataFrame:
    """Score and prediction: class-1 probability where the model has one, else the margin."""
    out = model.transform(vectors)
    column = "probability" if "probability" in out.columns else "rawPrediction"
    return out.select(
        *keep, vector_to_array(column)[1].alias("score"), F.col("prediction").cast("int").alias("prediction")
    )


def _stratified_folds(vectors: DataFrame, key: str) -> DataFrame:
    """``_fold``: equal parts of every class in hash order, so a small class is in each of them."""
    counts = vectors.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    cuts = [f"_cut{i}" for i in range(1, FOLDS)]
    quotas = counts.select("label", *[ceil_share(F.col("n"), i, FOLDS).alias(c) for i, c in enumerate(cuts, start=1)])
    placed = with_thresholds(vectors, ["label"], [key], quotas, cuts, seed=SEED + 2)
    fold = sum([(F.col("_h") > F.col(c)).cast("int") for c in cuts], F.lit(0))
    return placed.withColumn("_fold", fold).drop("_h", *cuts)


def fit_sigmoid(margins: DataFrame) -> tuple[float, float]:
    """Slope and intercept of the sigmoid over the one-column ``features`` for smoothed targets.

    The target is (n1 + 1) / (n1 + 2) for the n1 rows of class 1 and 1 / (n0 + 2) for the others. A row with target t is the
    row of class 1 with weight t and that of class 0 with weight 1 - t; only two numbers leave the cluster.
    """
    n = margins.agg(F.count_if(F.col("label") == 1).alias("one"), F.count_if(F.col("label") != 1).alias("zero")).first()
    target = F.when(F.col("label") == 1, (n["one"] + 1.0) / (n["one"] + 2.0)).otherwise(1.0 / (n["zero"] + 2.0))
    both = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), target.alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - target).alias("weight"))))
    soft = margins.select("features", both.alias("t")).select("features", "t.label", "t.weight")
    sigmoid = LogisticRegression(regParam=0.0, standardization=False, maxIter=500, tol=1e-13, weightCol="weight").fit(soft)
    return float(sigmoid.coefficients[0]), float(sigmoid.intercept)


@dataclass
class Machine:
    """One linear SVM; its score is the margin."""

    margin: Margin

    @classmethod
    def fit(cls, rows: DataFrame, n_features: int, max_iter: int = 1000) -> Machine:
        return cls(*fit_squared_hinge(rows.withColumn("_fold", F.lit(0)), n_features, max_iter=max_iter, tolerance=TOLERANCE))

    def score(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        out = add_margins(rows, [self.margin], keep).select(*keep, F.col("margins")[0].alias("score"))
        return out.withColumn("prediction", F.when(F.col("score") > 0, 1).otherwise(0))


@dataclass
class Logistic:
    """Logistic regression; its score is the probability of class 1."""

    margin: Margin

    @classmethod
    def fit(cls, rows: DataFrame, n_features: int, max_iter: int = 1000) -> Logistic:
        """Balanced weights sum to the number of rows, so the penalty |w|^2 / 2 beside the summed loss is C = 1."""
        blocks = Blocks(rows.withColumn("_fold", F.lit(0)), n_features)
        machines = fit_blocks(blocks, (-1,), max_iter, TOLERANCE, logistic=True)
        blocks.unpersist()
        return cls(*machines)

    def score(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        out = add_margins(rows, [self.margin], keep).withColumn("_m", F.col("margins")[0])
        prediction = F.when(F.col("_m") > 0, 1).otherwise(0).alias("prediction")
        return out.select(*keep, (1.0 / (1.0 + F.exp(-F.col("_m")))).alias("score"), prediction)


@dataclass
class SigmoidCalibrated:
    """Three linear SVMs, each with a sigmoid fitted on the fold it has not seen; mean of three."""

    members: list[tuple[Margin, float, float]]

    @classmethod
    def fit(cls, rows: DataFrame, n_features: int, key: str = "doc_id", max_iter: int = 1000) -> SigmoidCalibrated:
        """The three are fitted in the same passes over the rows; ``_fold``, where missing, is made from the key."""
        blocks = Blocks(rows if "_fold" in rows.columns else _stratified_folds(rows, key), n_features)
        machines = fit_blocks(blocks, tuple(range(FOLDS)), max_iter, TOLERANCE)
        margins = hold(blocks.margins(machines))
        members = []
        for i, machine in enumerate(machines):
            own = margins.filter(F.col("_fold") == i).select("label", array_to_vector(F.array(F.col("margins")[i])).alias("features"))
            members.append((machine, *fit_sigmoid(own)))
        margins.unpersist()
        blocks.unpersist()
        return cls(members)

    def score(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """All members are applied in one pass over the rows."""
        placed = add_margins(rows, [m for m, _, _ in self.members], keep)
        columns = []
        for i, (_, slope, intercept) in enumerate(self.members):
            columns.append(1.0 / (1.0 + F.exp(-(F.lit(slope) * F.col("margins")[i] + F.lit(intercept)))))
        mean = sum(columns[1:], columns[0]) / F.lit(float(len(columns)))
        return placed.select(*keep, mean.alias("score")).withColumn(
            "prediction", F.when(F.col("score") >= 0.5, 1).otherwise(0)
        )


LINEAR = {"svm": Machine, "logistic": Logistic, "svm_calibrated": SigmoidCalibrated}


@dataclass
class Detector:
    """A fitted detector: features and classifier."""

    recipe: Recipe
    features: FittedFeatures
    model: object

    def score(self, docs: DataFrame, keep: list[str]) -> DataFrame:
        if isinstance(self.model, (Machine, Logistic, SigmoidCalibrated)):
            return self.model.score(feature_cells(docs, self.features, keep), keep)
        if isinstance(self.model, Forest):
            return self.model.score(style_values(docs, self.features, keep), keep)
        return probability(self.model, assemble(docs, self.features, keep), keep)


def fit_classifier(recipe: Recipe, vectors: DataFrame):
    """Fit on vectors with ``label`` and ``class_weight``; they are held for the iterations."""
    held = hold(vectors)
    n = held.count()
    # every optimizer step is one job; small training sets pay for tasks, not for rows
    tasks = max(1, min(held.rdd.getNumPartitions(), -(-n // ROWS_PER_TASK)))
    rows = held.coalesce(tasks)
    if recipe.classifier == "logistic":
        model = _logistic(n, recipe.max_iter).fit(rows)
    elif recipe.classifier == "forest":
        model = _forest(recipe).fit(rows)
    else:
        raise ValueError(f"unknown classifier {recipe.classifier}")
    held.unpersist()
    return model


def train(recipe: Recipe, train_rows: DataFrame, known: dict | None = None) -> Detector:
    """Fit features and classifier on rows with doc_id, text and label.

    ``known`` keeps the vocabularies of these rows for other recipes that read the same terms.
    """
    fitted = fit_features(train_rows, recipe.plan(), known=known)
    keep, weighted = ["doc_id", "label", "class_weight"], with_class_weight(train_rows)
    if recipe.classifier in LINEAR:
        # rows become compact blocks as they are made; folds follow from ids and labels, before there are features
        kind = LINEAR[recipe.classifier]
        if kind is SigmoidCalibrated:
            weighted, keep = _stratified_folds(weighted, "doc_id"), [*keep, "_fold"]
        return Detector(recipe, fitted, kind.fit(feature_cells(weighted, fitted, keep), fitted.size, max_iter=recipe.max_iter))
    if recipe.classifier == "forest" and not fitted.plan.specs:
        rows = style_values(weighted, fitted, keep)
        return Detector(recipe, fitted, Forest.fit(rows, fitted.size, recipe.trees, recipe.max_depth, SEED))
    return Detector(recipe, fitted, fit_classifier(recipe, assemble(weighted, fitted, keep)))


def cross_dataset(
    train_sets: dict[str, DataFrame], tests: DataFrame, recipes: tuple[Recipe, ...] = CURRENT
) -> DataFrame:
    """Every model fitted once per training set and scored on all test sets in one pass.

    ``tests`` carries ``test_dataset``; document ids must be unique across test sets.
    """
    keep = ["doc_id", "label", "test_dataset"]
    scored = []
    for train_name, rows in train_sets.items():
        known: dict = {}
        for recipe in recipes:
            part = train(recipe, rows, known).score(tests, keep)
            scored.append(
                part.withColumns({"model": F.lit(recipe.name), "train_dataset": F.lit(train_name)}).drop("doc_id")
            )
    union = scored[0]
    for part in scored[1:]:
        union = union.unionByName(part)
    return metrics.evaluate(union, ["model", "train_dataset", "test_dataset"])


def feature_importance(detector: Detector, top: int = 15) -> DataFrame:
    """Most important features of a forest; as many rows as the model has features."""
    spark = SparkSession.getActiveSession()
    values = detector.model.importances().tolist()
    rows = list(zip(detector.features.style_names, values))
    table = spark.createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature").limit(top)


# --- persistence --------------------------------------------------------------------------


def save_detector(detector: Detector, path: str) -> None:
    """Classifier through Spark ML, vocabulary and scaler as tables."""
    fitted = detector.features
    if fitted.vocabulary is not None:
        fitted.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
    if fitted.stats is not None:
        fitted.stats.write.mode("overwrite").parquet(f"{path}/scaler")
    if isinstance(detector.model, (Machine, Logistic, SigmoidCalibrated)):
        spark = SparkSession.getActiveSession()
        members = detector.model.members if isinstance(detector.model, SigmoidCalibrated) else [(detector.model.margin, None, None)]
        rows = [(i, m.weights.tolist(), m.bias, slope, intercept) for i, (m, slope, intercept) in enumerate(members)]
        schema = "i int, weights array<double>, bias double, slope double, intercept double"
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{path}/margins")
    elif isinstance(detector.model, Forest):
        detector.model.save(path)
    else:
        detector.model.write().overwrite().save(f"{path}/classifier")


def load_detector(spark: SparkSession, recipe: Recipe, path: str) -> Detector:
    plan = recipe.plan()
    vocabulary = spark.read.parquet(f"{path}/vocabulary") if plan.specs else None
    stats = spark.read.parquet(f"{path}/scaler") if plan.style and plan.scaled else None
    fitted = FittedFeatures(plan, vocabulary, vocabulary.count() if plan.specs else 0, stats)
    if recipe.classifier in LINEAR:
        rows = spark.read.parquet(f"{path}/margins").orderBy("i").collect()
        members = [(Margin(np.array(r["weights"]), r["bias"]), r["slope"], r["intercept"]) for r in rows]
        model = SigmoidCalibrated(members) if recipe.classifier == "svm_calibrated" else LINEAR[recipe.classifier](members[0][0])
        return Detector(recipe, fitted, model)
    if plan.specs:
        return Detector(recipe, fitted, RandomForestClassificationModel.load(f"{path}/classifier"))
    return Detector(recipe, fitted, Forest.load(spark, path))


# --- epoch training -----------------------------------------------------------------------


def train_epochs(
    rows: DataFrame, spec: ngrams.TermSpec = ngrams.WORD_MAXDF, epochs: int = 25, alpha: float = 1e-5, rate: float = 4.0
) -> DataFrame:
    """Class-weighted logistic loss, one full-batch step per epoch, losses and metrics after each.

    ``rows`` has doc_id, text, label and split (train/val). A step is one pass over compact blocks of rows; only its gradient,
    whose length is the vocabulary's limit, reaches the driver. All epochs are scored in one pass at the end.
    """
    train_rows = rows.filter(F.col("split") == "train")
    fitted = fit_features(train_rows, FeaturePlan([spec]))
    keep = ["doc_id", "label", "class_weight", "_fold"]
    weights_of = lexical.class_weights(train_rows).select("label", F.col("weight").alias("class_weight"))
    sides = rows.join(F.broadcast(weights_of), "label").withColumn("_fold", F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1))
    placed = lexical.by_document(sides.filter(F.col("_fold").isNotNull()).select(*keep, "text"))
    blocks = Blocks(term_cells(placed, fitted, keep), max(fitted.n_terms, 1), np.float64)
    n = blocks.sizes[0]
    weights, bias, steps = np.zeros(blocks.n_features), 0.0, []
    for _ in range(epochs):
        gradient = logistic_gradient(blocks, weights, bias) / max(n, 1)
        weights = weights * (1.0 - rate * alpha) - rate * gradient[:-1]
        bias -= rate * float(gradient[-1])
        steps.append(Margin(weights, bias))
    margins = blocks.margins(steps).select("label", F.when(F.col("_fold") == 0, "train").otherwise("val").alias("split"), F.posexplode("margins"))
    scored = margins.select((F.col("pos") + 1).alias("epoch"), "split", "label", (1.0 / (1.0 + F.exp(-F.col("col")))).alias("score"))
    scored = stored(scored.withColumn("prediction", F.when(F.col("score") >= 0.5, 1).otherwise(0)), "epochs")
    blocks.unpersist()
    by = ["epoch", "split"]
    history = cut_lineage(metrics.evaluate(scored, by).join(metrics.log_loss(scored, by).drop("n"), by))

    def side(split: str, name: str, column: str):
        return F.max(F.when(F.col("split") == split, F.col(column))).alias(name)

    return history.groupBy("epoch").agg(
        side("train", "train_loss", "log_loss"),
        side("val", "val_loss", "log_loss"),
        side("train", "train_accuracy", "accuracy"),
        side("val", "val_accuracy", "accuracy"),
        side("train", "train_f1", "f1"),
        side("val", "val_f1", "f1"),
        side("val", "val_precision", "precision"),
        side("val", "val_recall", "recall"),
        side("val", "val_roc_auc", "roc_auc"),
    )


def best_epoch(history: DataFrame) -> DataFrame:
    return metrics.best_row(history, [F.desc("val_f1"), F.desc("val_roc_auc"), F.asc("epoch")])

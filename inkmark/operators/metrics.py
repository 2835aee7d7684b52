"""Evaluation of scored tables: counts, ratios, ROC-AUC with ties, slices, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmark.operators.audits import label_distribution
from inkmark.operators.joins import join_null_safe
from inkmark.session import cut_lineage

SLICE_COLUMNS = ("domain", "model", "attack", "decoding")
MIN_SLICE_ROWS = 20
# Quantile buckets per level of the prefix sum; a histogram beyond LARGE rows is cut twice, into AUC_BUCKETS ** 2 parts.
AUC_BUCKETS = 256
LARGE = 100_000_000


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def counts(scored: DataFrame, by: list[str]) -> DataFrame:
    """True/false positives and negatives per group; partial sums on the map side."""
    y, p = F.col("label") == 1, F.col("prediction") == 1
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(y & p).alias("tp"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"),
        F.count_if(~y & ~p).alias("tn"),
    )


def ratio_columns() -> dict[str, Column]:
    """Metrics from the four counts; empty denominators give 0."""
    tp, fp, fn, tn, n = (F.col(c) for c in ("tp", "fp", "fn", "tn", "n"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    precision0, recall0 = _ratio(tn, tn + fn), _ratio(tn, tn + fp)
    f1, f1_0 = _ratio(2 * tp, 2 * tp + fp + fn), _ratio(2 * tn, 2 * tn + fp + fn)
    return {
        "accuracy": _ratio(tp + tn, n),
        "precision": precision,
        "recall": recall,
        "f1": f1,
        "macro_precision": (precision + precision0) / 2,
        "macro_recall": (recall + recall0) / 2,
        "macro_f1": (f1 + f1_0) / 2,
        # the mean of the recalls of the classes that occur
        "balanced_accuracy": F.when((tp + fn) == 0, recall0).when((tn + fp) == 0, recall).otherwise((recall + recall0) / 2),
    }


BINARY = ("accuracy", "precision", "recall", "f1")
MACRO = ("macro_precision", "macro_recall", "macro_f1", "balanced_accuracy")


def with_ratios(counted: DataFrame, names: tuple[str, ...]) -> DataFrame:
    every = ratio_columns()
    return counted.withColumns({name: F.round(every[name], 6) for name in names})


def binary_metrics(scored: DataFrame, by: list[str]) -> DataFrame:
    return with_ratios(counts(scored, by), BINARY).select(*by, "n", *BINARY)


def macro_metrics(scored: DataFrame, by: list[str]) -> DataFrame:
    return with_ratios(counts(scored, by), MACRO).select(*by, "n", *MACRO)


def _histogram(scored: DataFrame, by: list[str], extra: list[str] | None = None) -> DataFrame:
    """Rows and positives per distinct score: tied scores become one row before any shuffle.

    Materialised, because the area reads it three times and the scoring plan behind it
    (features of the whole corpus, or a model) must run once.
    """
    return cut_lineage(
        scored.groupBy(*by, F.col("score").cast("double").alias("_s"), *(extra or [])).agg(
            F.count(F.lit(1)).alias("_n"), F.sum(F.col("label").cast("bigint")).alias("_pos")
        )
    )


def _bucketed(per_score: DataFrame, keys: list[str], name: str, buckets: int) -> DataFrame:
    """Number of the quantile bucket of each score within its group."""
    quantiles = [i / buckets for i in range(1, buckets)]
    edges = per_score.groupBy(*keys).agg(F.percentile_approx("_s", quantiles, 10 * buckets).alias("_edges"))
    # one row of edges per group
    placed = join_null_safe(per_score, edges, keys)
    return placed.withColumn(name, F.size(F.filter("_edges", lambda e: e < F.col("_s")))).drop("_edges")


def _area(histogram: DataFrame, by: list[str], buckets: int) -> DataFrame:
    per_score = (
        histogram.filter(F.col("_s").isNotNull())
        .groupBy(*by, "_s")
        .agg(F.sum("_pos").alias("_pos"), F.sum("_n").alias("_n"))
        .withColumn("_neg", F.col("_n") - F.col("_pos"))
    )
    placed, keys = per_score, list(by)
    levels = 1 if histogram.count() <= LARGE else 2
    for level in range(levels):
        placed = _bucketed(placed, keys, f"_b{level}", buckets)
        keys.append(f"_b{level}")
    totals = placed.groupBy(*keys).agg(F.sum("_neg").alias("_bn"))
    # at most as many rows per group as there are buckets
    across = Window.partitionBy(*by).orderBy(*keys[len(by) :]).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.withColumn("_below", F.coalesce(F.sum("_bn").over(across), F.lit(0))).drop("_bn")
    inside = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = join_null_safe(placed.withColumn("_in", F.coalesce(F.sum("_neg").over(inside), F.lit(0))), before, keys)
    ranked = ranked.withColumn("_twice", F.col("_pos") * (2 * (F.col("_below") + F.col("_in")) + F.col("_neg")))
    out = ranked.groupBy(*by).agg(
        F.sum(F.col("_twice").cast("decimal(38,0)")).alias("_twice"), F.sum("_pos").alias("_p"), F.sum("_neg").alias("_q")
    )
    area = F.col("_twice").cast("double") / (F.col("_p").cast("double") * F.col("_q") * 2)
    both = (F.col("_p") > 0) & (F.col("_q") > 0)
    return out.select(*by, F.when(both, F.round(area, 6)).alias("roc_auc"))


def _grouped(scored: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    return (scored, by) if by else (scored.withColumn("_all", F.lit(1)), ["_all"])


def roc_auc(scored: DataFrame, by: list[str], buckets: int = AUC_BUCKETS) -> DataFrame:
    """Area under the ROC curve with ties counted half; NULL where only one class occurs.

    The running count of negatives is a two-level prefix sum over the score histogram: scores
    fall into quantile buckets, the bucket totals are summed in order, and each bucket is
    summed inside on its own. No window ever spans all scores of a group.
    """
    rows, keys = _grouped(scored, by)
    area = _area(_histogram(rows, keys), keys, buckets)
    return area if by else area.drop("_all")


def evaluate(scored: DataFrame, by: list[str], macro: bool = False, buckets: int = AUC_BUCKETS) -> DataFrame:
    """Counts-based metrics and ROC-AUC, one row per group, from one pass over the scored rows.

    Counts and AUC both start from the same materialised histogram.
    """
    rows, keys = _grouped(scored, by)
    histogram = _histogram(rows, keys, ["prediction"])
    names = (*BINARY, *MACRO) if macro else BINARY
    hit = F.col("prediction") == 1
    neg = F.col("_n") - F.col("_pos")
    counted = histogram.groupBy(*keys).agg(
        F.sum("_n").alias("n"),
        F.sum(F.when(hit, F.col("_pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, neg).otherwise(0)).alias("fp"),
        F.sum(F.when(hit, 0).otherwise(F.col("_pos"))).alias("fn"),
        F.sum(F.when(hit, 0).otherwise(neg)).alias("tn"),
    )
    base = with_ratios(counted, names).select(*keys, "n", *names)
    out = join_null_safe(base, _area(histogram, keys, buckets), keys, "left")
    return out if by else out.drop("_all")


def log_loss(scored: DataFrame, by: list[str], probability: str = "score", eps: float = 1e-15) -> DataFrame:
    p = F.least(F.greatest(F.col(probability).cast("double"), F.lit(eps)), F.lit(1 - eps))
    loss = F.when(F.col("label") == 1, -F.ln(p)).otherwise(-F.ln(1 - p))
    return scored.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(loss), 6).alias("log_loss"))


def confusion_matrix(scored: DataFrame, by: list[str]) -> DataFrame:
    """All four cells per group, zeros included, as rows (true_label, predicted_label, n)."""
    cells = [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
    listed = F.array(
        *[
            F.struct(F.lit(t).alias("true_label"), F.lit(p).alias("predicted_label"), F.col(c).alias("n"))
            for t, p, c in cells
        ]
    )
    return counts(scored, by).select(*by, F.explode(listed).alias("_c")).select(*by, "_c.*")


def slice_metrics(
    scored: DataFrame,
    detector: str = "detector",
    columns: tuple[str, ...] = SLICE_COLUMNS,
    min_rows: int = MIN_SLICE_ROWS,
) -> DataFrame:
    """Metrics per metadata value; slices with few rows or one class are left out."""
    present = [c for c in columns if c in scored.columns]
    long = scored.select(detector, "label", "prediction", "score", *[F.col(c).cast("string").alias(c) for c in present])
    long = long.unpivot([detector, "label", "prediction", "score"], present, "slice_column", "slice_value")
    long = long.filter(F.col("slice_value").isNotNull())
    by = [detector, "slice_column", "slice_value"]
    # the area is NULL exactly where one class is missing
    report = evaluate(long, by, macro=True).filter((F.col("n") >= min_rows) & F.col("roc_auc").isNotNull())
    return report.drop("balanced_accuracy")


def error_rows(scored: DataFrame) -> DataFrame:
    """Mispredicted rows; the label becomes ``true_label``."""
    return (
        scored.filter(F.col("label") != F.col("prediction"))
        .withColumnRenamed("label", "true_label")
        .withColumnRenamed("prediction", "predicted_label")
    )


def rank_by_f1(results: DataFrame, by: str = "split") -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc("f1"), F.asc("model"))
    return results.withColumn("f1_rank", F.row_number().over(order))


def best_row(results: DataFrame, order: list[Column]) -> DataFrame:
    return results.orderBy(*order).limit(1)


def generalization_gap(results: DataFrame) -> DataFrame:
    """How much F1 drops from the model's own dataset to another one."""
    home = results.filter(F.col("train_dataset") == F.col("test_dataset")).select(
        "model", "train_dataset", F.col("f1").alias("in_domain_f1")
    )
    away = results.filter(F.col("train_dataset") != F.col("test_dataset")).select(
        "model", "train_dataset", "test_dataset", F.col("f1").alias("cross_f1")
    )
    return away.join(home, ["model", "train_dataset"]).withColumn(
        "f1_drop", F.round(F.col("in_domain_f1") - F.col("cross_f1"), 6)
    )


def probability_band(scored: DataFrame, probability: str = "score") -> DataFrame:
    """Reading aid for a probability of machine authorship."""
    p = F.col(probability)
    band = (
        F.when(p >= 0.70, "Likely AI-generated")
        .when(p >= 0.55, "Possibly AI-generated")
        .when(p <= 0.30, "Likely human-written")
        .when(p <= 0.45, "Possibly human-written")
        .otherwise("Uncertain")
    )
    # fixed values: band names and limits
    confidence = (
        F.when((p >= 0.70) | (p <= 0.30), "High confidence")
        .when((p >= 0.55) | (p <= 0.45), "Moderate confidence")
        .otherwise("Low confidence")
    )
    return scored.withColumns({"band": band, "confidence": confidence})


def experiment_rows(scored: DataFrame, split_rows: DataFrame, by: list[str]) -> DataFrame:
    """One row per (split, model): sizes, label distributions and metrics.

    ``scored`` holds the scored test rows, ``split_rows`` all rows with split name and side.
    """
    keys = ["split_name"]
    sides = split_rows.groupBy(*keys).agg(
        F.count_if(F.col("split") == "train").alias("train_size"),
        F.count_if(F.col("split") == "test").alias("test_size"),
    )
    for side in ("train", "test"):
        text = label_distribution(split_rows.filter(F.col("split") == side), by=keys)
        sides = sides.join(text.withColumnRenamed("label_distribution", f"{side}_label_distribution"), keys, "left")
    return evaluate(scored, by).drop("n").join(sides, keys)


def report_lines(results: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """Markdown table rows: header, rule and one line per result, floats with four decimals."""
    present = [c for c in columns if c in results.columns]
    floats = {f.name for f in results.schema.fields if f.dataType.typeName() in ("double", "float")}

    def cell(name: str) -> Column:
        value = F.col(name)
        if name in floats:
            return F.coalesce(F.format_string("%.4f", F.round(value, 4)), F.lit("nan"))
        return F.coalesce(value.cast("string"), F.lit("None"))

    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in present]), F.lit(" |"))
    ranked = results.select(F.row_number().over(Window.orderBy(*order)).alias("_n"), line.alias("line"))
    head = "| " + " | ".join(present) + " |"
    rule = "| " + " | ".join(["---"] * len(present)) + " |"
    # result tables hold one row per experiment; the head is attached to the first of them
    numbered = ranked.select(
        F.explode(
            F.when(
                F.col("_n") == 1,
                F.array(
                    F.struct(F.lit(0).alias("line_no"), F.lit(head).alias("line")),
                    F.struct(F.lit(1).alias("line_no"), F.lit(rule).alias("line")),
                    F.struct(F.lit(2).alias("line_no"), F.col("line").alias("line")),
                ),
            ).otherwise(F.array(F.struct((F.col("_n") + 1).alias("line_no"), F.col("line").alias("line"))))
        ).alias("_l")
    )
    return numbered.select("_l.line_no", "_l.line")
